"""Spreads and bounds that no order of rows decides."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import aggregates

EVENT = "player_id long, game_date int, game_id long, line_no int, part_id long, squad_id long, price double, points int"


def test_ratings_equal_but_for_the_last_digit_have_no_spread(spark):
    a, b = 166.66666666666666, 166.66666666666669  # newest first, as the window numbers them
    values = spark.createDataFrame([([a, b],), ([1.0, 2.0, 4.0],), ([3.0],), ([],)], "v array<double>").select(aggregates.running_variance(F.col("v")).alias("v"))
    got = [r.v for r in values.collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(14 / 9) and got[2] == 0.0 and got[3] is None


@pytest.mark.parametrize("points", [[0, 9, 3, 7, 4, 28, 6, 7], [1, 0, 4, 9, 7, 5, 3, 2, 5, 15, 4]])
def test_an_event_at_the_bound_is_no_outlier_in_any_order(spark, points):
    rng = random.Random(4)
    for _ in range(3):
        df = spark.createDataFrame([(1, i, i, i, i, i, 1.0, p) for i, p in enumerate(points)], EVENT).coalesce(1)
        assert aggregates.outlier_events(df, ["player_id"]).count() == 0
        rng.shuffle(points)
    more = spark.createDataFrame([(1, i, i, i, i, i, 1.0, p) for i, p in enumerate([*[1, 2] * 9, 90])], EVENT)
    assert [r.points for r in aggregates.outlier_events(more, ["player_id"]).collect()] == [90]
