"""Events are not shuffled by their context, nor with what is made of them."""

from pyspark.sql import functions as F

from courtside.operators import mart, normalize
from courtside.plans import bind, catalog
from courtside.plans import reports  # noqa: F401


def test_events_meet_small_statistics_without_a_shuffle(spark, tmp_path, monkeypatch):
    weighed, small_side = [], normalize.small_side
    monkeypatch.setattr(normalize, "small_side", lambda df: weighed.append(df) or small_side(df))
    spark.range(1000).select((F.col("id") % 3).alias("level"), F.col("id").cast("double").alias("x"), F.lit(20.0).alias("minutes")).write.parquet(str(tmp_path / "t"))
    events = spark.read.parquet(str(tmp_path / "t"))
    out = normalize.normalised(events, ["level"], ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(weighed) == 1 and "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    means = out.groupBy("level").agg(F.avg("z_x").alias("m"), F.stddev_pop("z_x").alias("s")).collect()
    assert len(means) == 3 and all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in means)


def test_events_meet_by_player_before_figures_are_made_of_them(spark, sf_dir):
    plan = catalog.QUERIES["a08_profile_metrics"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    shuffled = plan[plan.index("RepartitionByExpression") :].splitlines()[1]  # what goes through it: columns of the tables alone
    assert "l_partkey" in shuffled and " AS " not in shuffled
    rows = bind.perf_by_player(spark, sf_dir)
    given = bind.view(spark, sf_dir, bind.PERF)
    assert rows.schema == given.schema and rows.exceptAll(given).isEmpty() and given.exceptAll(rows).isEmpty()


def test_teams_are_looked_for_in_the_best_careers_games_alone(spark, sf_dir, monkeypatch):
    seen, career_list = [], mart.career_list
    monkeypatch.setattr(mart, "career_list", lambda careers, profiles, *more: seen.append(profiles) or career_list(careers, profiles, *more))
    rows = catalog.QUERIES["j16_career_list"](spark, sf_dir).collect()
    names = {r.name for r in seen[0].select("name").distinct().collect()}
    assert names == {r.name for r in rows} and len(rows) > 20
    assert bind.view(spark, sf_dir, bind.PERF).select("player_id").distinct().count() > 50 >= len(rows)
