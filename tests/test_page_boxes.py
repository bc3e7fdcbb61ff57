"""Pages are cut into pieces once."""

from courtside.sources import pages


def test_a_box_is_cut_once(spark):
    html = spark.createDataFrame([(1, "<p>nothing</p>")], "page_id long, html string")
    plan = pages.game_boxes(html)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("box-marcador") == 1
    empty = pages.game_boxes(html).first()
    assert empty.home_team is None and empty.home_score is None and empty.home_quarters == [] and empty.referees == []
