"""Documents are written once and slim; times are read by the one pattern that can fit."""

from pyspark.sql import functions as F

from courtside.functions import scalars
from courtside.plans import catalog
from courtside.sources import ingest


def test_checked_lines_are_kept_as_documents_or_as_lines(spark, tmp_path, monkeypatch):
    lines = ['{"HEADER": {"game_code": "1"}}', '{"HEADER": {"season": "2020"}}', '{"HEADER": {"game', " ", '{"HEADER": {"game_code": "2"}, "SHOTCHART": "x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "lines"))
    kept, saved = [], ingest.saved
    monkeypatch.setattr(ingest, "saved", lambda df: kept.append(df) or saved(df))
    good, rejected = ingest.read_checked(spark, str(tmp_path / "lines"))
    assert sorted(tuple(r) for r in good.select("HEADER.game_code", "SHOTCHART").collect()) == [("1", None), ("2", "x")]
    assert sorted((r.line, r.reason) for r in rejected.collect()) == sorted([(lines[1], "no game code"), (lines[2], "malformed")])
    assert kept[0].columns == ["line", "reason", "g"] and kept[0].where(F.col("line").isNotNull() == F.col("g").isNotNull()).count() == 0


def test_a_time_is_read_by_the_pattern_it_looks_like(spark):
    texts = ["2020-01-02 03:04:05", "2020-01-02T03:04:05", "2020-01-02t03:04:05", "02-01-2020 - 03:04", "02-01-2020", "2020-01-02", "", " 2020-01-02", "2020-01-02 ", "02-01-2020 03:04", "2-1-2020", "20-1", "12020-01-02", "+12020-01-02", "-2020-01-02", "2020-13-02", "x", None]
    patterns = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy - HH:mm", "dd-MM-yyyy", "yyyy-MM-dd")
    one_of = F.coalesce(*[F.try_to_timestamp("t", F.lit(p)) for p in patterns])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.game_time(F.col("t")).cast("string").alias("got"), one_of.cast("string").alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows] and sum(r.got is not None for r in rows) >= 6


def test_documents_are_marked_up_after_their_rows_have_met(spark, sf_dir):
    plan = catalog._game_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    gathering = plan[plan.index("Aggregate") :]
    assert "collect_list" in gathering and "pllss" not in gathering and "field_goals_made" not in gathering


def test_documents_are_kept_in_columns_and_figures_alone_are_dealt_to_sides(spark, sf_dir, monkeypatch):
    seen, assigned = [], ingest.assigned_sides
    monkeypatch.setattr(ingest, "assigned_sides", lambda players, *more: seen.append(players) or assigned(players, *more))
    plan = catalog.QUERIES["n06_flattened_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan
    texts = {f.name for f in seen[0].schema["row"].dataType.fields if f.dataType.simpleString() == "string"}
    assert "p" not in seen[0].columns and texts <= {"player_key", "player_name", "shirt"}
