"""Exactly-once ingest, running moments and keyed tables."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from courtside.sources import tables
from courtside.streaming import incremental, sink

DOC = "code string, at timestamp, body int"


def docs(spark, *rows):
    return spark.createDataFrame(rows, "code string, at string, body int").withColumn("at", F.col("at").cast("timestamp"))


class Drops:
    """A folder of dropped files and a target that a stream fills from it."""

    def __init__(self, spark, path, **options):
        self.spark, self.source, self.target, self.path, self.options = spark, str(path / "in"), str(path / "out"), path, options
        self.schema = docs(spark).schema

    def take(self, *rows, checkpoint="c"):
        if rows:
            docs(self.spark, *rows).coalesce(1).write.mode("append").parquet(self.source)
        incremental.ingest(self.spark, self.source, self.schema, self.target, str(self.path / checkpoint), "code", "at", **self.options).awaitTermination(120)
        return sorted((r.code, r.body) for r in incremental.ingested(self.spark, self.target, self.schema).collect())


def test_late_and_repeated_documents_are_there_once(spark, tmp_path):
    drops = Drops(spark, tmp_path)
    assert drops.take(("a", "2024-01-29", 1), ("b", "2024-01-30", 2), ("b", "2024-01-30", 3), (None, "2024-01-30", 9)) in ([("a", 1), ("b", 2)], [("a", 1), ("b", 3)])
    first = drops.take()
    assert drops.take(("c", "2024-01-01", 4), ("d", "2024-02-01", 5), ("a", "2024-01-29", 6), ("e", None, 7), ("e", None, 8))[:-1] == [*first, ("c", 4), ("d", 5)]
    kept = drops.take()
    assert [c for c, _ in kept] == ["a", "b", "c", "d", "e"]
    assert drops.take(checkpoint="new") == kept  # a stream that knows nothing reads all files anew


def test_a_key_may_change_its_day_if_that_is_said(spark, tmp_path):
    drops = Drops(spark, tmp_path, key_keeps_day=False)
    drops.take(("a", "2024-01-29", 1))
    assert drops.take(("a", "2024-03-01", 2), ("b", "2024-03-01", 3)) == [("a", 1), ("b", 3)]


def test_an_epoch_that_is_not_whole_is_not_seen_and_comes_once_when_repeated(spark, tmp_path):
    drops = Drops(spark, tmp_path)
    kept = drops.take(("a", "2024-01-29", 1))
    entry = next(Path(drops.target, "manifest").glob(f"{sink.RUN}=*"))
    os.rename(entry, tmp_path / "aside")  # as after a crash before the manifest
    assert incremental.ingested(spark, drops.target, drops.schema).count() == 0
    commits = sorted(Path(tmp_path, "c", "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in Path(tmp_path, "c", "commits").glob(".*.crc"):
        crc.unlink()
    assert drops.take() == kept
    assert drops.take() == kept and incremental.ingested(spark, drops.target, drops.schema).count() == 1


def test_compaction_keeps_rows_and_streams_go_on(spark, tmp_path):
    drops = Drops(spark, tmp_path)
    drops.take(("a", "2024-01-29", 1))
    kept = drops.take(("b", "2024-01-01", 2))
    sink.compact(spark, drops.target, drops.schema)
    assert drops.take() == kept and len(list(Path(drops.target, "data").glob(f"{sink.RUN}=*/{sink.EPOCH}=*"))) == 1
    assert drops.take(("a", "2024-01-29", 3), ("c", "2024-01-01", 4)) == [*kept, ("c", 4)]


@pytest.mark.parametrize("drops", [1, 4])
def test_moments_of_a_stream_equal_those_of_a_batch(spark, tmp_path, drops):
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(60)) * 86400).alias("at"), F.col("id"), F.when(F.col("id") % 11 != 0, 1e6 + F.sin("id")).alias("v"))
    rows = rows.unionByName(spark.sql("SELECT 9L AS k, timestamp'2020-01-01' AS at, 500L AS id, cast(null AS double) AS v"))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    args = (rows.schema, target, str(tmp_path / "c"), ["k"], "at", ["v"], ["id"])
    for k in range(drops):
        rows.where(F.pmod(F.unix_date(F.to_date("at")), F.lit(drops)) == drops - 1 - k).write.mode("append").parquet(source)
        incremental.ingest_moments(spark, source, *args).awaitTermination(120)
    got = {r.k: r for r in incremental.moments(spark, target, rows.schema, ["k"], "at", ["v"], ["id"]).collect()}
    rows.createOrReplaceTempView("moment_rows")
    want = spark.sql("SELECT k, count(*) AS games, avg(v) AS avg_v, stddev_pop(v) AS std_v, regr_slope(v, nth) AS trend_v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY at, id) - 1 AS nth FROM moment_rows) GROUP BY k").collect()
    assert len(got) == len(want) == 4
    for w in want:
        g = got[w.k]
        assert g.games == w.games and g.avg_v == pytest.approx(w.avg_v) and (g.std_v is None) == (w.std_v is None)
        if w.std_v is not None:
            assert g.std_v == pytest.approx(w.std_v, rel=1e-9) and g.trend_v == pytest.approx(w.trend_v, abs=1e-9)


def test_upserts_leave_untouched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    new = lambda *rows: spark.createDataFrame(rows, "k long, at int, v string")
    schema = new().schema
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path, "rows").rglob("*.parquet") if tables.BUCKET in str(p)}
    table = lambda: sorted((r.k, r.v) for r in tables.read_table(spark, path, schema).collect())
    tables.upsert(new(*[(i, 1, "old") for i in range(64)]), path, ["k"], "at", 16)
    before = files()
    tables.upsert(new((3, 2, "late"), (3, 5, "new"), (None, 9, "lost"), (99, 1, "more")), path, ["k"], "at", 999)
    want = sorted([(i, "new" if i == 3 else "old") for i in range(64)] + [(99, "more")])
    assert table() == want
    touched = {f"{tables.BUCKET}={b}" for (b,) in new((3, 0, ""), (99, 0, "")).select(tables.bucket_of(["k"], 16)).collect()}
    same = {p for p, t in before.items() if files().get(p) == t}
    assert {p for p in before if p.parent.name not in touched} == same and same
    tables.upsert(new((3, 5, "new"), (99, 1, "more")), path, ["k"], "at")
    assert table() == want
    assert [r.v for r in tables.lookup(spark, path, schema, k=3).collect()] == ["new"] and tables.lookup(spark, path, schema, k=1000).count() == 0
    with pytest.raises(ValueError):
        tables.lookup(spark, path, schema, v="new")
