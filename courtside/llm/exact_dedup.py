"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when they are identical without ASCII white space. Each batch is first reduced to one row per digest
(partial aggregation: a group of copies that holds a third of all rows is one row before anything is joined). Each
snapshot has a stored binary-fuse filter per digest bucket; buckets are sized by a count, so a filter and the digests
that it screens fit a task at any size. Incoming digests the filters reject are new; the positives join the snapshots'
exact buckets by full digest. Where a digest stands on several sides (snapshots and the batch), the texts of the sides'
representatives are compared byte by byte. Duplicates within the new batch are grouped by digest on their own. Texts
themselves are shuffled only for that comparison, one a side.

Null texts count as empty, empty texts equal each other, texts of any length are read whole, repeated rows are members
of their group like any other (of rows equal in id and length one is kept), an id may stand on several texts, a null id
never wins over another id, an empty table gives an empty result, and other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import posixpath
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.plans.storage import saved, shared_folder, small_side

#: Digests per bucket, on average, of which one filter is built; bytes a digest needs in it: about 1.2.
KEYS_PER_BUCKET = 1 << 15
WHITE = r"[\x20\x09-\x0D]+"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def _slots(h: np.ndarray, segment: int, segments: int) -> list[np.ndarray]:
    """Three slots of each hash, in three neighbouring segments."""
    first = (h >> np.uint64(32)) * np.uint64(segments * segment) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    return [first, first + np.uint64(segment) ^ h >> np.uint64(18) & mask, first + np.uint64(2 * segment) ^ h & mask]


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter of distinct 64-bit keys: ``(seed, segment length, segments, table)``.

    Slots that one key alone uses are peeled, all of them in a round, until no key is left; the keys get their table
    bytes in the opposite order. A seed that leaves keys over is followed by the next.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = max(2, len(keys))
    segment = min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
    capacity = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(capacity / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        slots = np.stack(_slots(h, segment, segments)).astype(np.int64)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            who, where = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[where]))
            for row in slots[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
            left -= len(who)
        if left:
            continue
        table, marks = np.zeros(size, np.uint8), _fingerprints(h)
        for who, where in reversed(rounds):
            others = table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]] ^ table[where]
            table[where] = marks[who] ^ others
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed peels these keys")


def may_contain(filter_row: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """For each key, False if it is surely not among the filter's keys (one in 256 others passes)."""
    seed, segment, segments, data = filter_row
    table = np.frombuffer(data, np.uint8)
    h = _mix(keys.astype(np.uint64), int(seed) * 0x9E3779B97F4A7C15 % 2**64)
    a, b, c = (s.astype(np.int64) for s in _slots(h, int(segment), int(segments)))
    return table[a] ^ table[b] ^ table[c] == _fingerprints(h)


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def digests(df: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, snapshot, n_points, sha)`` for every row, written once; ``snapshot`` is null for the incoming batch and ``row`` a number of its own."""
    rows = df.select(
        F.col(id_col).alias("id"),
        snapshot.cast("int").alias("snapshot"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
        F.sha2(normalised(F.col(text_col)), 256).alias("sha"),
    )
    return saved(rows).select(F.monotonically_increasing_id().alias("row"), "*")


def build_filters(groups: DataFrame) -> DataFrame:
    """``(snapshot, buckets, bucket, seed, segment, segments, data)``: a filter for each bucket of the digests ``(snapshot, sha)`` of each snapshot.

    A snapshot's number of buckets follows the number of its digests, so one filter's keys fit a task at any size.
    """
    counts = small_side(groups.groupBy("snapshot").agg(F.ceil(F.count("*") / F.lit(KEYS_PER_BUCKET)).alias("buckets")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, data = build_filter(pdf["key"].to_numpy())
        return pd.DataFrame([{"snapshot": pdf["snapshot"].iloc[0], "buckets": pdf["buckets"].iloc[0], "bucket": pdf["bucket"].iloc[0], "seed": seed, "segment": segment, "segments": segments, "data": data}])

    keyed = _keyed(groups.select("snapshot", "sha").join(counts, "snapshot"))
    return keyed.groupBy("snapshot", "bucket").applyInPandas(build, "snapshot int, buckets long, bucket long, seed long, segment long, segments long, data binary")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("snapshot", "sha", "buckets", F.xxhash64("sha").alias("key"), F.pmod(F.xxhash64("sha", F.lit(1)), F.col("buckets")).alias("bucket"))


def write_filters(groups: DataFrame, path: str) -> None:
    """Store the filters of immutable snapshots, one row a bucket, about nine bits a digest."""
    build_filters(groups).write.mode("overwrite").parquet(path)


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """Filters that :func:`write_filters` stored."""
    return spark.read.parquet(path)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """``(snapshot, sha)``: the digests of the incoming batch that the filters of a snapshot do not reject; nothing of the snapshots but their filters is read."""

    def probe(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if known.empty:
            return new.loc[:, ["snapshot", "sha"]].iloc[:0]
        return new.loc[may_contain(tuple(known[["seed", "segment", "segments", "data"]].iloc[0]), new["key"].to_numpy()), ["snapshot", "sha"]]

    # one row a snapshot
    snapshots = [F.struct(F.lit(r.snapshot).cast("int").alias("snapshot"), F.lit(r.buckets).cast("bigint").alias("buckets")) for r in filters.groupBy("snapshot").agg(F.max("buckets").alias("buckets")).collect()]
    each = F.array(*snapshots) if snapshots else F.array().cast("array<struct<snapshot:int,buckets:bigint>>")
    asked = _keyed(incoming.select("sha", F.inline(each)))
    return asked.groupBy("snapshot", "bucket").cogroup(filters.groupBy("snapshot", "bucket")).applyInPandas(probe, "snapshot int, sha string")


def exact_dedup(df: DataFrame, snapshot: Column, id_col: str = "doc_id", text_col: str = "text", filters: DataFrame | None = None) -> DataFrame:
    """One row per document: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Of equal texts the row with the most code points stays, then the smallest id; of rows that tie in both, one.
    ``snapshot`` gives the number of the immutable snapshot that holds a row, or null for a row of the incoming batch.
    ``filters`` are the snapshots' stored filters (:func:`read_filters`); without them they are built and stored first.
    """
    spark = df.sparkSession
    rows = digests(df, snapshot, id_col, text_col)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("x"), "id", "row")).alias("best")
    groups = saved(rows.groupBy("snapshot", "sha").agg(best, F.count("*").alias("members")))
    old, new = groups.where("snapshot is not null"), groups.where("snapshot is null")
    if filters is None:
        path = posixpath.join(shared_folder(spark), f"filters-{uuid.uuid4().hex}")
        write_filters(old, path)
        filters = read_filters(spark, path)
    positives = screen(new, filters)
    known = saved(old.select("snapshot", "sha").join(positives, ["snapshot", "sha"], "left_semi").select("sha").distinct())
    sides = old.unionByName(new.join(known, "sha", "left_semi"))
    several = sides.groupBy("sha").agg(F.count("*").alias("n"), F.collect_list("best.id").alias("ids"), F.max(F.col("best.id").isNull()).alias("nulls")).where("n > 1")
    differing = saved(_differing(df, several, id_col, text_col))
    sided = groups.join(known.withColumn("known", F.lit(True)), "sha", "left").join(differing.withColumn("differs", F.lit(True)), "sha", "left")
    side = F.coalesce("snapshot", F.lit(-1))
    apart = F.when(F.col("differs").isNotNull() | (F.col("snapshot").isNull() & F.col("known").isNull()), side)
    merged = saved(sided.withColumn("apart", apart).groupBy("sha", "apart").agg(F.min("best").alias("best"), F.sum("members").alias("group_size"), F.collect_set(side).alias("sides")))
    merged = merged.select("sha", F.explode("sides").alias("side"), F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    out = rows.withColumn("side", side).join(merged, ["sha", "side"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def _side_texts(df: DataFrame, several: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(sha, text)``: the normalised texts of the sides' representatives.

    Ids decide first which rows are hashed again; then id and digest together find the text, so that an id on many
    rows, or none, brings its rows together with their own digests only.
    """
    ids = several.select("sha", F.explode("ids").alias("id")).unionByName(several.where("nulls").select("sha", F.lit(None).cast(df.schema[id_col].dataType).alias("id")))
    wanted = small_side(ids.distinct())
    named = small_side(ids.select("id").distinct())
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(named, F.col("__id").eqNullSafe(F.col("id")), "left_semi")
    texts = texts.select("__id", normalised(F.col("text")).alias("text")).withColumn("__sha", F.sha2("text", 256))
    return texts.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__sha") == F.col("sha"))).select("sha", "text")


def _differing(df: DataFrame, several: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests whose sides' representatives, compared byte by byte, turn out to differ: an equal digest of another text."""
    texts = _side_texts(df, several, id_col, text_col)
    return texts.groupBy("sha").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("sha")
