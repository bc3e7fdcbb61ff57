"""Exact top-k search by inner product over vectors sorted by length.

Vectors are integers (or made so by :func:`scaled`). They are dealt into chunks of descending length, and the chunks into
waves, each eight times as many chunks as all before it together. Every wave meets the queries in blocks (a chunk by a
block of queries is a cell); a query takes along the k-th best score of the waves before, so that of a later, larger wave
only what may still enter its top k leaves a cell.

In a cell, vectors are processed by descending length. A query stops where its length times the block's greatest length
is below its k-th score. Before that, both sides are rotated by the singular vectors of a sample, which gathers what
inner products are made of in the first coordinates: the partial sum over these, and by Cauchy-Schwarz the product of
the residual lengths, bound the score from above; only what may reach the k-th score is computed in integers, exactly.
The rotation and the bounds decide what is skipped, never a score.

No side is broadcast, and a cell's size is bounded: there are as many cells as the stated queries against all rows need.
Equal vectors, however many, are dealt by row among the chunks of their length.

Vectors that are null, or of which a component is null or not finite (after scaling), take no part; of vectors of different
dimension the shorter counts as padded with zeros, one without components as zero. A score that 64 bits can't hold is
their nearest bound. Ids are integers or null; a null id is no query and comes after all others of an equal score. Repeated rows are candidates for each other.
A table without queries or candidates gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.plans.storage import partitions, saved

#: Vectors in a chunk at least and at most, queries in a block, growth of the waves.
LEAST_CHUNK, MOST_CHUNK, QUERY_BLOCK, GROWTH = 4096, 1 << 16, 1 << 14, 8
#: Numbers in the sample that the rotation is fitted to, and the largest dimension that is rotated.
SAMPLE_NUMBERS, MOST_ROTATED = 1 << 22, 1024
#: Queries and vectors compared at a time, and the share of coordinates in a partial sum.
TILE_QUERIES, TILE_VECTORS, HEAD = 256, 1024, 0.5
#: Sums below this are exact in doubles.
EXACT = float(1 << 52)


def scaled(vector: Column, by: float) -> Column:
    """Each component times ``by``, rounded down, as doubles; doubles of that size are whole, and ``floor`` would lose what 64 bits can't hold."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * by
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def _whole(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def rotation(vectors: DataFrame, n: int, dimension: int) -> np.ndarray | None:
    """Right singular vectors of about ``SAMPLE_NUMBERS / dimension`` vectors (all if there are fewer), greatest first; none beyond ``MOST_ROTATED`` dimensions."""
    if not 1 < dimension <= MOST_ROTATED:
        return None
    share = min(1.0, SAMPLE_NUMBERS / dimension / n)
    rows = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow().column("v")
    x = _matrix([np.asarray(v.values) for v in rows], dimension)
    x = x / max(1e-300, np.abs(x).max(initial=0))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def _matrix(rows, dimension: int) -> np.ndarray:
    out = np.zeros((len(rows), dimension))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class _Side:
    """Vectors of a cell: whole, rotated, with their lengths and those of what a partial sum leaves out."""

    def __init__(self, rows: pd.DataFrame, dimension: int, turn: np.ndarray | None):
        self.x = _matrix(rows["v"].to_numpy(), dimension)
        self.row, self.id = rows["row"].to_numpy(np.int64), rows["id"]
        turned = self.x if turn is None else self.x @ turn
        head = math.ceil(dimension * HEAD)
        self.head, self.length = turned[:, :head], np.sqrt((self.x**2).sum(1))
        self.rest = np.sqrt((turned[:, head:] ** 2).sum(1))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of one pair each, beyond what doubles hold exactly."""
    most = (1 << 63) - 1
    return np.array([min(most, max(-most - 1, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(q, x)], object)


def best_of_cell(queries: pd.DataFrame, vectors: pd.DataFrame, dimension: int, turn: np.ndarray | None, k: int) -> pd.DataFrame:
    """``(query, score, id, row)``: the best ``k`` vectors of the cell for each query that reach its ``least``, fewer where bounds say that no more can."""
    vectors = vectors.assign(length=[float(np.dot(v, v)) for v in vectors["v"]]).sort_values(["length", "row"], ascending=[False, True])
    q, x = _Side(queries, dimension, turn), _Side(vectors, dimension, turn)
    wide = q.length.max() * x.length.max() >= EXACT
    kind = object if wide else np.int64
    known = x.id.notna().to_numpy()
    ids = np.where(known, x.id.fillna(0).to_numpy(np.int64), np.iinfo(np.int64).max)
    out = []
    for a in range(0, len(queries), TILE_QUERIES):
        own = slice(a, a + TILE_QUERIES)
        least = np.where(queries["least"].isna(), -np.inf, queries["least"].astype(float))[own]
        best = {"of": np.zeros(0, np.int64), "score": np.zeros(0, kind), "at": np.zeros(0, np.int64)}
        for b in range(0, len(vectors), TILE_VECTORS):
            some = slice(b, b + TILE_VECTORS)
            slack = 1e-9 * q.length[own] * x.length[b] + 1e-6
            live = np.flatnonzero(q.length[own] * x.length[b] + slack >= least)
            if not len(live):
                break  # what follows is shorter still
            bound = q.head[own][live] @ x.head[some].T + np.outer(q.rest[own][live], x.rest[some]) + slack[live, None]
            may = (bound >= least[live, None]) & (q.row[own][live, None] != x.row[some][None, :])
            of, at = np.nonzero(may)
            if not len(of):
                continue
            if wide:
                score = _exact(q.x[own][live[of]], x.x[some][at])
            elif len(of) * 4 > may.size:
                score = np.rint((q.x[own][live] @ x.x[some].T)[of, at]).astype(np.int64)
            else:
                score = np.rint(np.einsum("ij,ij->i", q.x[own][live[of]], x.x[some][at])).astype(np.int64)
            reach = score.astype(float) + slack[live[of]] >= least[live[of]]
            best = {"of": np.concatenate((best["of"], live[of[reach]])), "score": np.concatenate((best["score"], score[reach])), "at": np.concatenate((best["at"], at[reach] + b))}
            order = np.lexsort((x.row[best["at"]], ids[best["at"]], ~known[best["at"]], -best["score"].astype(float) if not wide else _ranks(best["score"]), best["of"]))
            best = {c: v[order] for c, v in best.items()}
            first = np.searchsorted(best["of"], best["of"])
            keep = np.arange(len(first)) - first < k
            best = {c: v[keep] for c, v in best.items()}
            full = np.flatnonzero(np.bincount(best["of"], minlength=len(least)) == k)
            last = np.searchsorted(best["of"], full, "right") - 1
            least[full] = np.maximum(least[full], best["score"][last].astype(float))
        out.append(pd.DataFrame({"query": q.row[own][best["of"]], "score": best["score"].astype(np.int64), "id": x.id.iloc[best["at"]].to_numpy(), "row": x.row[best["at"]]}))
    return pd.concat(out, ignore_index=True)


def _ranks(scores: np.ndarray) -> np.ndarray:
    """Numbers that order exact scores, the highest first."""
    place = {s: i for i, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
    return np.array([place[s] for s in scores.tolist()], np.int64)


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query, ranked; tasks keep no more than that before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector: Column | None = None) -> DataFrame:
    """``(query_id, rank, id_col, score)``: for each row whose id ``is_query`` holds for, the ``k`` other rows of the highest inner product, ties to the smaller id.

    ``vector`` gives the integers of a row as an array of doubles; the column ``embedding`` rounded down by default.
    """
    spark = df.sparkSession
    vector = scaled(F.col("embedding"), 1.0) if vector is None else vector
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v")).where(_whole(F.col("v")))
    rows = saved(rows).select(F.monotonically_increasing_id().alias("row"), "*")
    n, dimension, asked = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(is_query(F.col("id")))).first()
    turn = spark.sparkContext.broadcast(rotation(rows, n, dimension) if n else None)
    each = max(LEAST_CHUNK, min(MOST_CHUNK, n // (4 * partitions(spark))))
    chunks, blocks = max(1, math.ceil(n / each)), max(1, math.ceil(asked / QUERY_BLOCK))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dealt = saved(rows.withColumn("length", length).repartitionByRange(chunks, F.desc("length"), "row").select("row", "id", "v", F.spark_partition_id().alias("chunk")))
    chunks = 1 + dealt.agg(F.coalesce(F.max("chunk"), F.lit(0))).first()[0]
    # names of their own: the columns of the two sides must not be taken for the same ones
    queries = rows.where(is_query(F.col("id"))).select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("asked"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))

    def cell(asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        if asks.empty or has.empty:
            return pd.DataFrame({"query": [], "score": [], "id": [], "row": []})
        return best_of_cell(asks.rename(columns={"query": "row", "query_id": "id", "asked": "v"}), has, dimension, turn.value, k)

    best, low, high = None, 0, 1
    while low < chunks:
        high = min(high, chunks)
        part = dealt.where(F.col("chunk").between(low, high - 1)).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asks = queries.withColumn("least", F.lit(None).cast("bigint"))
        if best is not None:
            asks = queries.join(best.where(F.col("rank") == k).select("query", F.col("score").alias("least")), "query", "left")
        asks = asks.select("*", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("chunk"))
        found = asks.groupBy("block", "chunk").cogroup(part.groupBy("block", "chunk")).applyInPandas(cell, "query bigint, score bigint, id bigint, row bigint")
        best = saved(_first(found if best is None else found.unionByName(best.drop("rank")), k))
        low, high = high, high * GROWTH
    named = best.join(queries.select("query", "query_id"), "query")
    return named.select("query_id", "rank", F.col("id").alias(id_col), "score")
