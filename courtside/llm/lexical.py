"""Ranked lexical search, reversed: documents stream through an inverted index over the items' terms.

The items are the small side: their inverted index (term, and for each term the items that hold it and how often) is
broadcast. A first pass over the documents counts, for the index's terms only, the documents that hold each, and the
documents and terms of the whole table; the sums of the tasks are combined before they meet. A second pass streams each
document's term counts through the index, which gives its score for every item that shares a term, and updates one heap
of at most ``k`` entries an item. The heaps of tasks are merged in two steps, so that what one task merges grows with the
square root of the number of tasks.

Items beyond ``BLOCK_BYTES`` of text are dealt into several indexes by hash, which pass over the documents one after the
other: what is broadcast does not grow with the data. A document's memory is that of its own terms. Rows are not
shuffled, but for the heaps, and there is no hot key.

Terms are maximal stretches of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. Null
and empty texts have no terms: such a document is never found and does not count, such an item finds nothing. Texts of
any length are read whole. Repeated rows are documents, and items, of their own. Ids are integers or null; a null id
comes after all others of an equal score. Without documents or items the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.frames import map_texts
from courtside.plans.storage import saved

#: Bytes of items' text in one index, about, documents scored at a time, tasks whose heaps are merged first.
BLOCK_BYTES, BLOCK_DOCUMENTS, MERGED_TASKS = 16 << 20, 64, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_LOWER).split() if text else []


class Index:
    """Inverted index of items: ``at`` numbers the terms, whose postings are ``item`` and ``times`` from ``first`` on."""

    def __init__(self, texts: list[bytes | None]):
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            for term, n in Counter(terms(text)).items():
                postings.setdefault(term, []).append((i, n))
        self.items, self.at = len(texts), {term: t for t, term in enumerate(postings)}
        self.first = np.concatenate(([0], np.cumsum([len(p) for p in postings.values()]))).astype(np.int64)
        self.item, self.times = (np.array([x[c] for p in postings.values() for x in p], np.int64) for c in (0, 1))

    def counted(self, text: bytes | None) -> tuple[int, list[int], list[int]]:
        """A document's number of terms, and the numbers and counts of those that items hold."""
        words, at = terms(text), self.at
        found = [(t, n) for w, n in Counter(words).items() if (t := at.get(w)) is not None]
        return len(words), [t for t, _ in found], [n for _, n in found]


def weights(index: Index, documents: int, holding: dict[int, int]) -> np.ndarray:
    """The weight of each term of the index by how many documents hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(index.at))], np.int64)


def statistics(documents: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """``(documents with a term, their terms, documents that hold each of the index's terms)``; the index is broadcast as ``shared``."""

    def run(batches):
        index, holding, documents, words = shared.value, np.zeros(len(shared.value.at), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                n, found, _ = index.counted(text.as_py())
                documents, words = documents + (n > 0), words + n
                holding[found] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], at))), pa.array(np.concatenate(([documents, words], holding[at])))], names=["term", "n"])

    sums = map_texts(documents.select(F.col("text").cast("binary")), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}  # a row a term of the index
    return found.pop(-2, 0), found.pop(-1, 0), found


def _scores(index: Index, weight: np.ndarray, counted: list[tuple[int, list[int], list[int]]], documents: int, words: int) -> np.ndarray:
    """The score of each of some documents for each item."""
    sizes = [len(c[1]) for c in counted]
    of = np.repeat(np.arange(len(counted)), sizes)
    at, tf = (np.array([x for c in counted for x in c[k]], np.int64) for k in (1, 2))
    m = np.array([25 + 75 * c[0] * documents // words for c in counted], np.int64)[of]
    part = weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
    many = index.first[at + 1] - index.first[at]
    posting = np.repeat(index.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
    out = np.zeros(len(counted) * index.items, np.int64)
    np.add.at(out, np.repeat(of, many) * index.items + index.item[posting], np.repeat(part, many) * index.times[posting])
    return out.reshape(len(counted), index.items)


def _heaps(documents: DataFrame, shared, weight: np.ndarray, n_documents: int, words: int, k: int) -> DataFrame:
    """``(item, id, score)``: the best ``k`` documents of each task for each item of the index."""

    def run(batches):
        index = shared.value
        heaps: list[list[tuple]] = [[] for _ in range(index.items)]
        least = np.ones(index.items, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_DOCUMENTS):
                ids = batch.column(0)[a : a + BLOCK_DOCUMENTS].to_pylist()
                counted = [index.counted(t.as_py()) for t in batch.column(1)[a : a + BLOCK_DOCUMENTS]]
                score = _scores(index, weight, counted, n_documents, words)
                for d, i in zip(*(x.tolist() for x in np.nonzero(score >= least))):
                    entry, heap = (int(score[d, i]), ids[d] is not None, -(ids[d] or 0)), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        rows = [(i, -negative if known else None, s) for i, heap in enumerate(heaps) for s, known, negative in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "id", "score"])

    return map_texts(documents.select("id", F.col("text").cast("binary")), run, "item bigint, id bigint, score bigint")


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item, ranked: first among some tasks, then among these."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    few = heaps.withColumn("part", F.floor(F.spark_partition_id() / MERGED_TASKS))
    for keys in (["item", "part"], ["item"]):
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return few.drop("part")


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` documents with the highest score above 0 of each item, equal scores by ascending id."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = saved(items.select(F.col(item_col).alias("own"), F.col(item_text).alias("text"))).select("*", F.monotonically_increasing_id().alias("row"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(64))).first()[0]
    blocks, out = math.ceil(size / BLOCK_BYTES), None
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").toArrow()
        index = spark.sparkContext.broadcast(Index(block.column("text").cast(pa.binary()).to_pylist()))
        n, words, holding = statistics(docs, index)
        best = _merged(_heaps(docs, index, weights(index.value, n, holding), n, max(1, words), k), k)
        rows = spark.createDataFrame(pa.table({"item": np.arange(len(block)), "row": block.column("row")}))
        named = best.join(F.broadcast(rows), "item").select("row", "rank", "id", "score")
        out = named if out is None else out.unionByName(named)
    found = out.join(known.select("row", "own"), "row")
    return found.select(F.col("own").alias(item_col), "rank", F.col("id").alias(id_col), "score")
