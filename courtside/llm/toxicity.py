"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of its character 3- to 5-grams and itself, hashed into a fixed number of buckets; a text is the mean of
its words, a word the mean of its grams, each gram scaled by the inverse of its spread over texts and shrunk by how few
texts it occurs in (``t / (t + SHRINK_TEXTS)``), so that rare grams count at any size of the input. Embeddings and softmax
are trained together by gradient descent with momentum, in a fixed number of steps, from the whole sample.
Unseen spellings share grams with seen ones. With two classes and a linear head the embeddings come to one number a
bucket, which is what scoring uses: a word costs a cached look-up, and cached words are bounded in number.

The model is fitted on the driver to a bounded sample: about ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled texts at most,
picked by hash whatever their length and learned from whole. The texts' bags are made by tasks, written and weighed; the
driver gets six bytes a distinct gram of a text and ``MOST_BYTES`` at most: of a heavier sample, a share by hash that
fits. Training reads them in blocks without copying. Intercepts are moved to the labels' true rate.

Null and empty texts get the score of the prior alone; texts of any length are read whole; several labels of one
document count by their maximum, and any label above 0 is 1; repeated rows each get a row; ids may be null; an empty
table gives an empty result; without labels of both kinds every score is the known rate of
toxic labels (0 if there are none); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.frames import hash_sample, map_texts, quoted, with_fields
from courtside.plans.storage import remove, saved, shared_folder, small_side

BUCKETS, DIMENSIONS, GRAMS = 1 << 16, 4, (3, 4, 5)
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 2500, 4500, 192 << 20
#: Texts that a gram must occur in to be learned from, and those at which it counts half; steps (chosen by
#: :func:`fold_f1` among texts that may be learned from), rate, momentum and penalty of the descent; texts in a block.
LEAST_TEXTS, SHRINK_TEXTS, STEPS, RATE, MOMENTUM, PENALTY = 2, 10, 40, 30.0, 0.9, 1e-5
BLOCK_TEXTS = 64
THRESHOLD = 0.3
WORDS = re.compile(r"\w+")
#: Words whose weights a task keeps, and whose grams it hashes at a time.
CACHE_WORDS, NEW_WORDS = 1 << 17, 1 << 13


def held_out(id_: Column) -> Column:
    """Whether a document's label may not be learned from: a fixed quarter by checksum of the id."""
    return F.crc32(id_.cast("string")) % 4 == 2


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word's character grams and of the word itself, one word after the other, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    length = np.array([len(w) for w in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters of the word from here on
    of, buckets = [np.arange(len(words))], [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in marked], np.int64) % BUCKETS]
    rolled = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            of.append(word[at])
            mixed = (rolled[at] ^ rolled[at] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
    of, buckets = np.concatenate(of), np.concatenate(buckets)
    return buckets[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text: the mean over its words of the mean over each word's grams."""
    times = Counter(WORDS.findall((text or "").lower()))
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, sizes = word_grams([*times])
    share = np.array([*times.values()]) / times.total() / sizes
    dense = np.bincount(buckets, np.repeat(share, sizes), minlength=BUCKETS)
    at = np.flatnonzero(dense)
    return at.astype(np.int32), dense[at].astype(np.float32)


def scales(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``(scale, centre)`` of each bucket: the inverse of its spread over the texts, shrunk by how few hold it, and its scaled mean."""
    texts, mean, square = (np.zeros(BUCKETS) for _ in range(3))
    for at, weight in bags:
        texts[at] += 1
        mean[at] += weight
        square[at] += weight * weight
    mean /= len(bags)
    spread = np.sqrt(np.maximum(square / len(bags) - mean**2, 1e-18))
    scale = np.where(texts >= LEAST_TEXTS, texts / np.maximum(texts + SHRINK_TEXTS, 1) / np.maximum(spread, 1e-9), 0.0)
    scale /= max(1.0, np.sqrt((scale > 0).sum()))
    return scale, mean * scale


def linear(params: list[np.ndarray], scale: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, float]:
    """``(weight of each bucket, intercept)``: of two classes only the difference counts, so embeddings and head come to one number a bucket."""
    inner, outer, bias = params
    direction = outer[:, 1] - outer[:, 0]
    return (inner * scale[:, None]) @ direction, float(bias[1] - bias[0] - centre @ (inner @ direction))


def loss_and_gradients(params: list[np.ndarray], bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: np.ndarray, centre: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean loss with the penalty on embeddings, and its gradients.

    Texts are read in blocks, so memory beyond the bags themselves follows a block.
    """
    inner, outer, _ = params
    weights, intercept = linear(params, scale, centre)
    total, pull, loss = 0.0, np.zeros(BUCKETS), 0.0
    for k in range(0, len(y), BLOCK_TEXTS):
        block, of = bags[k : k + BLOCK_TEXTS], y[k : k + BLOCK_TEXTS]
        at, weight = (np.concatenate([b[c] for b in block]) for c in (0, 1))
        row = np.repeat(np.arange(len(block)), [len(b[0]) for b in block])
        odds = np.clip(intercept + np.bincount(row, weights[at] * weight, minlength=len(block)), -500, 500)
        loss += np.logaddexp(0, np.where(of == 1, -odds, odds)).sum()
        error = (1 / (1 + np.exp(-odds)) - of) / len(y)
        total += error.sum()
        pull += np.bincount(at, error[row] * weight, minlength=BUCKETS)
    pull = pull * scale - centre * total
    direction, sides = outer[:, 1] - outer[:, 0], np.array([-1.0, 1.0])
    grads = [PENALTY * inner + np.outer(pull, direction), np.outer(inner.T @ pull, sides), total * sides]
    return loss / len(y) + PENALTY / 2 * (inner**2).sum(), grads


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """``(weight of each bucket, intercept)`` of the log-odds of label 1, after ``STEPS`` steps from small random embeddings."""
    rng = np.random.default_rng(seed)
    scale, centre = scales(bags)
    inner = rng.normal(0, 1e-3, (BUCKETS, DIMENSIONS))
    outer = rng.normal(0, 1, (DIMENSIONS, 2))
    outer -= outer.mean(1, keepdims=True)
    outer /= np.linalg.norm(outer)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    params = [inner, outer, np.log(np.array([1 - rate, rate]))]
    speed = [np.zeros_like(p) for p in params]
    for _ in range(STEPS):
        _, grads = loss_and_gradients(params, bags, y, scale, centre)
        for k, (g, step) in enumerate(zip(grads, (RATE, RATE / 100, 0.5))):
            speed[k] = MOMENTUM * speed[k] - step * g
            params[k] += speed[k]
    return linear(params, scale, centre)


def fold_f1(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, folds: np.ndarray) -> float:
    """How well each fold's label 1 is found by what the other folds teach: the harmonic mean of precision and recall at ``THRESHOLD``.

    This is what parameters are chosen by; held-out labels are no part of it.
    """
    said = np.zeros(len(y), bool)
    for k in np.unique(folds):
        own = np.flatnonzero(folds == k)
        rest = np.flatnonzero(folds != k)
        weights, intercept = train([bags[i] for i in rest], y[rest])
        said[own] = [intercept + float(weights[at] @ weight) >= np.log(THRESHOLD / (1 - THRESHOLD)) for at, weight in (bags[i] for i in own)]
    hits = int((said & (y == 1)).sum())
    return 2 * hits / max(1, int(said.sum()) + int(y.sum()))


def _within(rows: DataFrame, most: int) -> DataFrame:
    """Written bags ``(id, y, at, weight)`` of ``most`` bytes together, about: all, or a share by hash of the id."""
    size = rows.agg(F.coalesce(F.sum(6 * F.size("at") + 16), F.lit(0))).first()[0]
    return rows if size <= most else hash_sample(rows, "id", most, size, salt=8)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = saved(known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return np.zeros(BUCKETS), 30.0 if n and toxic == n else -30.0
    picked = [hash_sample(known.where(F.col("y") == y), "id", most, rows) for y, most, rows in ((1, MOST_TOXIC, toxic), (0, MOST_CLEAN, n - toxic))]
    sample = small_side(picked[0].unionByName(picked[1]))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")

    def run(batches):
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column(1)]
            # bucket numbers are 16 bits wide; Spark has signed ones only
            at = pa.array([b[0].astype(np.uint16).view(np.int16) for b in bags], pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], at, pa.array([b[1] for b in bags], pa.list_(pa.float32()))], names=["id", "y", "at", "weight"])

    spark = documents.sparkSession
    path = posixpath.join(shared_folder(spark), f"bags-{uuid.uuid4().hex}")
    map_texts(texts.select("id", "text", "y"), run, with_fields(texts, ["id"], "y: int, at: array<smallint>, weight: array<float>")).write.parquet(path)
    rows = _within(spark.read.parquet(path), MOST_BYTES).select("y", "at", "weight").toArrow()
    remove(spark, path)
    y = rows.column("y").to_numpy().astype(np.int64)
    if len({*y.tolist()}) < 2:
        return np.zeros(BUCKETS), float(np.log(toxic / (n - toxic)))
    bags = []
    for batch in rows.to_batches():
        at, weight = batch.column(1), batch.column(2)
        bags += [(at[i].values.to_numpy().view(np.uint16), weight[i].values.to_numpy()) for i in range(batch.num_rows)]
    weights, intercept = train(bags, y)
    del rows, batch, bags, at, weight
    pa.default_memory_pool().release_unused()
    return weights, float(intercept + np.log(toxic / (n - toxic)) - np.log(y.mean() / (1 - y.mean())))


def score(documents: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score, a double of the given name, for every row."""
    shared = documents.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # BUCKETS numbers

    def run(batches):
        weights, intercept = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, BLOCK_TEXTS):
                texts = [WORDS.findall((t.as_py() or "").lower()) for t in batch.column(len(keep))[k : k + BLOCK_TEXTS]]
                new = [*{w for words in texts for w in words if w not in known}]
                if len(known) + len(new) > CACHE_WORDS:
                    known = {w: known[w] for words in texts for w in words if w in known}
                for at in range(0, len(new), NEW_WORDS):
                    some = new[at : at + NEW_WORDS]
                    buckets, sizes = word_grams(some)
                    known.update(zip(some, (np.add.reduceat(weights[buckets], np.cumsum(sizes) - sizes) / sizes).tolist()))
                odds = [intercept + sum(map(known.__getitem__, words)) / max(1, len(words)) for words in texts]
                out += (1 / (1 + np.exp(-np.clip(odds, -500, 500)))).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], names=[*keep, name])

    return map_texts(documents.select(*quoted(keep), F.col(text_col).alias("__text")), run, with_fields(documents, keep, f"{name}: double"))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every document."""
    scored = score(documents, fit(documents, labels, id_col, text_col, label_col), [id_col], text_col)
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
