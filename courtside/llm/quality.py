"""Quality classifier: document evidence combined with shrunken host and path posteriors (hierarchical empirical Bayes).

1. A text's evidence is a dozen ratios (byte classes, words, repeated lines) and the share of its words in each of
   ``TOKEN_BUCKETS`` hash buckets, which stand for the words themselves.
2. A logistic regression on these is fitted by Newton steps to a bounded sample of labelled rows (about ``MOST_ROWS`` rows
   of numbers at most, picked by hash), so the driver's work does not follow the corpus. One pass over all texts then
   gives each document its log-odds; the numbers behind them are not kept.
3. Grouped aggregation counts labels by path and by host. A host's rate shrinks toward the global rate, a path's toward
   its host's; how strongly is estimated from the spread of the rates over groups (method of moments). Sites with few
   labels stay close to the prior, unlabelled ones get it whole. A labelled document's own label is left out of the
   rates that judge it.
4. The score adds, in log-odds, the path's posterior and what the text says beyond the global rate.

The tables of rates are counted and broadcast only below the bound of ``small_side``; beyond it the joins shuffle, with a
hot host split by adaptive execution. Null texts count as empty, texts without words say nothing (their text score is the
global rate), texts of any length are read whole, null hosts and paths are one group each, several labels of one
document count by their maximum, rows that repeat an id each get a row, ids may be null, an empty table gives an empty
result, without any label every score is 0.5, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.frames import hash_sample, map_texts, quoted, with_fields
from courtside.plans.storage import saved, small_side

#: Labelled rows that the classifier is fitted to, at most (about), and its ridge penalty.
MOST_ROWS, RIDGE = 20_000, 1.0
#: Hash buckets of words; what a word share is multiplied by, and its ridge penalty.
TOKEN_BUCKETS, TOKEN_SCALE, TOKEN_RIDGE = 256, 16.0, 300.0
FEATURES = ["log_words", "word_length", "distinct_words", "repeated_lines", "line_length", "lower", "upper", "digits", "stops", "symbols", "other_punctuation", "beyond_ascii"]


def _class(pattern: bytes) -> np.ndarray:
    return np.array([bool(re.match(pattern, bytes([b]))) for b in range(256)])


CLASSES = np.stack([_class(p) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[.,;:!?]", rb"[#%*&$|<>{}=@\\^~_+]", rb"[()\[\]\"'/`-]", rb"[\x80-\xff]")])


def text_features(text: str | None) -> list[float]:
    """The ratios of one text, in the order of ``FEATURES``; all zero for a text without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = sum(map(len, words))
    shares = CLASSES @ counts / solid
    return [float(np.log(len(words))), solid / len(words), len(set(words)) / len(words) ** 0.9, 1 - len(set(lines)) / len(lines), float(np.log(solid / len(lines))), *shares.tolist()]


def token_shares(text: str | None) -> np.ndarray:
    """The root of the share of a text's words, in lower case, in each hash bucket."""
    times = Counter((text or "").lower().encode().split())
    at = np.fromiter((zlib.crc32(w) % TOKEN_BUCKETS for w in times), np.int64, len(times))
    return np.sqrt(np.bincount(at, np.fromiter(times.values(), float, len(times)), minlength=TOKEN_BUCKETS) / max(1, times.total()))


def evidence(text: str | None) -> np.ndarray:
    """All numbers of one text: its ratios, then its token shares."""
    return np.concatenate([text_features(text), token_shares(text)])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, for raw evidence."""
    width = len(FEATURES) + TOKEN_BUCKETS
    if len(set(y.tolist())) < 2:
        return np.zeros(width), 0.0
    mean = x.mean(0)
    scale = np.concatenate([x[:, : len(FEATURES)].std(0) + 1e-9, np.full(TOKEN_BUCKETS, 1 / TOKEN_SCALE)])
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(width + 1), np.diag([RIDGE] * len(FEATURES) + [TOKEN_RIDGE] * TOKEN_BUCKETS + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mean)


def _sample(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The evidence of the texts of ``(text, y)``, made by tasks, and the labels."""

    def run(batches):
        for batch in batches:
            rows = [evidence(t.as_py()).astype(np.float32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32())), batch.column(1)], names=["x", "y"])

    rows = map_texts(texts.select("text", "y"), run, "x array<float>, y int").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, len(FEATURES) + TOKEN_BUCKETS))
    return x.astype(np.float64), rows.column("y").to_numpy().astype(np.int64)


def text_logits(df: DataFrame, keep: list[str], model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``logit double``, null for texts without words: the log-odds of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(batches):
        weights, intercept = shared.value
        for batch in batches:
            logits = []
            for t in batch.column(len(keep)):
                x = evidence(t.as_py())
                logits.append(float(x @ weights + intercept) if x[1] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(logits, pa.float64())], names=[*keep, "logit"])

    return map_texts(df.select(*quoted(keep), F.col(text_col).alias("__text")), run, with_fields(df, keep, "logit: double"))


def _log_odds(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(clipped / (1 - clipped))


def _strength(groups: DataFrame, rate: Column) -> Column:
    """Prior strength by the method of moments: pseudo-counts that explain how the groups' rates spread around ``rate``."""
    n, spread = F.sum("n"), F.sum(F.pow(F.col("k") / F.col("n") - rate, 2) * F.col("n"))
    noise = F.sum(rate * (1 - rate))
    between = F.greatest((spread - noise) / F.nullif(n - F.sum(F.col("n") * F.col("n")) / n, F.lit(0.0)), F.lit(1e-9))
    return F.least(F.greatest(F.coalesce(F.avg(rate * (1 - rate)) / between - 1, F.lit(10.0)), F.lit(1.0)), F.lit(1e4))


def quality_scores(documents: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_from: Column | None = None) -> DataFrame:
    """``(id_col, text_score, host_rate, path_rate, score, predicted)`` for every document.

    ``learn_from`` says which labelled rows may be learned from (all if None).
    """
    base = documents.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.where(learn_from) if learn_from is not None else known
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    # one sample join: broadcast if small, and only its texts are measured twice
    n = (known := saved(known)).count()
    model = fit(*_sample(base.join(small_side(hash_sample(known, "id", MOST_ROWS, n)), "id")))
    rows = saved(text_logits(base, ["id", "host", "path"], model).join(known, "id", "left"))
    labelled = rows.where("y is not null")
    logit = F.col("logit")

    paths = saved(labelled.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("k")))
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = hosts.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.5)).alias("rate")).first()["rate"]
    host_strength = hosts.agg(_strength(hosts, F.lit(total)).alias("s")).first()["s"]
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_k"), ((F.col("k") + host_strength * total) / (F.col("n") + host_strength)).alias("host_rate"))
    path_strength = paths.join(shrunk, "host").agg(_strength(paths, F.col("host_rate")).alias("s")).first()["s"]

    joined = rows.join(small_side(shrunk), "host", "left").join(small_side(paths.select("host", "path", F.col("n").alias("path_n"), F.col("k").alias("path_k"))), ["host", "path"], "left")
    own, own_y = F.when(F.col("y").isNull(), 0.0).otherwise(1.0), F.coalesce(F.col("y"), F.lit(0)).cast("double")
    count = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    host_rate = (F.greatest(count("host_k") - own_y, F.lit(0.0)) + host_strength * total) / (F.greatest(count("host_n") - own, F.lit(0.0)) + host_strength)
    scored = joined.withColumn("host_rate", host_rate)
    path_rate = (F.greatest(count("path_k") - own_y, F.lit(0.0)) + path_strength * F.col("host_rate")) / (F.greatest(count("path_n") - own, F.lit(0.0)) + path_strength)
    scored = scored.withColumn("path_rate", path_rate).withColumn("text_score", F.when(logit.isNull(), F.lit(total)).otherwise(1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-6.0)), F.lit(6.0))))))
    score = 1 / (1 + F.exp(-(_log_odds(F.col("path_rate")) + _log_odds(F.col("text_score")) - _log_odds(F.lit(total)))))
    return scored.select(F.col("id").alias(id_col), "text_score", "host_rate", "path_rate", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
