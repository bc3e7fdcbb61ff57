"""Periodic runs, lexical search and exact inner products against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import inner_product, lexical, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every maximal run by walking each period, in order of start and period."""
    out = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]


def test_runs_equal_brute_force_on_many_sequences():
    rng = np.random.default_rng(3)
    for t in range(600):
        w = rng.integers(0, rng.integers(1, 6), rng.integers(0, 120))
        if t % 3 == 0 and len(w) > 8:
            a = int(rng.integers(0, len(w)))
            w = np.concatenate([w[:a], np.resize(w[a : a + 1 + (len(w) - a) // int(rng.integers(3, 11))], len(w) - a)])
        assert sorted(map(tuple, periodic.runs_of(w.astype(np.int64)).tolist())) == brute_runs(w.tolist())


def test_runs_of_long_repetitive_sequences():
    same = periodic.runs_of(np.zeros(200_000, np.int64))
    assert same.tolist() == [[0, 200_000, 1]]
    w = np.resize(np.random.default_rng(1).integers(0, 9999, 7_000), 100_000)
    assert periodic.runs_of(w).tolist() == [[0, 100_000, 7_000]]


def edited(doc_id, words):
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op12_equals_brute_force_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        w = edited(r.doc_id, WORD.findall(texts[r.doc_id] or ""))
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(brute_collapsed(w, runs)).encode()).hexdigest()


def test_find_runs_of_odd_rows(spark):
    long = " ".join(random.Random(5).choices("abcdefgh", k=30)) + " x y z" * 50_000
    rows = [(1, None), (2, ""), (3, "\t \n"), (4, "a " * 9), (4, "a " * 9), (None, "a b " * 5), (5, long), (6, "a\u00a0b " * 7 + "\u2003")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("words", F.lit("clash"))
    found = periodic.find_runs(df, F.col("text"), ["id", "words"])
    out = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()]
    assert sorted(out[:5], key=str) == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), *[(4, 9, [(0, 9, 1)], "a")] * 2], key=str)
    assert (None, 10, [(0, 10, 2)], "a b") in out
    w = long.split()
    runs = brute_runs(w[:60])
    assert out[-2][2][-1][1:] == (150_000, 3) and len(out[-2][2]) == len(runs) and out[-2][3].split() == brute_collapsed(w[:60], [(s, n, p) for s, n, p in runs])
    assert out[-1] == (6, 8, [(0, 7, 1)], "a\u00a0b \u2003")  # only ASCII white space divides words
    assert periodic.find_runs(df.where("false"), F.col("text"), ["id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(df.withColumn("runs", F.lit(1)), F.col("text"), ["runs"])


def test_groups_of_documents_keep_their_own_runs(monkeypatch):
    monkeypatch.setattr(periodic, "GROUP_WORDS", 50)
    rows = [(i, " ".join(["a b c"] * (i % 7))) for i in range(60)]
    for (i, t), n, got, rest in zip(rows, *periodic._of_documents([t.encode() for _, t in rows])):
        want = brute_runs(t.split())
        assert n == len(t.split()) and got == want and rest.decode() == " ".join(brute_collapsed(t.split(), want))


# --- lexical search ---------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    cut = lambda t: term.findall((t or "").translate(lower))
    counted = [(d, Counter(cut(t))) for d, t in docs]
    n_docs, words = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c in counted:
            s = 0
            for t in cut(text):
                if c[t]:
                    m = 25 + 75 * c.total() * n_docs // words
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(1, "Bär bär BÄR the end"), (2, "the the the"), (3, None), (None, "the end of Ünits"), (4, ""), (5, "end"), (5, "end"), (6, "x" * 50_000 + " end"), (7, "the end " * 20_000), (8, "!!! ---")]
ITEMS = [(10, "The END"), (11, None), (12, ""), (13, "end end bär"), (13, "end end bär"), (None, "ünits of"), (14, "Ünits"), (15, "nothing")]


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 100])
def test_search_equals_brute_force_on_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("rank", F.lit(0))
    for k in (3, 10):
        got = sorted(map(tuple, lexical.ranked(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == brute_search(DOCS, ITEMS, k)


def test_search_without_documents_or_items(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical.ranked(docs.where("false"), items).count() == 0 == lexical.ranked(docs, items.where("false")).count()


def test_heaps_of_many_tasks_merge(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MERGED_TASKS", 2)
    rows = [(i, " ".join(random.Random(i).choices("a b c d e f".split(), k=1 + i % 9))) for i in range(300)]
    items = [(0, "a b"), (1, "f f e"), (2, "c")]
    got = lexical.ranked(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(rows, items)


# --- inner products ---------------------------------------------------------------------------------------------------


def brute_products(rows, k, every=20):
    valid = [(n, i, v) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in valid:
        if i is not None and i % every == 0:
            scored = sorted((-min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(v, u)))), j is None, j or 0) for m, j, u in valid if m != n)
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def products(spark, rows, k=20, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = inner_product.top_inner_products(df, lambda i: i % 20 == 0, k, **kw)
    return sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("shape", ["flat", "spread", "copies"])
def test_inner_products_equal_brute_force(spark, monkeypatch, shape):
    for name, value in (("LEAST_CHUNK", 40), ("QUERY_BLOCK", 7), ("TILE_QUERIES", 3), ("TILE_VECTORS", 16), ("GROWTH", 3)):
        monkeypatch.setattr(inner_product, name, value)
    rng = np.random.default_rng(7)
    x = rng.normal(0, 20, (400, 12))
    if shape == "spread":
        x *= rng.exponential(1, (400, 1)) * np.linspace(3, 0.1, 12)
    if shape == "copies":
        x[rng.random(400) < 0.4] = x[0]
    rows = [(int(i), v) for i, v in zip(rng.permutation(400), np.floor(x).tolist())]
    assert products(spark, rows, 5) == brute_products(rows, 5)


def test_inner_products_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 1.0]), (1, [3.0]), (2, []), (None, [1.0, 2.0, 5.0]), (3, [-1.0, -2.0]), (100, [0.0, 0.0])]
    assert products(spark, rows) == brute_products(rows, 20)
    assert products(spark, rows[:1]) == [] == products(spark, [(1, [1.0]), (2, [1.0])]) == products(spark, [(20, None)])


def test_inner_products_beyond_the_exact_range_of_doubles(spark):
    big = float(2**40)
    rows = [(20, [big + 1, 3.0, 1.0]), (1, [big, 1.0, 7.0]), (2, [big, 1.0, 8.0]), (3, [1.0, -big, 2.0]), (4, [big * big, 0.0, 0.0]), (40, [-big, 5.0, 1.0])]
    assert products(spark, rows, 4) == brute_products(rows, 4)


def test_equal_vectors_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(inner_product, "LEAST_CHUNK", 50)
    rows = [(i, [1.0, 1.0]) for i in range(400)]
    assert products(spark, rows, 3) == brute_products(rows, 3)
