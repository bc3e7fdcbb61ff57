import collections
import math
import os

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from courtside.llm import exact_dedup, pipeline, queries, sharding, simhash

ODD = [(0, "a b c"), (1, "A B  C"), (2, None), (3, ""), (4, "abc"), (4, "abc"), (5, "word " * 30_000), (6, "word " * 30_000 + " "), (7, "é x"), (8, " \t"), (9, "a b c d e f")]


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")


def brute_fingerprint(text, size=3):
    words = [w for w in words_of(text) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            parent[b] = a
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def test_simhash_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(i + 100_000, t) for i, t in dict(ODD).items()], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs.withColumns({"fp": F.lit(1), "component_id": F.lit("x")})).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_simhash_keeps_rows_without_an_id(spark):
    """Such a row is returned, and links others; its component is null only if no row of it has an id."""
    words = [f"w{i}" for i in range(400)]
    base = brute_fingerprint(" ".join(words))
    steps, at = [words], base
    for i in range(400):
        changed = [*steps[-1]]
        changed[i] = "x"
        if (f := brute_fingerprint(" ".join(changed))) != at and bin(f ^ at).count("1") <= 2:
            steps.append(changed)
            at = f
            if bin(f ^ base).count("1") > 2:
                break
    texts = [" ".join(s) for s in steps]
    rows = [(5, texts[0])] + [(None, t) for t in texts[1:-1]] + [(9, texts[-1]), (None, "alone without an id"), (None, "alone without an id"), (9, "another text")]
    assert bin(brute_fingerprint(texts[0]) ^ brute_fingerprint(texts[-1])).count("1") > 2
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(set)
    for r in got:
        of[r.fingerprint].add(r.component_id)
    assert all(of[f"{brute_fingerprint(t):016x}"] == {5} for t in texts)
    assert of[f"{brute_fingerprint('alone without an id'):016x}"] == {None} and of[f"{brute_fingerprint('another text'):016x}"] == {9}
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_find_every_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    # the fingerprints themselves are the nodes
    fps = {int(f.view(np.int64)): int(f) for f in np.concatenate([base, near])}
    table = spark.createDataFrame([(i,) for i in fps], "fp long").withColumn("key", simhash.quarter_counts(F.col("fp")))
    pairs = simhash.tile_pairs(simhash.tiles(table, "key", ["fp"]), "key", simhash._near_counts(F.col("key"), 4, 16, 2))
    got = {frozenset((r.src, r.dst)) for r in simhash.links(pairs, 2).collect()}
    want = brute_components(fps)
    groups = collections.Counter(want.values())
    assert len(got) >= sum(n - 1 for n in groups.values()) and all(want[a] == want[b] for a, b in map(tuple, got))


def test_near_dedup_leaves_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    texts, i = {}, 0
    for _ in range(12):
        source = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts[i] = " ".join(source)
        for k in range(int(rng.integers(0, 9))):
            copy = list(source)
            copy[int(rng.integers(0, 200))] = "changed"
            texts[i + 1 + k] = " ".join(copy)
        i += 20
    texts |= {900: None, 901: "", 902: "one two", 903: "one two", 904: "one two three"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "kept", "x")], "doc_id long, text string, n string")
    sets = {i: {*simhash.shingle_hashes(t, 5).tolist()} for i, t in texts.items()}
    alike = lambda a, b: (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    out = simhash.near_dedup(df)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns and None in kept
    kept = [i for i in kept if i is not None]
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    for i in texts:
        if i not in kept:
            assert any(alike(i, j) for j in texts if j != i)
    assert simhash.near_dedup(df.limit(0)).count() == 0
    assert simhash.near_dedup(df.where("doc_id in (0, 20)")).count() == 2


def test_near_dedup_groups_are_components(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]

    def chain(ids, at=0):
        text = words(200)
        for k, i in enumerate(ids):
            yield i, " ".join(text)
            text[at + 15 * k : at + 15 * (k + 1)] = words(15)

    texts = dict(chain([1, 11, 2, 12, 3])) | dict(chain([108, 103, 101, 107, 102, 106, 104, 105]))
    # two dense centres whose copies a bridge of single texts joins
    bridge = dict(chain([250, 201, 240, 202, 251]))
    texts |= bridge
    for k, centre in enumerate((250, 251)):
        for c in range(12):
            copy = bridge[centre].split()
            copy[150 + 4 * c] = "changed"
            texts[260 + 20 * k + c] = " ".join(copy)
    texts |= {400 + k: " ".join(words(200)) for k in range(5)}
    sets = {i: {*simhash.shingle_hashes(t, 5).tolist()} for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {root(i) for i in texts} == {1, 101, 201, 400, 401, 402, 403, 404}
    out = simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == sorted({root(i) for i in texts})


def test_near_dedup_recall_of_the_fingerprints(spark):
    """How many pairs of a similarity of 0.8 or more the radius proposes, by the size of the sets."""
    rng = np.random.default_rng(11)
    for n, least in ((1, 1.0), (2, 1.0), (4, 0.99), (5, 0.99), (8, 0.99), (12, 0.99), (30, 0.995), (200, 0.998), (2000, 0.998)):
        caught, tried = 0, 60 if n > 500 else 400
        for _ in range(tried):
            # the hardest pairs: as few shared shingles as a similarity of 0.8 allows
            shared = -(-8 * n // 10)
            own = min(n - shared, int(shared / 0.8) - n) if int(shared / 0.8) > n else 0
            h = rng.integers(0, 2**64, n + max(0, own), dtype=np.uint64)
            a, b = np.unique(h[:n]), np.unique(np.concatenate([h[:shared], h[n : n + max(0, own)]]))
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
            apart = np.bitwise_count(simhash.fingerprint(a, 4) ^ simhash.fingerprint(b, 4)).sum()
            caught += apart <= max(simhash._radius(np.array([len(a)])), simhash._radius(np.array([len(b)])))
        assert caught / tried >= least, (n, caught / tried)


def test_near_dedup_verifies_a_family_below_the_threshold(spark):
    """Texts that share a template, close in bits but not similar enough, stay; a few real copies among them go."""
    rng = np.random.default_rng(13)
    template = [f"t{i}" for i in range(200)]

    def filled(seed):
        r = np.random.default_rng(seed)
        out = list(template)
        for at in r.choice(40, 9, replace=False) * 5:
            out[at] = f"v{r.integers(0, 10**9)}"
        return out

    texts = {i: filled(i) for i in range(150)}
    for i in range(0, 150, 15):
        copy = list(texts[i])
        copy[int(rng.integers(0, 200))] = "changed"
        texts[1000 + i] = copy
    sets = {i: {*simhash.shingle_hashes(" ".join(t), 5).tolist()} for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {root(i) for i in texts}
    assert 100 < len(want) < len(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == want
    old = simhash.PART_ROWS, simhash.TILE
    try:
        simhash.PART_ROWS, simhash.TILE = 16, 64  # several tiles a band and several parts a cell
        assert {r.doc_id for r in simhash.near_dedup(df).collect()} == want
    finally:
        simhash.PART_ROWS, simhash.TILE = old


def test_stages_keep_one_row_of_each_group_with_repeated_ids(spark):
    text = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 100_000, 100))
    a, b, c, d, e = (text(s) for s in range(5))
    rows = [(1, a), (2, a), (2, b), (2, b), (2, b + " "), (3, c), (3, d), (None, e), (None, e), (None, a), (4, "x " + d), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(pipeline.STAGES)
    exact = sorted(map(repr, (tuple(r) for r in stages["exact dedup"](spark, df, None).collect())))
    assert exact == sorted(map(repr, [(1, a), (2, b + " "), (3, c), (3, d), (None, e), (4, "x " + d), (7, None)]))
    near = [tuple(r) for r in stages["simhash near-dedup"](spark, df, None).collect()]
    assert {(i, (t or "").strip()) for i, t in near} == {(1, a), (2, b), (3, c), (3, d), (None, e), (7, "")} and len(near) == 6
    alone = spark.createDataFrame([(5, a), (5, a), (5, b), (None, c), (None, c)], df.schema)
    assert sorted(map(repr, (tuple(r) for r in stages["simhash near-dedup"](spark, alone, None).collect()))) == sorted(map(repr, [(5, a), (5, b), (None, c)]))


def test_binary_fuse_filter():
    for n in (1, 2, 3, 10, 1000, 40_000):
        keys = np.random.default_rng(n).integers(-(2**63), 2**63, n)
        row = exact_dedup.build_filter(keys)
        assert exact_dedup.may_contain(row, keys).all()
        other = np.random.default_rng(n + 1).integers(-(2**63), 2**63, 20_000)
        assert exact_dedup.may_contain(row, other).mean() < 0.02
        assert len(row[3]) <= max(64, 1.5 * n)


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\v\f\r")


def test_exact_dedup_against_brute_force(spark):
    rows = ODD + [(20 + i, "same  text" + " " * (i % 3)) for i in range(40)] + [(None, "abc"), (None, "lone")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, snapshot int")
    got = exact_dedup.exact_dedup(df, F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    by_text = {k: (min(v), len(v)) for k, v in groups.items()}
    assert len(got) == len(rows)
    import hashlib

    want = collections.Counter((i, None if by_text[normal(t)][0][1] else by_text[normal(t)][0][2], by_text[normal(t)][1], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by_text) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(df.limit(0), F.lit(None)).count() == 0
    assert exact_dedup.exact_dedup(df, F.lit(None)).count() == len(rows) == exact_dedup.exact_dedup(df, F.lit(0)).count()


def test_exact_dedup_with_repeated_ids(spark):
    """Of rows of one id the longer one stays, and one of rows that tie in everything."""
    rows = [(1, "a b c", 0), (1, "a bc", 0), (1, "a bc", None), (2, "x y", None), (2, "x y", None), (2, "x y", 1), (None, "x y", 0), (3, "alone", None), (3, "other", 1), (None, None, 1), (None, " ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = exact_dedup.exact_dedup(df, F.col("part")).collect()
    assert len(got) == len(rows)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter({r.text_sha256: 1 for r in got})
    assert sorted((r.group_size, r.keep_id) for r in got if r.kept and r.keep_id) == [(1, 3), (1, 3), (3, 1), (4, 2)]
    assert [(r.group_size, r.doc_id) for r in got if r.kept and r.keep_id is None] == [(2, None)]


@pytest.mark.parametrize("same_id", [None, 7])
def test_byte_check_is_linear_in_rows_of_one_id(spark, same_id):
    def rows(n):
        df = spark.createDataFrame([(same_id, f"text {i}", s) for i in range(n) for s in (0, None)], "doc_id long, text string, snapshot int")
        several = df.select(F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("sha")).distinct()
        ids = F.array_compact(F.array(F.lit(same_id).cast("long")))
        several = several.select("sha", ids.alias("ids"), F.lit(same_id is None).alias("nulls"))
        found = exact_dedup._side_texts(df, several, "doc_id", "text")
        plan = found.where("text <> ''")
        assert plan.count() == 2 * n
        return df, plan

    df, _ = rows(50)
    _, many = rows(400)
    assert many.groupBy("sha").count().where("count <> 2").count() == 0
    out = exact_dedup.exact_dedup(df, F.col("snapshot")).collect()
    assert len(out) == 100 and {r.group_size for r in out} == {2} and sum(r.kept for r in out) == 50


def test_one_row_each_is_the_same_in_every_run(spark):
    from courtside.llm.frames import one_row_each

    df = spark.createDataFrame([(1, "a", x) for x in range(40)], "doc_id long, text string, extra int")
    decided = spark.createDataFrame([(1, "a", True, 40)], "id long, digest string, kept boolean, copies int")
    found = {one_row_each(df.repartition(k), "doc_id", F.col("text"), decided, F.lit(0)).first().extra for k in (1, 3, 7)}
    assert len(found) == 1


def test_stored_filters_screen_a_later_batch(spark, tmp_path):
    known = spark.createDataFrame([(s, f"{i:064x}") for i in range(3000) for s in (0, 1) if i % 3 != s], "snapshot int, sha string")
    old = exact_dedup.KEYS_PER_BUCKET
    try:
        exact_dedup.KEYS_PER_BUCKET = 256
        exact_dedup.write_filters(known, str(tmp_path / "filters"))
    finally:
        exact_dedup.KEYS_PER_BUCKET = old
    stored = exact_dedup.read_filters(spark, str(tmp_path / "filters"))
    assert stored.groupBy("snapshot").count().where("count > 5").count() == 2
    batch = spark.createDataFrame([(f"{i:064x}",) for i in range(2000, 6000)], "sha string")
    passed = {(r.snapshot, int(r.sha, 16)) for r in exact_dedup.screen(batch, stored).collect()}
    real = {(s, i) for i in range(2000, 3000) for s in (0, 1) if i % 3 != s}
    assert real <= passed and len(passed - real) < 0.02 * 8000
    assert exact_dedup.screen(batch.limit(0), stored).count() == 0 == exact_dedup.screen(batch, stored.limit(0)).count()


def test_exact_dedup_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op9_exact_dedup']})").fetchall())
    assert sorted(tuple(r) for r in queries.op9_exact_dedup(spark, sf_dir).select(*names).collect()) == want


def test_sharding_table_and_placement(spark, sf_dir):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    share = collections.Counter(table)
    assert set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    assert sharding.lookup_table(["a"], 2) == [0, 0]
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    rows = queries.op5_sharding(spark, sf_dir).collect()
    full = sharding.lookup_table([f"shard-{i:03d}" for i in range(64)])
    docs = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        h = xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42)
        assert r.slot == (h - 2**64 if h >= 2**63 else h) % 65_537 and r.shard == full[r.slot]
    nulls = spark.createDataFrame([(None, 1), (5, 2), (5, 3)], "doc_id long, slot int")
    placed = sharding.place(nulls, shards, size=1009).collect()
    assert len(placed) == 3 and len({r.shard for r in placed if r.doc_id == 5}) == 1
    before, after = sharding.moved(spark.range(5000).withColumnRenamed("id", "doc_id"), shards, shards[:-1], size=1009).first()
    assert before == 5000 and 5000 / 7 * 0.8 < after < 5000 * 0.35
