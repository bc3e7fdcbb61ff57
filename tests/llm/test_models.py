import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from courtside.llm import language_id, pipeline, quality, queries, simhash, toxicity


def auc(scores, y):
    rank = np.argsort(np.argsort(scores)) + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_finds_unseen_misspellings(spark):
    rng = np.random.default_rng(1)
    common = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu", "mo") for b in ("ran", "tes", "lin", "kor", "pun")]
    bad = ["wretched", "vile"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, int(rng.integers(5, 60))))
        toxic = i % 4 == 0
        if toxic:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(1001, "baran detes wretchedd lukor", "x"), (1002, "baran detes lukor", "x"), (1003, None, "x"), (1004, "", "x"), (1004, "", "x"), (None, "baran", "x")]
    labels += [(0, 0), (None, 1), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    by = {r.doc_id: r for r in out}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert by[1001].score > 0.5 > 0.3 > by[1002].score
    held = [i for i in range(600) if by[i].held_out]
    assert auc(np.array([by[i].score for i in held]), np.array([int(i % 4 == 0) for i in held])) > 0.95
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(df, none).collect()} == {0}
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def slow_grams(word):
    """A word's buckets, one character n-gram at a time."""
    marked, out = f"<{word}>", [zlib.crc32(f"<{word}>".encode()) % toxicity.BUCKETS]
    for n in toxicity.GRAMS:
        for i in range(len(marked) - n + 1):
            h = ord(marked[i])
            for c in marked[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.append(((h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * n) % 2**64 >> 40) % toxicity.BUCKETS)
    return out


def test_toxicity_gradients_by_finite_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 64)
    monkeypatch.setattr(toxicity, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(toxicity, "PENALTY", 0.01)
    rng = np.random.default_rng(4)
    bags = [toxicity.bag(" ".join(f"w{x}" for x in rng.integers(0, 9, 6))) for _ in range(10)] + [toxicity.bag(None)]
    y = rng.integers(0, 2, 11)
    scale, centre = toxicity.scales(bags)
    params = [rng.normal(0, 1, s) for s in ((64, 3), (3, 2), 2)]
    _, grads = toxicity.loss_and_gradients(params, bags, y, scale, centre)
    for k, p in enumerate(params):
        for at in [tuple(rng.integers(0, d) for d in p.shape) for _ in range(8)]:
            sides = []
            for step in (1e-5, -1e-5):
                moved = [q.copy() for q in params]
                moved[k][at] += step
                sides.append(toxicity.loss_and_gradients(moved, bags, y, scale, centre)[0])
            assert abs((sides[0] - sides[1]) / 2e-5 - grads[k][at]) < 1e-6
    # the loss is that of embeddings averaged over grams and words, centred, in a softmax of two classes
    loss = toxicity.PENALTY / 2 * (params[0] ** 2).sum()
    for (at, weight), label in zip(bags, y):
        x = np.zeros(64)
        x[at] = weight
        logits = ((x * scale - centre) @ params[0]) @ params[1] + params[2]
        loss += (np.log(np.exp(logits).sum()) - logits[label]) / len(y)
    assert abs(loss - toxicity.loss_and_gradients(params, bags, y, scale, centre)[0]) < 1e-9


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, 0, [1] * (i % 50), [0.5] * (i % 50)) for i in range(2000)]
    made = spark.createDataFrame(rows, "id long, y int, at array<smallint>, weight array<float>")
    size = lambda df: sum(6 * len(r["at"]) + 16 for r in df.collect())
    whole = size(made)
    assert toxicity._within(made, whole).count() == 2000
    assert 0.8 * whole / 3 < size(toxicity._within(made, whole // 3)) < 1.2 * whole / 3
    first = toxicity.hash_sample(made, "id", 500, 2000)  # a sample of a sample shrinks too
    assert 0.3 * first.count() < toxicity._within(first, size(first) // 2).count() < 0.7 * first.count()
    docs = spark.createDataFrame([(i, ("nice day " if i % 2 else "vile rot ") * 5) for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).alias("toxic"))
    monkeypatch.setattr(toxicity, "MOST_BYTES", 2000)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in toxicity.toxicity(docs, labels).collect())


def test_parameters_are_chosen_by_folds(monkeypatch):
    rng = np.random.default_rng(2)
    bags = [toxicity.bag(" ".join(rng.choice(["calm", "kind", "rain"], 9)) + (" vile" if k % 4 == 0 else "")) for k in range(120)]
    y = np.array([int(k % 4 == 0) for k in range(120)])
    assert toxicity.fold_f1(bags, y, rng.integers(0, 4, 120)) > 0.9
    assert toxicity.fold_f1(bags, rng.permutation(y), rng.integers(0, 4, 120)) < 0.7


def test_toxicity_scores_against_brute_force(spark, sf_dir):
    """Every document of the table by the definition, one gram at a time, from the fitted weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000, None), (9001, ""), (9002, "Ünïcode Ünïcode 🙂 x"), (9003, "long " * 50_000)], "doc_id long, text string"))
    weights, intercept = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert np.abs(weights).max() > 0
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weights, intercept), ["doc_id"]).collect()}
    known = {}
    for r in docs.collect():
        words = re.findall(r"\w+", (r.text or "").lower())
        for w in words:
            if w not in known:
                known[w] = np.mean(weights[slow_grams(w)])
        odds = intercept + (np.mean([known[w] for w in words]) if words else 0.0)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-odds))) < 1e-4
        at, weight = toxicity.bag(r.text)
        assert abs((weights[at] * weight).sum() + intercept - odds) < 1e-4


@pytest.mark.parametrize("sf, least_auc, least_precision, least_recall", [("sf0.01", 0.7, 0.4, 0.3), ("sf0.1", 0.9, 0.72, 0.55)])
def test_toxicity_on_held_out_labels(spark, sf, least_auc, least_precision, least_recall):
    folder = f"/root/testdata/{sf}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in queries.op7_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    y, predicted = np.array([labels[r.doc_id] for r in held]), np.array([r.predicted for r in held])
    caught = (y * predicted).sum()
    assert auc(np.array([r.score for r in held]), y) > least_auc
    assert caught / y.sum() > least_recall and caught / max(1, predicted.sum()) > least_precision


def test_toxicity_learns_from_long_texts_and_rare_words(spark):
    common = " ".join(f"plain{i}" for i in range(40))
    rows = [(i, f"{common} " * 40 + ("zyxwv " * 40 if i % 4 == 0 else "")) for i in range(60)]
    assert min(len(t) for _, t in rows) > 10_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.toxicity(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert len({r.doc_id % 4 == 0 for r in held}) == 2 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)


def test_quality_shrinks_sparse_sites(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(800):
        host = "good" if i % 2 else "bad"
        rows.append((i, " ".join(f"word{x}" for x in rng.integers(0, 50, 30)), host, "p" if i % 3 else None, "y"))
        labels.append((i, int(rng.random() < (0.9 if i % 2 else 0.2))))
    rows += [(900, None, "new", "p", "y"), (901, "", None, None, "y"), (902, "word1 word2", "once", "p", "y"), (902, "word1 word2", "once", "p", "y")]
    labels += [(902, 1), (902, 0), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, score string")
    out = {r.doc_id: r for r in quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    rate = np.mean([y for i, y in labels[:800]])
    assert out[1].score > 0.6 > 0.5 > out[0].score
    assert abs(out[900].path_rate - rate) < 0.05 and rate < out[902].path_rate < 0.85 and abs(out[900].text_score - rate) < 0.01
    assert abs(out[1].host_rate - 0.9) < 0.05 and abs(out[0].host_rate - 0.2) < 0.05
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.quality_scores(df, empty, F.col("host"), F.col("path")).collect())
    assert quality.quality_scores(df.limit(0), empty, F.col("host"), F.col("path")).count() == 0


def test_quality_against_brute_force(spark):
    """Rates, strengths and scores in plain Python from the text's log-odds, which are computed apart from the weights."""
    rng = np.random.default_rng(6)
    rows, labels = [], {}
    for i in range(400):
        host, path = f"h{rng.integers(0, 9)}", None if i % 11 == 0 else f"p{rng.integers(0, 4)}"
        text = " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 30))) + ("!" * (i % 5))
        rows.append((i, text, None if i % 37 == 0 else host, path))
        if i % 3:
            labels[i] = int(rng.random() < 0.3 + 0.05 * int(host[1]))
    rows += [(500, None, "h1", "p1"), (501, "word " * 40_000, "new", "p1"), (None, "no id", "h1", "p1"), (7, "repeated id", "h2", "p2")]
    df = spark.createDataFrame([(*r, 0.0, "x") for r in rows], "doc_id long, text string, host string, path string, logit double, y string")
    table = spark.createDataFrame([*labels.items(), (5, 0), (5, 1), (None, 1), (8, None)], "doc_id long, quality int")
    labels |= {5: 1}
    got = quality.quality_scores(df, table, F.col("host"), F.col("path")).collect()
    known = [(r, labels[r[0]]) for r in rows if r[0] in labels]
    x, y = np.array([quality.evidence(r[1]).astype(np.float32) for r, _ in known], float), np.array([v for _, v in known])
    weights, intercept = quality.fit(x, y)
    by_path, by_host = {}, {}
    for r, v in known:
        for table_, key in ((by_path, (r[2] or "", r[3] or "")), (by_host, r[2] or "")):
            n, k = table_.get(key, (0, 0))
            table_[key] = (n + 1, k + v)
    total = sum(k for _, k in by_host.values()) / sum(n for n, _ in by_host.values())

    def strength(groups):  # of (n, k, rate)
        n = sum(g[0] for g in groups)
        spread = sum((k / m - p) ** 2 * m for m, k, p in groups)
        noise = sum(p * (1 - p) for _, _, p in groups)
        between = max((spread - noise) / (n - sum(m * m for m, _, _ in groups) / n), 1e-9)
        return min(max(np.mean([p * (1 - p) for _, _, p in groups]) / between - 1, 1.0), 1e4)

    hs = strength([(n, k, total) for n, k in by_host.values()])
    shrunk = {h: (k + hs * total) / (n + hs) for h, (n, k) in by_host.items()}
    ps = strength([(n, k, shrunk[h]) for (h, _), (n, k) in by_path.items()])
    odds = lambda p: np.log(p / (1 - p))
    want = {}
    for i, text, host, path in rows:
        own = labels.get(i)
        hn, hk = by_host.get(host or "", (0, 0))
        pn, pk = by_path.get((host or "", path or ""), (0, 0))
        if own is not None:
            hn, hk, pn, pk = max(hn - 1, 0), max(hk - own, 0), max(pn - 1, 0), max(pk - own, 0)
        host_rate = (hk + hs * total) / (hn + hs)
        path_rate = (pk + ps * host_rate) / (pn + ps)
        logit = float(quality.evidence(text) @ weights + intercept)
        of_text = 1 / (1 + np.exp(-min(max(logit, -6), 6))) if (text or "").split() else total
        want[i, text] = (host_rate, path_rate, of_text, 1 / (1 + np.exp(-(odds(path_rate) + odds(of_text) - odds(total)))))
    texts = {(r[0], r[1]) for r in rows}
    assert len(got) == len(rows) == len(texts)
    for i in {r.doc_id for r in got}:
        mine = sorted((r.host_rate, r.path_rate, r.text_score, r.score) for r in got if r.doc_id == i)
        other = sorted(v for k, v in want.items() if k[0] == i)
        assert np.allclose(mine, other, atol=1e-5), (i, mine, other)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert auc(np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held])) > 0.8


def test_language_of_documents_and_pages(spark, sf_dir):
    out = queries.op10_language_id(spark, sf_dir).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pages = {r.page_id: r.html.split('lang="')[1][:2] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.doc_id for r in out if r.doc_id is not None} == set(docs) and {r.page_id for r in out if r.page_id is not None} == set(pages)
    held = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == docs[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.lang == pages[r.page_id] for r in out if r.page_id is not None]) > 0.95


def test_language_against_brute_force(spark):
    """Trigram counts, trust in declarations and host priors by plain Python dictionaries."""
    rng = np.random.default_rng(8)
    vocabulary = {lang: [f"{lang[0]}{chr(97 + x % 26)}{chr(97 + x // 26)}{lang[1]}" for x in range(60)] for lang in ("de", "en", "fr")}
    said = lambda lang, n: " ".join(rng.choice(vocabulary[lang] + vocabulary["en"][:20], n))
    train = [(lang, said(lang, int(rng.integers(1, 30)))) for lang in vocabulary for _ in range(30)] + [(None, "x"), ("en", None)]
    langs, table = language_id.likelihoods(spark.createDataFrame(train, "lang string, text string"), "lang", "text")

    def counts(text):
        data = b" " + b" ".join((text or "").lower().encode().split()) + b" "
        return Counter((((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1) % 2**32) >> 18 for i in range(len(data) - 2))

    of = {lang: Counter() for lang in vocabulary}
    for lang, text in train:
        if lang:
            of[lang] += counts(text)
    assert langs == ["de", "en", "fr"]
    p = [{b: np.log((of[lang][b] + 0.5) / (of[lang].total() + 0.5 * language_id.BUCKETS)) for b in range(language_id.BUCKETS)} for lang in langs]
    assert np.allclose(table, np.array([[q[b] for q in p] for b in range(language_id.BUCKETS)]))

    rows = []
    for i in range(120):
        lang = langs[i % 3]
        host = f"h{rng.integers(0, 6)}.{'x' if i % 2 else 'y'}.org"
        rows.append((i, said(lang, int(rng.integers(0, 12))) if i % 10 else None, lang if i % 4 else None, langs[int(rng.integers(0, 3))] if i % 5 else None, host if i % 7 else None, host[3:] if i % 7 else None))
    rows += [(200, said("fr", 60_000), "de", None, "h1.x.org", "x.org"), (None, said("en", 9), None, None, None, None), (3, said("de", 9), "xx", None, "h1.x.org", None)]
    df = spark.createDataFrame([(*r, 1.0, [0.0]) for r in rows], "id long, text string, declared string, suffix string, host string, domain string, post double, sums array<double>")
    got = {(r.id, n): r for n, r in enumerate(language_id.identify(df, ["id"], langs, table).collect())}
    soft = lambda v: np.exp(v - np.max(v)) / np.exp(v - np.max(v)).sum()
    ll, post = [], []
    for r in rows:
        c = counts(r[1])
        v = sum((n * table[b] for b, n in c.items()), np.zeros(3)) * min(1.0, 60 / max(1, c.total()))
        ll.append(v - v.max())
        post.append(soft(ll[-1]))
    share = (sum(post) + 1) / (sum(x.sum() for x in post) + 3)

    def trust(k):
        sums = {}
        for r, x in zip(rows, post):
            if r[k] is not None:
                sums[r[k]] = sums.get(r[k], 0) + x
        totals = sum(sums.values())
        return {v: np.log((x + 0.5) / (totals + 0.5 * (len(sums) + 1))) for v, x in sums.items()}

    declared, suffix = trust(2), trust(3)
    hosts, domains = {}, {}
    for r, x in zip(rows, post):
        if r[4] is not None:
            hosts[r[4], r[5]] = hosts.get((r[4], r[5]), 0) + x
            domains[r[5]] = domains.get(r[5], 0) + x
    want = {}
    for r, v, x in zip(rows, ll, post):
        prior = share
        if r[4] is not None:
            domain = np.maximum(domains[r[5]] - x, 0) + share * 20
            host = np.maximum(hosts[r[4], r[5]] - x, 0) + domain / domain.sum() * 5
            prior = host / host.sum()
        final = soft(v + np.log(prior) + declared.get(r[2], 0) + suffix.get(r[3], 0))
        want.setdefault(r[0], []).append((langs[int(final.argmax())], float(final.max())))
    assert len(got) == len(rows)
    for i, expected in want.items():
        mine = sorted((r.confidence, r.lang) for (k, _), r in got.items() if k == i)
        assert [lang for _, lang in mine] == [lang for lang, _ in sorted(expected, key=lambda e: e[1])]
        assert np.allclose([c for c, _ in mine], sorted(c for _, c in expected), atol=1e-9)


def test_language_without_text_follows_the_rest(spark):
    train = spark.createDataFrame([("en", "the cat and the dog")] * 5 + [("de", "der hund und die katze")] * 5 + [(None, "x"), ("en", None)], "lang string, text string")
    langs, table = language_id.likelihoods(train, "lang", "text")
    assert langs == ["de", "en"]
    rows = [(1, "der hund und", "de", None, "a.x.de", "x.de"), (2, None, "de", "de", "a.x.de", "x.de"), (3, "", None, None, None, None), (4, "the cat", None, None, "b", None), (5, "die katze und der hund", "de", "de", "a.x.de", "x.de"), (6, "the dog", "en", "en", "b", "b")]
    df = spark.createDataFrame(rows * 3, "id long, text string, declared string, suffix string, host string, domain string")
    got = {r.id: r for r in language_id.identify(df, ["id"], langs, table).collect()}
    assert [got[i].lang for i in (1, 2, 4, 5, 6)] == ["de", "de", "en", "de", "en"] and got[2].text_lang is None
    assert language_id.identify(df.limit(0), ["id"], langs, table).count() == 0
    nothing = language_id.likelihoods(train.limit(0), "lang", "text")
    assert {r.lang for r in language_id.identify(df, ["id"], *nothing).collect()} == {None}
    urls = spark.createDataFrame([("https://a.b.com/fr/1?x",), ("http://x.de",), ("nonsense",), (None,)], "u string")
    assert [r[0] for r in urls.select(language_id.address_suffix(F.col("u"), ["fr", "de"])).collect()] == ["fr", "de", None, None]


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Each stage on all that the stage before it kept, by plain Python over the same rows."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    word = re.compile(r"[^\W_]+")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    source = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    source += [(9000 + i, *r[1:]) for i, r in enumerate(source[:3])] + [(9100, "x " + " ".join(source[0][1].split()[:-1]), *source[0][2:]), (9200, None, "en", "s", 0)]
    docs = spark.createDataFrame(source, schema)
    by_name = dict(pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    frame = lambda kept: spark.createDataFrame([r for r in source if r[0] in kept], schema)

    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"]).collect()}
    clean = rows(by_name["toxicity"](spark, docs, sf_dir))
    assert set(clean) == {i for i, s in scores.items() if s < 0.3}

    groups = {}
    for i, t in clean.items():
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i))
    single = rows(by_name["exact dedup"](spark, frame(clean), sf_dir))
    assert set(single) == {min(g)[1] for g in groups.values()}

    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in single.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    apart = rows(by_name["simhash near-dedup"](spark, frame(single), sf_dir))
    assert not [p for p in pairs if set(p) <= set(apart)]
    assert set(single) - set(apart) <= {i for p in pairs for i in p}

    leaks = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        b = word.findall(r.text.lower())
        item = Counter(tuple(b[i : i + 5]) for i in range(max(1, len(b) - 4)))
        for i, t in apart.items():
            w = word.findall((t or "").lower())
            a = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
            if set(a) & set(item):
                windows = (Counter(a[k : k + item.total()]) for k in range(max(1, len(a) - item.total() + 1)))
                if any((x & item).total() >= 0.8 * (x | item).total() - 1e-12 for x in windows):
                    leaks.add(i)
    safe = rows(by_name["benchmark decontamination"](spark, frame(apart), sf_dir))
    assert set(safe) == set(apart) - leaks

    out = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in by_name["bpe encoding and decoding"](spark, frame(safe), sf_dir).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in safe.items()}
    assert out == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in want.items()}


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Nulls in any column, extra columns with the operators' own names, very long texts, and no rows at all."""
    names = ["score", "digest", "id", "band", "fp", "kept", "similarity", "name", "copies", "key", "sha", "t1", "n", "text_sha256"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    extra = tuple(f"e{i}" for i in range(len(names)))
    rows = [(1, "plain words of a text", "en", "s", 1, *extra), (None, None, None, None, None, *[None] * len(names)), (None, "another text without an id", None, "s", 3, *extra), (2, "", "en", None, 0, *extra), (3, "word " * 30_000, "en", "s", 5, *extra), (3, "word " * 30_000, "en", "s", 5, *extra)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0
        if stage is not pipeline.tokens:
            assert out.columns == docs.columns == none.columns
            got = out.collect()
            assert {r.text for r in got if r.text} == {r[1] for r in rows if r[1]}, name
            assert all(r.text_sha256 == "e13" and r.score == "e0" for r in got if r.doc_id == 1)
        else:
            assert out.count() == len(rows)


def test_pipeline_runs_as_a_whole(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0.5 * spark.read.parquet(f"{sf_dir}/documents.parquet").count() < out.count() == out.select("doc_id").distinct().count()
