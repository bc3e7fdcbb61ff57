import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from courtside.llm import bpe, queries, token_counts

ODD = ["", " ", "  a  b ", "don't  we'll\n\n x\t", "a<|endoftext|>b <|endoftext|>", "é你好 \U0001f600\U0001f600  x y\x85z", "\x1c a\x1d\x1eb", "1234 5٤٥", "x" * 3000, "ab " * 500, "...!!! --- 'S 's", "́​ ﻿", "\r\n \r\n", "é 가"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_equals_library(spark, library):
    own = bpe.ByteBpe.from_json(open(bpe.default_vocabulary(), encoding="utf-8").read())
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = own.encode(text)
        assert got == want.ids, text[:80]
        assert own.decode(got) == library.decode(got, skip_special_tokens=False)


def test_query_equals_library_on_the_whole_table(spark, library, sf_dir):
    """Length and both digests of every document, and of odd texts, nulls and a very long one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*ODD, None, "long text 12 " * 20_000])], "doc_id long, text string")
    texts = {r.doc_id: r.text or "" for r in docs.union(odd).collect()}
    want = {}
    for i, e in zip(texts, library.encode_batch([*texts.values()], add_special_tokens=False)):
        want[i] = (len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
    got = [*queries.op2_bpe(spark, sf_dir).collect(), *bpe.round_trip_digests(odd).collect()]
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_decode_of_partial_bytes(library):
    own = bpe.ByteBpe.from_json(open(bpe.default_vocabulary(), encoding="utf-8").read())
    ids = own.encode("\U0001f600你")[:-1]
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_operator_on_nulls_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "hi hi", "c"), (None, "hi hi", "d")], "doc_id long, text string, n_tokens string")
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, 0, empty, empty) in rows and (2, 0, empty, empty) in rows and len(rows) == 4
    back = bpe.decode(bpe.encode(df))
    assert sorted(r.text for r in back.collect()) == ["", "", "hi hi", "hi hi"]
    assert bpe.round_trip_digests(df.limit(0)).count() == 0


def test_token_counts_against_brute_force(spark, library, sf_dir):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    n = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = queries.op1_token_counts(spark, sf_dir).collect()
    assert {r.n_tokens for r in rows} == set(n) and sum(r.docs for r in rows) == len(n)
    for r in rows:
        assert r.docs_at_most == sum(x <= r.n_tokens for x in n) and r.docs_over == len(n) - r.docs_at_most
        assert r.tokens_over == sum(x for x in n if x > r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    histogram = token_counts.length_histogram(spark.createDataFrame([("a b",), ("a b",), (None,)], "text string"))
    assert [tuple(r) for r in token_counts.truncated_totals(histogram, [0, 1, 9]).collect()] == [(0, 0, 2), (1, 2, 2), (9, 4, 0)]
    assert [tuple(r) for r in token_counts.length_quantiles(token_counts.context_table(histogram), [0.3, 1.0]).collect()] == [(0.3, 0), (1.0, 2)]
    assert token_counts.context_table(histogram.limit(0)).count() == 0


def test_every_character_is_cut_alike():
    own = bpe.ByteBpe.from_json(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for c in (chr(i) for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000):
        text = f"a{c}b {c}1 {c}{c}."
        assert own.encode(text) == own_by_slow_pattern(own, text), hex(ord(c))


def own_by_slow_pattern(own, text):
    return [i for word in own.pre_token.findall(text) for i in own.merge([own.of_byte[b] for b in word.encode()])]
