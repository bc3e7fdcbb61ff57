"""Very long texts, empty tables and clashing names for operators whose other tests have none."""

import pytest
from pyspark.sql import functions as F

from courtside.llm import chat, language_id, sharding, token_counts


def test_token_counts_of_very_long_texts(spark):
    rows = [(1, "a " * 200_000), (2, "b"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("docs", F.lit("clash"))
    table = token_counts.context_table(token_counts.length_histogram(df)).orderBy("n_tokens").collect()
    assert [r.docs for r in table] == [2, 1, 1] and table[0].n_tokens == 0 and table[-1].n_tokens >= 200_000
    assert table[-1].docs_over == 0 and table[1].truncated_tokens == table[1].n_tokens * 2
    assert token_counts.context_table(token_counts.length_histogram(df.where("false"))).count() == 0


def test_threads_of_very_long_messages(spark):
    said = "\n".join(f"line {i} of a long message" for i in range(5_000))
    quoting = "\n".join("> " + x for x in said.split("\n")) + "\n\nI agree."
    df = spark.createDataFrame([(1, 0, "user", said), (1, 1, "user", quoting), (2, 0, None, None)], "conv_id long, turn int, role string, text string").withColumn("depth", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in chat.reply_ordered(df).collect()}
    assert got[1, 1].reply_to == 0 and got[1, 1].quoted_lines == 5_000 and got[1, 1].text == "I agree."
    assert got[1, 0].text == said and len(got) == 3
    assert chat.reply_ordered(df.where("false")).count() == 0


def test_shards_of_an_empty_table_and_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "x")], "doc_id long, shard string")
    assert sharding.place(df.where("false"), ["a", "b"], size=13).count() == 0
    got = sharding.place(df, ["a", "b"], size=13).collect()
    assert len(got) == 3 and len({r.slot for r in got if r.doc_id == 1}) == 1
    with pytest.raises(ValueError):
        sharding.place(df, ["a", "b"], size=13, keep=["shard"])


def test_language_of_very_long_texts_and_of_suffixes(spark):
    german, english = "der Hund und die Katze ", "the dog and the cat "
    learn = spark.createDataFrame([("de", german * 5), ("en", english * 5)], "lang string, text string")
    langs, table = language_id.likelihoods(learn, "lang", "text")
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(1, german * 20_000), (2, english * 20_000), (3, None)], "doc_id long, text string").select("doc_id", "text", none.alias("declared"), none.alias("suffix"), none.alias("host"), none.alias("domain"))
    got = {r.doc_id: r.lang for r in language_id.identify(rows, ["doc_id"], langs, table).collect()}
    assert got[1] == "de" and got[2] == "en" and len(got) == 3
    suffix = lambda url: spark.range(1).select(language_id.address_suffix(F.lit(url), langs)).first()[0]
    assert [suffix(u) for u in ("http://a.at/x", "http://a.at/de/x", "http://a.at/xy/", "http://a.com/", None)] == ["at", "de", "at", None, None]
