"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import bpe, chat, decontaminate, exact_dedup, inner_product, language_id, lexical, periodic, pipeline, quality, sharding, simhash, token_counts, toxicity
from courtside.plans import bind


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context table of all documents: one row per distinct encoded length."""
    return token_counts.context_table(token_counts.length_histogram(_documents(spark, sf_dir)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document: token count and digests of its ids and of the decoded text."""
    return bpe.round_trip_digests(_documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document holds: doc_id, item_id and the similarity of its best window."""
    found = decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "similarity")


#: The conversations as they are, which quote nothing, and once more as mail: under a number of its own, a message quotes
#: the one before it and, one level deeper, the one before that; every fifth turn begins anew.
MAIL = """
SELECT conv_id, turn, role, text FROM {conversations} UNION ALL
SELECT -conv_id - 1, c.turn, c.role, CASE WHEN c.turn % 5 = 0 OR a.said IS NULL THEN c.text ELSE concat('On day ', CAST(c.turn AS STRING), ' somebody wrote:', chr(10),
  CASE WHEN b.said IS NULL THEN '' ELSE concat('> > ', replace(b.said, chr(10), concat(chr(10), '> > ')), chr(10)) END, '> ', replace(a.said, chr(10), concat(chr(10), '> ')), chr(10), chr(10), coalesce(c.text, '')) END
FROM {conversations} c LEFT JOIN (SELECT conv_id AS k, turn + 1 AS t, min(text) AS said FROM {conversations} GROUP BY 1, 2) a ON c.conv_id = a.k AND c.turn = a.t
LEFT JOIN (SELECT conv_id AS k, turn + 2 AS t, min(text) AS said FROM {conversations} GROUP BY 1, 2) b ON c.conv_id = b.k AND c.turn = b.t
"""


def op4_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of :data:`MAIL` without its quotes, with the message it answers, its thread and its depth."""
    return chat.reply_ordered(bind.view(spark, sf_dir, MAIL))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, over 64 shards."""
    return sharding.place(_documents(spark, sf_dir), [f"shard-{i:03d}" for i in range(64)])


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: its text, its source as the host and the language section of that as the path."""
    learn_from = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"), learn_from=learn_from)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page: text, and for pages what markup and address declare, and host priors."""
    docs = _documents(spark, sf_dir)
    learn = docs.where(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    langs, table = language_id.likelihoods(learn, "lang", "text")
    none = F.lit(None).cast("string")
    texts = docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), F.col("source").alias("domain"))
    host, html = language_id.host_of(F.col("url")), F.col("html")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.lit(None).cast("bigint").alias("doc_id"),
        F.col("page_id").cast("bigint").alias("page_id"),
        language_id.markup_text(html).alias("text"),
        language_id.declared_language(html).alias("declared"),
        language_id.address_suffix(F.col("url"), langs).alias("suffix"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )
    return language_id.identify(texts.unionByName(pages), ["doc_id", "page_id"], langs, table)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document; two thirds of the rows stand for two stored snapshots, the rest for the new batch."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), F.when(part < 2, part))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest score for each benchmark item."""
    return lexical.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document and its words without repetitions; a tenth of the documents is made to end periodically."""
    c, h = F.col, F.crc32(F.col("doc_id").cast("string"))
    # generators, so that what follows uses a value and does not make it again
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.inline(F.array(F.struct((h % 10 == 0).alias("edited"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, periodic.words_of(c("text"))).alias("words")))))
    n = F.size("words").cast("bigint")
    start = F.pmod(c("g"), F.greatest(n, F.lit(1)))
    period = 1 + F.floor((n - start) / (3 + c("g") % 8))
    text = F.when(c("edited") & (n > 0), F.array_join(periodic.with_period(c("words"), n, start, period), " ")).otherwise(c("text"))
    found = periodic.find_runs(docs, text, ["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.select("*", F.inline(F.array(F.struct(periodic.strongest(c("runs")).alias("best")))))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors of the highest inner product for every twentieth vector, in integers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return inner_product.top_inner_products(rows, lambda i: i % 20 == 0, 20, vector=inner_product.scaled(F.col("embedding"), 64.0))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_quotation_threads": op4_quotation_threads,
    "op5_sharding": op5_sharding,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_inner_products": op13_inner_products,
    "pipeline": pipeline.run,
}


def _shingled(table: str, key: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"SELECT {key}, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s FROM (SELECT DISTINCT {key}, {words} AS w FROM {table}) WHERE len(w) > 0"


def threads_sql(messages: str) -> str:
    """The SQL of :func:`chat.reply_ordered` for the rows of a query of messages."""
    return (
        r"""
        WITH RECURSIVE mail AS (""" + messages + r"""), m AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM mail),
        l AS (SELECT conv_id, turn, text, t.p AS pos, s[t.p] AS line, regexp_matches(s[t.p], '^\s*>') AS quoted FROM (SELECT *, regexp_split_to_array(text, '\r\n|\r|\n') AS s FROM m), unnest(range(1, len(s) + 1)) AS t(p)),
        x AS (SELECT *, quoted OR (regexp_matches(line, '^\s*On\b.*\bwrote:\s*$') AND coalesce(lead(quoted) OVER (PARTITION BY conv_id, turn, text ORDER BY pos), false)) AS gone FROM l),
        own AS (SELECT conv_id, turn, text, count(*) FILTER (quoted) AS quoted_lines, CASE WHEN bool_or(quoted) THEN trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''), ' ' || chr(9) || chr(13) || chr(10)) ELSE text END AS own FROM x GROUP BY conv_id, turn, text),
        k AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:\s*>)+)', 1), '\s', '', 'g')) AS level, regexp_replace(line, '^(?:\s*>)+\s?', '') AS body FROM l WHERE quoted AND conv_id IS NOT NULL AND turn IS NOT NULL),
        g AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, text, level ORDER BY pos) AS run FROM k),
        p AS (SELECT conv_id, turn, level, string_agg(body, chr(10) ORDER BY pos) AS passage FROM g GROUP BY conv_id, turn, text, level, run),
        uq AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS unit FROM (SELECT conv_id, turn, level, unnest(list_concat(list_concat([passage], string_split(passage, chr(10))), list_concat(regexp_split_to_array(passage, '\n\s*\n'), string_split(regexp_replace(regexp_replace(passage, '([.!?…。！？])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1))))) AS u FROM p)),
        uo AS (SELECT conv_id, unit, min(turn) AS turn FROM (SELECT conv_id, turn, trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS unit FROM (
          SELECT conv_id, turn, unnest(list_concat(list_concat([own], string_split(own, chr(10))), list_concat(regexp_split_to_array(own, '\n\s*\n'), string_split(regexp_replace(regexp_replace(own, '([.!?…。！？])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1))))) AS u FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL)) WHERE unit <> '' GROUP BY conv_id, unit),
        lk AS (SELECT uq.conv_id, uq.turn, uq.level, uo.turn AS reply_to, sum(len(string_split(uq.unit, ' '))) AS words FROM uq JOIN uo ON uq.conv_id = uo.conv_id AND uq.unit = uo.unit WHERE uo.turn < uq.turn GROUP BY ALL),
        best AS (SELECT conv_id, turn, arg_max(reply_to, (-level, words, reply_to)) AS reply_to FROM lk GROUP BY conv_id, turn),
        th(conv_id, turn, root, depth) AS (SELECT conv_id, turn, reply_to, 1 FROM best UNION ALL SELECT th.conv_id, th.turn, b.reply_to, th.depth + 1 FROM th JOIN best b ON th.conv_id = b.conv_id AND th.root = b.turn),
        fin AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM th GROUP BY conv_id, turn)
        SELECT c.conv_id, c.turn, c.role, best.reply_to, coalesce(fin.root, c.turn) AS thread_root, CAST(coalesce(fin.depth, 0) AS INT) AS depth, CAST(own.quoted_lines AS INT) AS quoted_lines, own.own AS text
        FROM mail c JOIN own ON c.conv_id IS NOT DISTINCT FROM own.conv_id AND c.turn IS NOT DISTINCT FROM own.turn AND coalesce(c.text, '') = own.text
        LEFT JOIN best ON c.conv_id = best.conv_id AND c.turn = best.turn LEFT JOIN fin ON c.conv_id = fin.conv_id AND c.turn = fin.turn"""
    )


ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS ({_shingled("documents", "doc_id")}), b AS ({_shingled("benchmark", "item_id")}),
        p AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(s) AS h FROM d) JOIN (SELECT item_id, unnest(s) AS h FROM b) USING (h)),
        w AS (SELECT doc_id, item_id, b.s AS item, d.s[k:k + len(b.s) - 1] AS part FROM p JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(1, greatest(len(d.s) - len(b.s) + 1, 1) + 1)) AS t(k)),
        o AS (SELECT doc_id, item_id, len(item) + len(part) AS total, CAST(list_sum(list_transform(list_distinct(item), lambda h: least(len(list_filter(item, lambda x: x = h)), len(list_filter(part, lambda x: x = h))))) AS BIGINT) AS shared FROM w)
        SELECT doc_id, item_id, max(shared / CAST(total - shared AS DOUBLE)) AS similarity FROM o GROUP BY doc_id, item_id HAVING max(shared / CAST(total - shared AS DOUBLE)) >= 0.8 - 1e-12""",
    "op4_quotation_threads": threads_sql(bind.duckdb_sql(MAIL)),
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
    "op11_lexical_search": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d), c AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
        a AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        g AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, a),
        s AS (SELECT item, item_id, row, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score FROM i JOIN c USING (term) JOIN g USING (term), a GROUP BY ALL)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_inner_products": r"""
        WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, q.row AS query, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
}
