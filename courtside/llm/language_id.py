"""Language ID by fusing evidence: text likelihoods, declared markup language, address suffix and host priors.

1. Byte trigrams, hashed into a fixed number of buckets, are counted by language over all labelled texts (grouped
   aggregation); smoothed, they give each text a log-likelihood per language, tempered so that a long text does not
   count every trigram as independent.
2. What pages declare and what their addresses end in is counted against the text's posterior over all rows; the
   smoothed table says how far each declaration can be trusted.
3. Hosts get priors from the summed text posteriors of their rows, smoothed toward their registered domain's, which are
   smoothed toward the whole corpus's; a row's own posterior is left out of its host's.
4. The posterior is the normalised product.

Texts are read once to learn and once to score; everything after that is a few numbers a row. The host tables are
broadcast only below the bounds of ``small_side``. Null or empty texts have no text evidence and fall back to the rest;
texts of any length are read whole, their evidence tempered; missing declarations, suffixes and hosts are neutral;
repeated rows each get a row; of languages that tie the first in the alphabet wins; ids may be null; an empty table gives
an empty result; without labelled texts there are no languages and nothing is returned but nulls; more than
``MOST_LANGUAGES`` languages are an error, never a cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.frames import map_texts, quoted, with_fields
from courtside.plans.storage import saved, small_side

BUCKETS, ALPHA = 1 << 14, 0.5
#: Languages that the labels may name; the table of likelihoods, broadcast to the tasks, is 128 KB a language.
MOST_LANGUAGES = 200
#: Trigrams whose evidence counts in full; a longer text's is scaled down to as many.
FULL_TRIGRAMS = 60
#: Pseudo-counts of the domain's share in a host's prior, and of the corpus's in a domain's.
HOST_STRENGTH, DOMAIN_STRENGTH = 5.0, 20.0


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text in lower case, with white space as one space."""
    data = np.frombuffer(b" " + b" ".join((text or "").lower().encode().split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.int64)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return np.bincount(codes * np.uint32(0x9E3779B1) >> np.uint32(18), minlength=BUCKETS)


def likelihoods(texts: DataFrame, lang_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """The languages and, for each, the log-probabilities of the buckets; counted over all the texts."""

    def run(batches):
        found: dict[str, np.ndarray] = {}  # of the task, one array a language
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[lang] = found.get(lang, 0) + trigram_counts(text.as_py())
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = map_texts(texts.where(F.col(lang_col).isNotNull()).select(lang_col, text_col), run, "lang string, bucket bigint, n bigint")
    counted = saved(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = [r.lang for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} names more than {MOST_LANGUAGES} languages")
    # at most BUCKETS rows a language, of which the driver sees columns of numbers
    langs, rows = sorted(langs), counted.toArrow()
    counts = np.full((BUCKETS, len(langs)), ALPHA)
    if langs:
        of = pa.compute.index_in(rows.column("lang"), pa.array(langs)).to_numpy()
        counts[rows.column("bucket").to_numpy(), of] += rows.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(0)) if langs else counts


def text_posteriors(df: DataFrame, keep: list[str], text_col: str, table: np.ndarray) -> DataFrame:
    """The columns ``keep`` and ``ll array<double>``: each text's tempered log-likelihoods, greatest 0."""
    shared = df.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages numbers

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(len(keep)):
                counts = trigram_counts(text.as_py())
                ll = counts @ shared.value * min(1.0, FULL_TRIGRAMS / max(1, counts.sum()))
                out.append((ll - ll.max()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(pa.float64()))], names=[*keep, "ll"])

    return map_texts(df.select(*quoted(keep), F.col(text_col).alias("__text")), run, with_fields(df, keep, "ll: array<double>"))


def markup_text(html: Column) -> Column:
    """The visible text of a page."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(plain, r"&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag that a page's root element declares, in lower case, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def address_suffix(url: Column, langs: list[str]) -> Column:
    """What the address says of its language: a first path segment that is a language, or else the two letters that end its host, whatever they are (what they are worth is learned); null if it has neither."""
    first = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    last = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    known = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>")
    return F.when(F.array_contains(known, first), first).otherwise(F.nullif(last, F.lit("")))


def _softmax(ll: Column) -> Column:
    top = F.array_max(ll)
    e = F.transform(ll, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def _sums(df: DataFrame, by: list[str], k: int) -> DataFrame:
    sums = F.array(*[F.sum(F.get("post", i)) for i in range(k)])
    return df.groupBy(*by).agg(sums.alias("sums"))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _trust(rows: DataFrame, column: str, k: int) -> DataFrame:
    """``(column, log array)``: log P(declared value | language), smoothed, from soft counts over all rows."""
    table = _sums(rows.where(F.col(column).isNotNull()), [column], k)
    totals = table.agg(F.array(*[F.coalesce(F.sum(F.get("sums", i)), F.lit(0.0)) for i in range(k)]).alias("t"), F.count("*").alias("values")).first()
    smooth = [F.ln((F.get("sums", i) + 0.5) / (totals.t[i] + 0.5 * (totals["values"] + 1))) for i in range(k)]
    return table.select(column, F.array(*smooth).alias(f"{column}_log"))


def identify(rows: DataFrame, keep: list[str], langs: list[str], table: np.ndarray) -> DataFrame:
    """``keep``, ``lang``, ``confidence`` and ``text_lang`` for rows of ``(keep, text, declared, suffix, host, domain)``."""
    k = len(langs)
    if not k:
        return rows.select(*keep, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    cols = [*keep, "declared", "suffix", "host", "domain"]
    scored = saved(text_posteriors(rows, cols, "text", table).withColumn("post", _softmax(F.col("ll"))))
    total = scored.agg(F.array(*[F.coalesce(F.sum(F.get("post", i)), F.lit(0.0)) for i in range(k)]).alias("s")).first()["s"]
    share = [(s + 1) / (sum(total) + k) for s in total]
    prior = F.array(*map(F.lit, share))
    hosts = saved(_sums(scored.where("host is not null"), ["host", "domain"], k))
    domains = hosts.groupBy(F.col("domain").alias("d")).agg(F.array(*[F.sum(F.get("sums", i)) for i in range(k)]).alias("domain_sums"))
    of_host = small_side(hosts.join(domains, F.col("domain").eqNullSafe(F.col("d"))).select(F.col("host").alias("h"), "d", "sums", "domain_sums"))
    joined = scored.join(of_host, (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("d")), "left").drop("h", "d")
    for column in ("declared", "suffix"):
        joined = joined.join(small_side(_trust(scored, column, k)), column, "left")
    without = lambda sums: F.zip_with(sums, F.col("post"), lambda s, p: F.greatest(s - p, F.lit(0.0)))
    normal = lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x))
    of_domain = normal(_plus(without(F.col("domain_sums")), F.transform(prior, lambda v: v * DOMAIN_STRENGTH)))
    joined = joined.withColumn("of_domain", of_domain)
    host_prior = F.coalesce(normal(_plus(without(F.col("sums")), F.transform("of_domain", lambda v: v * HOST_STRENGTH))), prior)
    joined = joined.withColumn("prior", host_prior)
    none = F.array(*[F.lit(0.0)] * k)
    fused = _plus(_plus(F.col("ll"), F.transform("prior", lambda v: F.ln(v))), _plus(F.coalesce("declared_log", none), F.coalesce("suffix_log", none)))
    joined = joined.withColumn("final", _softmax(fused))
    name = lambda a: F.element_at(F.array(*map(F.lit, langs)), F.array_position(a, F.array_max(a)).cast("int"))
    return joined.select(*keep, name(F.col("final")).alias("lang"), F.array_max("final").alias("confidence"), F.when(F.array_min("ll") < 0, name(F.col("post"))).alias("text_lang"))
