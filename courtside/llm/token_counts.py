"""Token counts: an exact histogram of encoded lengths, with prefix and suffix sums for every context limit.

The histogram has one row per distinct length, so its size is bounded by the longest document and not by their
number. It is written once, as it is read twice. Sums run in two levels: within blocks of neighbouring lengths, and over the few block totals.

Null and empty texts count as length 0. Lengths that occur often are one row with a larger count. An empty table
gives an empty histogram. The input may have any other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.bpe import token_lengths
from courtside.plans.storage import saved

#: Lengths per block of the two-level sums.
BLOCK = 1024


def length_histogram(df: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(n_tokens, docs)``: how many documents have each encoded length."""
    return token_lengths(df, [], text_col, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """One row per distinct length L, read as a context limit.

    ``docs_at_most``/``docs_over`` and ``tokens_at_most``/``tokens_over`` split documents and tokens at L,
    ``truncated_tokens`` is the total left when every document is cut to L tokens, ``docs_share`` is the quantile
    of L. Between two rows these totals are linear in the limit, so the table answers every limit exactly.
    """
    rows = saved(histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block")))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("all_tokens"),
    )
    out = rows.join(blocks, "block").withColumns(
        {
            "docs_at_most": F.col("docs_before") + F.sum("docs").over(inside),
            "tokens_at_most": F.col("tokens_before") + F.sum("tokens").over(inside),
        }
    )
    return out.select(
        "n_tokens",
        "docs",
        "docs_at_most",
        (F.col("all_docs") - F.col("docs_at_most")).alias("docs_over"),
        "tokens_at_most",
        (F.col("all_tokens") - F.col("tokens_at_most")).alias("tokens_over"),
        (F.col("tokens_at_most") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_at_most"))).alias("truncated_tokens"),
        (F.col("docs_at_most") / F.col("all_docs")).alias("docs_share"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, truncated_tokens, docs_over)`` for the given limits, in one pass over the histogram."""
    sums = [F.struct(F.lit(x).cast("bigint").alias("context_limit"), F.sum(F.least("n_tokens", F.lit(x).cast("bigint")) * F.col("docs")).alias("truncated_tokens"), F.sum(F.when(F.col("n_tokens") > x, F.col("docs")).otherwise(0)).alias("docs_over")) for x in limits]
    return histogram.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def length_quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least each share of the documents does not exceed."""
    found = [F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_share") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return table.agg(F.array(*found).alias("rows")).select(F.inline("rows"))
