"""Data-quality operators (V01-V07): one row a rule with counts, nothing is changed or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of the child whose non-null key the parent lacks."""
    keys = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, rows, violations)``; a rule that is null for a row is not violated by it. One pass."""
    found = [F.struct(F.lit(name).alias("rule"), F.count("*").alias("rows"), F.count_if(~F.coalesce(ok, F.lit(True))).alias("violations")) for name, ok in rules.items()]
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def sum_mismatches(facts: DataFrame, keys: list[str], part: str, whole: DataFrame, total: str, tolerance: float = 0.3) -> DataFrame:
    """Keys whose summed parts differ from the stated total by more than the tolerance."""
    summed = facts.groupBy(*keys).agg(F.sum(part).alias("summed"))
    return whole.join(summed, keys).where(F.abs(F.col("summed") - F.col(total)) > tolerance * F.col(total)).select(*keys, total, "summed")


def count_mismatches(aggregate: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Keys whose stated count is not the number of fact rows, on either side."""
    actual = facts.groupBy(*keys).agg(F.count("*").alias("actual"))
    stated = aggregate.select(*keys, F.col(count).alias("stated"))
    return stated.join(actual, keys, "full_outer").where(~F.col("stated").eqNullSafe(F.col("actual")))


def in_range(column: str, low: float, high: float) -> Column:
    """Neither NaN nor beyond the bounds."""
    return ~F.isnan(F.col(column).cast("double")) & F.col(column).between(low, high)
