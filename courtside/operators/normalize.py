"""Context normalisation (A21-A24, P42-P46): z-scores, percentiles and tiers within a level and season.

The statistics of a context are a small aggregate joined back, not a window over the facts: a context holds a large part
of all rows, which a window would gather in one task, while the aggregate is combined before the shuffle.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.plans.storage import small_side

#: The z of each whole percentile, and the z from which the normal distribution rounds to 1.
CUTS = [*(NormalDist().inv_cdf(k / 100) for k in range(1, 100)), 8.2440]
TIERS = ((95, "elite"), (80, "very_good"), (60, "above_average"), (40, "average"))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Null if anything is null or the deviation is zero."""
    return (x - mean) / F.nullif(std, F.lit(0.0))


def percentile(z: Column) -> Column:
    """100 times the normal distribution function, cut to a whole number; null gives 50."""
    return F.when(z.isNull(), 50).otherwise(F.size(F.filter(F.array(*map(F.lit, CUTS)), lambda cut: z >= cut)))


def tier_of_percentile(p: Column) -> Column:
    """P45."""
    out = F.when(p >= TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        out = out.when(p >= least, name)
    return out.otherwise("below_average")


def tier_of_z(z: Column) -> Column:
    """Strict bounds; null is average."""
    return F.when(z.isNull(), "average").when(z > 1.5, "elite").when(z > 0.5, "very_good").when(z > -0.5, "above_average").when(z > -1.5, "average").otherwise("below_average")


def context_stats(df: DataFrame, context: list[str], metrics: list[str], least_minutes: float = 10.0) -> DataFrame:
    """Mean and population deviation of each metric over rows of enough minutes; (0, 1) without spread."""
    aggs = []
    for m in metrics:
        x = F.when(F.col("minutes") >= least_minutes, F.col(m))
        std = F.stddev_pop(x)
        aggs += [F.when(std > 0, F.avg(x)).otherwise(F.lit(0.0)).alias(f"{m}_mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"{m}_std")]
    return df.groupBy(*context).agg(*aggs)


def normalised(df: DataFrame, context: list[str], metrics: list[str], least_minutes: float = 10.0, events: DataFrame | None = None) -> DataFrame:
    """The z-score of every row in its context, in columns ``z_<metric>``.

    ``events`` are the same rows before a shuffle that ``df`` has gone through, which the statistics then do without.
    """
    stats = small_side(context_stats(df if events is None else events, context, metrics, least_minutes))  # a row a context, which would else shuffle all events by a few keys
    joined = df.join(stats, context)
    return joined.withColumns({f"z_{m}": z_score(F.col(m), F.col(f"{m}_mean"), F.col(f"{m}_std")) for m in metrics}).drop(*[f"{m}_{s}" for m in metrics for s in ("mean", "std")])


def season_standing(seasons: DataFrame, facts: DataFrame, context: list[str], metric: str, average: str) -> DataFrame:
    """Z, percentile and tier of a season average within its context's event statistics."""
    joined = seasons.join(context_stats(facts, context, [metric]), context)
    z = z_score(F.col(average), F.col(f"{metric}_mean"), F.col(f"{metric}_std"))
    return joined.withColumn("z", z).withColumns({"percentile": percentile(F.col("z")), "tier": tier_of_percentile(percentile(F.col("z")))}).drop(f"{metric}_mean", f"{metric}_std")
