"""Rule-based scores of a season and of a career (R01-R23): Column expressions over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators.aggregates import slope

#: The year that counts as now, weights of the season and career composites, and the tiers' bounds.
NOW = 2026
SEASON_WEIGHTS = {"age": 0.20, "performance": 0.30, "production": 0.15, "consistency": 0.15, "advanced": 0.10, "momentum": 0.10}
CAREER_WEIGHTS = {"recent": 0.50, "trajectory": 0.25, "career_avg": 0.05, "age_score": 0.10, "consistency": 0.05, "confidence": 0.05}
#: A season has no elite tier and a fifth one below; a career has an elite tier. Each list ends in the label of the rest.
SEASON_TIERS = ((0.75, "very_high"), (0.60, "high"), (0.45, "medium"), (0.30, "low"), (None, "very_low"))
CAREER_TIERS = ((0.70, "elite"), (0.60, "very_high"), (0.50, "high"), (0.40, "medium"), (None, "low"))
LEVEL_MULTIPLIERS = {3: 1.0, 2: 0.9, 1: 0.85}
LEAST_GAMES, LEAST_MINUTES, LEAST_AVERAGE = 8, 80.0, 8.0


def stepped(x: Column, steps: list[tuple], rest) -> Column:
    """The value of the first bound that ``x`` reaches."""
    out = F.when(x >= steps[0][0], steps[0][1])
    for least, value in steps[1:]:
        out = out.when(x >= least, value)
    return out.otherwise(rest)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def weighted(parts: dict[str, float]) -> Column:
    """The weighted mean of columns; 0 without weight."""
    total = sum(parts.values())
    return sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0)) / total if total else F.lit(0.0)


def tier(score: Column, bounds: tuple) -> Column:
    """The label of the first bound that the score reaches, else the last."""
    return stepped(score, list(bounds[:-1]), bounds[-1][1])


def eligible(games: Column, minutes: Column, average: Column) -> Column:
    """R01."""
    return (games >= LEAST_GAMES) & F.coalesce(minutes >= LEAST_MINUTES, F.lit(False)) & F.coalesce(average >= LEAST_AVERAGE, F.lit(False))


def eligibility_notes(games: Column, minutes: Column, average: Column) -> Column:
    """What is missing, joined by '; '."""
    short = lambda x, least: F.coalesce(x < least, F.lit(True))
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(games < LEAST_GAMES, F.format_string("few games (%d<%d)", games, F.lit(LEAST_GAMES))),
                F.when(short(minutes, LEAST_MINUTES), F.format_string("few minutes (%.0f<%.0f)", F.coalesce(minutes, F.lit(0.0)), F.lit(LEAST_MINUTES))),
                F.when(short(average, LEAST_AVERAGE), F.format_string("marginal role (%.1f<%.0f)", F.coalesce(average, F.lit(0.0)), F.lit(LEAST_AVERAGE))),
            )
        ),
        "; ",
    )


def age_score(age: Column) -> Column:
    """Younger is higher; null 0.5."""
    return F.when(age.isNull(), 0.5).when(age <= 21, 1.0).when(age <= 24, 0.8).when(age <= 27, 0.5).when(age <= 30, 0.3).otherwise(0.1)


def career_age_score(age: Column) -> Column:
    """As :func:`age_score`, and zero counts as unknown."""
    return age_score(F.nullif(age, F.lit(0)))


def performance_score(z1: Column, z2: Column, level: Column) -> Column:
    """The mean of two z-scores from -3..3 to 0..1, more in the top level and less in the third."""
    base = clip(((z1 + z2) / 2 + 3) / 6)
    return F.when(base.isNull(), 0.5).otherwise(F.least(base * F.when(level == 1, 1.10).when(level == 3, 0.95).otherwise(1.0), F.lit(1.0)))


def consistency_score(cv: Column, std: Column) -> Column:
    """By the variation, or a deviation above zero where there is none; a profile without spread says nothing."""
    return F.when(cv >= 0, clip(1 - cv / 0.8)).when(std > 0, F.greatest(1 - std / 50, F.lit(0.0))).otherwise(0.5)


def advanced_score(ts: Column, efficiency: Column) -> Column:
    """True shooting, adjusted by the shooting against the team's where that is known."""
    return F.when(ts.isNull(), 0.5).otherwise(F.least(F.lit(1.0), ts / 65) * F.coalesce(clip(efficiency, 0.8, 1.2), F.lit(1.0)))


def momentum_score(momentum: Column, trend: Column) -> Column:
    """R06."""
    return F.coalesce(clip((momentum + 5) / 10), clip((trend + 2) / 4), F.lit(0.5))


def production_score(points_36: Column, share: Column) -> Column:
    """R07."""
    scored = F.least(F.least(F.lit(1.0), points_36 / 20) + F.least(F.lit(0.2), F.coalesce(share, F.lit(0.0))), F.lit(1.0))
    return F.when(points_36.isNull(), 0.5).otherwise(scored)


def temporal_weight(season_start: Column, now: int = NOW) -> Column:
    """5 % less for each year ago, 0.5 at least; 1 if unknown."""
    return F.coalesce(F.greatest(F.lit(0.5), 1 - 0.05 * (now - season_start)), F.lit(1.0))


def confidence_multiplier(games: Column, minutes: Column, average: Column) -> Column:
    """R10."""
    return 0.4 * stepped(games, [(15, 1.0), (10, 0.9), (8, 0.7), (5, 0.5)], 0.2) + 0.3 * stepped(minutes, [(200, 1.0), (120, 0.8), (80, 0.6)], 0.3) + 0.3 * stepped(average, [(15, 1.0), (10, 0.8), (5, 0.5)], 0.3)


def season_scores(metrics: DataFrame) -> DataFrame:
    """R01-R12 for rows of profile metrics.

    Needs games, total_minutes, avg_minutes, birth_year, season_start, level, avg_z_ortg, avg_z_per, cv, std_ortg,
    avg_ts, ts_vs_team, momentum, trend_points, points_36, points_share.
    """
    c = F.col
    games, minutes, average = c("games"), c("total_minutes"), c("avg_minutes")
    age = c("season_start") - c("birth_year")
    parts = {
        "age": age_score(age),
        "performance": performance_score(c("avg_z_ortg"), c("avg_z_per"), c("level")),
        "production": production_score(c("points_36"), c("points_share")),
        "consistency": consistency_score(c("cv"), c("std_ortg")),
        "advanced": advanced_score(c("avg_ts"), c("ts_vs_team")),
        "momentum": momentum_score(c("momentum"), c("trend_points")),
    }
    scored = metrics.withColumns({f"{k}_score": v for k, v in parts.items()})
    base = sum((w * c(f"{k}_score") for k, w in SEASON_WEIGHTS.items()), F.lit(0.0))
    scored = scored.withColumns({"eligible": eligible(games, minutes, average), "notes": eligibility_notes(games, minutes, average), "base": base, "confidence": confidence_multiplier(games, minutes, average)})
    scored = scored.withColumn("potential", c("base") * (0.85 + 0.15 * temporal_weight(c("season_start"))) * c("confidence"))
    return scored.withColumns(
        {
            "tier": tier(c("potential"), SEASON_TIERS),
            "young_talent": F.coalesce(age < 23, F.lit(False)) & (c("performance_score") >= 0.6) & c("eligible"),
            "consistent": (c("consistency_score") >= 0.7) & (c("performance_score") >= 0.6) & c("eligible"),
        }
    )


def level_multiplier(level: Column) -> Column:
    """R14."""
    out = F.when(level == 3, LEVEL_MULTIPLIERS[3])
    for k in (2, 1):
        out = out.when(level == k, LEVEL_MULTIPLIERS[k])
    return out.otherwise(0.8)


def career_members(identities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of the same name whose birth year is the identity's or unknown; an unknown identity takes unknown ones only."""
    p = profiles.withColumnRenamed("birth_year", "profile_birth_year")
    return identities.join(p, "name").where(F.col("profile_birth_year").isNull() | F.col("profile_birth_year").eqNullSafe(F.col("birth_year")))


def with_strength(scored: DataFrame, strength: DataFrame) -> DataFrame:
    """Scored profiles with the factor ``(team_id, season_start, strength)`` of their team in that season; 1 where there is none."""
    return scored.join(strength, ["team_id", "season_start"], "left").fillna(1.0, ["strength"])


def career_seasons(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row per identity and season: games, minutes, adjusted score weighted by minutes, top level."""
    used = members.where("eligible and total_minutes > 0 and potential is not null")
    adjusted = F.col("potential") * (1 + 0.5 * (F.coalesce("strength", F.lit(1.0)) - 1)) * level_multiplier(F.coalesce("level", F.lit(2)))
    grouped = used.groupBy(*keys, "season_start").agg(F.sum("games").alias("games"), F.sum("total_minutes").alias("minutes"), F.sum(adjusted * F.col("total_minutes")).alias("weighted"), F.max(F.coalesce("level", F.lit(2))).alias("max_level"))
    return grouped.withColumn("score", F.try_divide("weighted", F.nullif(F.col("minutes"), F.lit(0.0)))).drop("weighted")


def _bucket(x: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    out = F.when(x > steps[0][0], steps[0][1])
    for least, value in steps[1:]:
        out = out.when(x > least, value)
    return out.otherwise(rest)


def career_scores(seasons: DataFrame, keys: list[str], birth_year: str = "birth_year", now: int = NOW) -> DataFrame:
    """R16-R23 with A32-A34 and W05-W07: one row per identity from its season rows; ``birth_year`` is one of the keys."""
    c = F.col
    newest, oldest = Window.partitionBy(*keys).orderBy(F.desc("season_start")), Window.partitionBy(*keys).orderBy("season_start")
    rows = seasons.withColumns({"rn": F.row_number().over(newest), "at": F.row_number().over(oldest) - 1})
    mean = lambda cond: F.avg(F.when(cond, c("score")))
    by_minutes = lambda cond: F.try_divide(F.sum(F.when(cond, c("score") * c("minutes"))), F.nullif(F.sum(F.when(cond, c("minutes"))), F.lit(0.0)))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("seasons"),
        F.sum("games").alias("games"),
        F.sum("minutes").alias("minutes"),
        F.max("season_start").alias("last_season"),
        F.coalesce(by_minutes(F.lit(True)), F.lit(0.5)).alias("career_avg"),
        F.coalesce(by_minutes(c("rn") <= 2), F.lit(0.5)).alias("recent"),
        F.stddev_pop("score").alias("spread"),
        mean(c("rn") <= 2).alias("late"),
        mean(c("rn") > 2).alias("early"),
        F.max(F.when(c("rn") == 1, c("score"))).alias("newest"),
        F.max(F.when(c("at") == 0, c("score"))).alias("oldest"),
        slope(c("score"), c("at"), 2).alias("slope"),
        F.max_by("season_start", F.struct("score", "season_start")).alias("best_season"),
        F.max(F.when(c("rn") <= 2, c("max_level"))).alias("late_level"),
        F.max(F.when(c("rn") > 2, c("max_level"))).alias("early_level"),
    )
    many = 0.7 * _bucket(c("late") - c("early"), [(0.10, 0.95), (0.05, 0.80), (0.02, 0.65), (-0.02, 0.50)], 0.30) + 0.3 * clip(c("slope") / 0.15 * 0.5 + 0.5)
    two = _bucket(c("newest") - c("oldest"), [(0.10, 0.90), (0.05, 0.75), (0.02, 0.65), (-0.02, 0.50), (-0.05, 0.35)], 0.20)
    raw = F.when(c("seasons") >= 3, many).when(c("seasons") == 2, two).otherwise(0.5)
    n, g = c("seasons"), c("games")
    confidence = F.when((n >= 4) & (g >= 50), 1.0).when((n >= 3) & (g >= 30), 0.95).when((n >= 2) & (g >= 20), 0.90).when((n >= 2) & (g >= 10), 0.85).when((n >= 1) & (g >= 15), 0.75).otherwise(0.60)
    age = F.lit(now) - c(birth_year)
    out = out.withColumns(
        {
            "trajectory": F.when(c("recent") < 0.40, F.least(raw, F.lit(0.40))).otherwise(raw),
            "consistency": F.when(n < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - c("spread") / 0.5)),
            "age_score": career_age_score(age),
            "confidence": confidence,
            "bonus": F.when((n >= 3) & (c("late_level") - c("early_level") >= 2), 0.15).when((n >= 3) & (c("late_level") - c("early_level") >= 1), 0.08).otherwise(0.0),
        }
    )
    base = sum((w * c(k) for k, w in CAREER_WEIGHTS.items()), F.lit(0.0))
    idle = F.lit(now) - (c("last_season") + 1)
    penalty = F.when(idle >= 3, 0.60).when(idle == 2, 0.35).when(idle == 1, 0.15).otherwise(0.0)
    out = out.withColumn("unified", F.least(F.lit(1.0), base + c("bonus")) * (1 - penalty)).withColumn("tier", tier(c("unified"), CAREER_TIERS))
    rising = (n >= 2) & (age <= 24) & (c("recent") > c("career_avg") + 0.02) & (c("trajectory") >= 0.55) & (c("recent") >= 0.45)
    peak = (c("recent") >= 0.55) & ((c("recent") > c("career_avg") * 1.05) | (c("recent") >= 0.65)) & age.between(22, 29)
    return out.withColumns({"rising_star": rising, "established": (n >= 3) & (c("career_avg") >= 0.50) & (c("consistency") >= 0.7) & (c("recent") >= 0.45), "peak_performer": peak}).drop("late", "early", "newest", "oldest", "late_level", "early_level", "spread")


def career_labels() -> Column:
    """Labels of a career row."""
    c = F.col
    return F.array_compact(F.array(F.when(c("rising_star"), "rising"), F.when(c("peak_performer"), "peak"), F.when(c("established"), "veteran"), F.when(c("trajectory") > 0.15, "improving").when(c("trajectory") < -0.10, "declining")))
