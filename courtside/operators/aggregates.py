"""Aggregates of an entity's events (A01-A49): one groupBy each, with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.boxscore import per_36, ratio
from courtside.plans.storage import small_side

#: The total order of an entity's events; natural keys repeat.
ORDER = ["game_date", "game_id", "line_no", "part_id", "squad_id", "price"]
TOTALS = ["points", "reb", "ast", "stl", "blk", "tov", "fgm", "fga", "fta"]


def positive_mean(x: Column, default: float | None = None) -> Column:
    """The mean of what is above zero."""
    mean = F.avg(F.when(x > 0, x))
    return mean if default is None else F.coalesce(mean, F.lit(default))


def slope(y: Column, x: Column, least: int) -> Column:
    """The least-squares slope, or 0 for fewer than ``least`` rows."""
    return F.when(F.count(y) >= least, F.regr_slope(y, x)).otherwise(F.lit(0.0))


def season_aggregates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Averages, positive averages, totals, spread, trend, wins, first and last date of each group.

    One window numbers the events of a group for the trend and one aggregation does the rest; both use the same keys,
    so there is one shuffle.
    """
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)) - 1
    c = F.col
    return (
        df.withColumn("at", at)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("games"),
            F.avg("minutes").alias("avg_minutes"),
            F.avg("points").alias("avg_points"),
            F.avg("efficiency").alias("avg_efficiency"),
            F.avg("reb").alias("avg_reb"),
            F.avg("ast").alias("avg_ast"),
            positive_mean(ratio(c("fgm"), c("fga")) * 100, 0.0).alias("avg_fg_pct"),
            positive_mean(ratio(c("fg3m"), c("fg3a")) * 100, 0.0).alias("avg_3p_pct"),
            positive_mean(c("ts")).alias("avg_ts"),
            positive_mean(c("efg")).alias("avg_efg"),
            positive_mean(c("ortg")).alias("avg_ortg"),
            F.avg(F.when(c("per") != 0, c("per"))).alias("avg_per"),
            F.sum("points").alias("total_points"),
            F.sum("reb").alias("total_reb"),
            F.sum("ast").alias("total_ast"),
            F.stddev_pop("points").alias("std_points"),
            F.stddev_pop("efficiency").alias("std_efficiency"),
            slope(c("points"), c("at"), 3).alias("trend_points"),
            slope(c("efficiency"), c("at"), 3).alias("trend_efficiency"),
            (F.avg(c("won").cast("int")) * 100).alias("win_pct"),
            F.sum(F.coalesce(c("per") * c("minutes") / 4000, F.lit(0.0))).alias("total_win_shares"),
            F.min("game_date").alias("first_game"),
            F.max("game_date").alias("last_game"),
            F.avg(c("season_start") - c("birth_year")).alias("avg_age"),
        )
    )


def running_variance(values: Column) -> Column:
    """The population variance of an array's doubles, updated value by value: the same for the same order, however rows are dealt to tasks; null for an empty array."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

    return F.aggregate(values, start, step, lambda s: s["m2"] / F.nullif(s["n"], F.lit(0.0)))


def profile_metrics(df: DataFrame, profile: list[str], team: list[str], z_of: tuple[str, ...] = (), carried: tuple[str, ...] = (), events: DataFrame | None = None) -> DataFrame:
    """A01-A08 with W01-W03: totals, spread, per-36 rates, share of the team, recent form of each profile.

    ``profile`` must contain the columns of ``team``. The spread columns follow the offensive rating, as the reference
    semantics do; ``*_points`` columns hold the same figures for points. Ratings that are equal but for their last digit
    have a spread or none by the order they are added in, so the rating's variance runs from the newest event on. ``z_of`` names metrics whose event z-scores
    ``z_<metric>`` are averaged, ``carried`` columns of which the greatest value is kept. ``events`` are the same rows before a shuffle that
    ``df`` has gone through; the teams' totals are combined from them.
    """
    c = F.col
    newest = F.row_number().over(Window.partitionBy(*profile).orderBy(*[F.desc(x) for x in ORDER]))
    rows = df.withColumn("rn", newest)
    recent = lambda x, n: F.nullif(F.avg(F.when(c("rn") <= n, c(x))), F.lit(0.0))
    last_ten = F.when(c("rn") <= 10, c("points"))
    base = rows.groupBy(*profile).agg(
        F.count("*").alias("games"),
        F.sum("minutes").alias("total_minutes"),
        F.avg("minutes").alias("avg_minutes"),
        F.avg("points").alias("avg_points"),
        F.avg("ortg").alias("avg_ortg"),
        F.avg("per").alias("avg_per"),
        F.avg("ts").alias("avg_ts"),
        F.nullif(F.avg("usg"), F.lit(0.0)).alias("avg_usg"),
        running_variance(F.transform(F.array_sort(F.collect_list(F.when(c("ortg").isNotNull(), F.struct("rn", "ortg")))), lambda e: e["ortg"])).alias("var_ortg"),
        F.var_pop("points").alias("var_points"),
        *[F.avg(f"z_{m}").alias(f"avg_z_{m}") for m in z_of],
        *[F.max(x).alias(x) for x in carried],
        *[F.sum(x).alias(f"total_{x}") for x in TOTALS],
        recent("points", 5).alias("last5_points"),
        recent("points", 10).alias("last10_points"),
        recent("ortg", 5).alias("last5_ortg"),
        recent("ortg", 10).alias("last10_ortg"),
        F.when(F.count(last_ten) >= 2, F.regr_slope(last_ten, c("rn"))).alias("trend_points"),
    )
    std = lambda v: F.when(v > 0, F.sqrt(v)).otherwise(0.0)
    out = base.withColumns({"std_ortg": std(c("var_ortg")), "std_points": std(c("var_points"))}).withColumns(
        {
            "cv": F.when((c("avg_ortg") > 0) & (c("std_ortg") > 0), c("std_ortg") / c("avg_ortg")),
            "cv_points": F.when((c("avg_points") > 0) & (c("std_points") > 0), c("std_points") / c("avg_points")),
            "stability": c("std_ortg") / F.sqrt("games"),
            "momentum": c("last5_points") - c("last10_points"),
            "trend_points_forward": -c("trend_points"),
            **{f"{x}_36": F.when(c("total_minutes") > 0, F.coalesce(per_36(c(f"total_{x}"), c("total_minutes")), F.lit(0.0))) for x in TOTALS},
        }
    )
    own = (df if events is None else events).groupBy(*profile).agg(F.sum("points").alias("total_points"), F.sum("minutes").alias("total_minutes"), F.avg("ts").alias("avg_ts"), F.nullif(F.avg("usg"), F.lit(0.0)).alias("avg_usg"))
    whole = own.groupBy(*team).agg(F.sum("total_points").alias("team_points"), F.sum("total_minutes").alias("team_minutes"), F.avg("avg_ts").alias("team_ts"), F.avg("avg_usg").alias("team_usg"))
    share = lambda a, b: ratio(F.nullif(c(a).cast("double"), F.lit(0.0)), c(b))
    return out.join(small_side(whole), team).withColumns({"points_share": share("total_points", "team_points"), "minutes_share": share("total_minutes", "team_minutes"), "ts_vs_team": share("avg_ts", "team_ts"), "usage_vs_team": share("avg_usg", "team_usg")}).drop("var_ortg", "var_points", "team_points", "team_minutes", "team_ts", "team_usg")


def team_wins(games: DataFrame, least: int = 3) -> DataFrame:
    """A25 with J09: win percentage of each team in a competition's season; a game counts for both its sides, ties as losses."""
    side = lambda t, won: F.struct(F.col(t).alias("team_id"), won.cast("int").alias("won"))
    sides = games.select("competition_id", "season_start", F.inline(F.array(side("home_id", F.col("home_score") > F.col("away_score")), side("away_id", F.col("away_score") > F.col("home_score")))))
    return sides.groupBy("competition_id", "season_start", "team_id").agg(F.count("*").alias("games"), (F.avg("won") * 100).alias("win_pct")).where(F.col("games") >= least)


def team_strength(wins: DataFrame) -> DataFrame:
    """``1 + 0.06 tanh(z)`` of the win percentage in its context, z within 2 of 0; 1 in contexts of under three teams or no spread."""
    w = Window.partitionBy("competition_id", "season_start")
    n, mean, std = F.count("*").over(w), F.avg("win_pct").over(w), F.stddev_pop("win_pct").over(w)
    z = F.least(F.greatest((F.col("win_pct") - mean) / F.nullif(std, F.lit(0.0)), F.lit(-2.0)), F.lit(2.0))
    return wins.withColumn("strength", F.when((n < 3) | (std < 0.01), F.lit(1.0)).otherwise(1 + 0.06 * F.tanh(z)))


def strength_of_seasons(strength: DataFrame) -> DataFrame:
    """One factor for each team and season: that of the highest competition id, where a team plays in several."""
    return strength.groupBy("team_id", "season_start").agg(F.max_by("strength", "competition_id").alias("strength"))


def entity_fold(df: DataFrame, keys: list[str]) -> DataFrame:
    """First and last date, distinct games, and the first known birth year and team of each key."""
    order = F.struct(*ORDER)
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), order))
    return df.groupBy(*keys).agg(F.min("game_date").alias("first_seen"), F.max("game_date").alias("last_seen"), F.count_distinct("game_id").alias("games"), first("birth_year").alias("birth_year"), first("team_id").alias("first_team"))


def identity_groups(df: DataFrame, name: str, birth_year: str) -> DataFrame:
    """Identities by name and birth year (nulls together): profiles, distinct seasons in order, first and last season."""
    return df.where(F.trim(F.col(name)) != "").groupBy(name, birth_year).agg(F.count("*").alias("profiles"), F.count_distinct("season_start").alias("seasons"), F.concat_ws(",", F.array_sort(F.collect_set(F.col("season_start").cast("string")))).alias("season_list"), F.min("season_start").alias("first_season"), F.max("season_start").alias("last_season"))


def outlier_events(df: DataFrame, keys: list[str], value: str = "points", z: float = 2.5) -> DataFrame:
    """Events over ``z`` population deviations from their entity's mean, for entities of at least three.

    An event at the bound itself is none, whichever side of it the order of the rows has rounded it to.
    """
    w = Window.partitionBy(*keys)
    std = F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    scored = df.select(*keys, *[x for x in ORDER if x not in keys], value, F.count("*").over(w).alias("n"), ((F.col(value) - F.avg(value).over(w)) / std).alias("z"))
    return scored.where((F.col("n") >= 3) & (F.abs("z") > z + 1e-9)).drop("n")


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value, with a total row whose key is null and ``is_total`` true."""
    return df.rollup(key).agg(F.count("*").alias("n"), (F.grouping(key) == 1).alias("is_total"))


def share_where(df: DataFrame, condition: Column, by: list[str] | None = None) -> DataFrame:
    """How many rows meet a condition, and their share."""
    hit = F.count_if(F.coalesce(condition, F.lit(False)))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), hit.alias("hits"), ratio(hit, F.count("*")).alias("share"))


def distinct_members(df: DataFrame, keys: list[str], member: str, least: int = 1) -> DataFrame:
    """Distinct members of each group, for groups of at least ``least``."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("members")).where(F.col("members") >= least)


def tier_distribution(df: DataFrame, keys: list[str], tier: str, tiers: list[str]) -> DataFrame:
    """A column of counts for each tier, zero where there is none."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(tier) == t).alias(t) for t in tiers])


def most_played(df: DataFrame, key: str, least: int = 10, top: int = 5) -> DataFrame:
    """The entities with the most distinct games."""
    return df.groupBy(key).agg(F.count_distinct("game_id").alias("games")).where(F.col("games") >= least).orderBy(F.desc("games"), key).limit(top)
