"""Feature mart and reports (J01-J09, J13-J20, M01-M06, A39-A46, T01-T15): chains of equi-joins, narrow before wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.scalars import match_weight


def next_season_targets(facts: DataFrame, least_minutes: float = 200.0, values: tuple[str, ...] = ("points", "efficiency")) -> DataFrame:
    """A player's averages of the next season, if that season exists and has enough minutes."""
    seasons = facts.where(F.col("season_start").isNotNull()).groupBy("player_id", "season_start").agg(F.sum("minutes").alias("minutes"), *[F.avg(v).alias(f"target_{v}") for v in values])
    next_one = Window.partitionBy("player_id").orderBy("season_start").rangeBetween(1, 1)  # not a join with itself, which would shuffle by both keys
    after = seasons.withColumn("__after", F.max(F.when(F.col("minutes") >= least_minutes, F.struct(*[f"target_{v}" for v in values]))).over(next_one))
    return after.where(F.col("__after").isNotNull() & F.col("player_id").isNotNull()).select("player_id", "season_start", "__after.*")


def targets_by_name(facts: DataFrame, name: str, least_games: int = 5) -> DataFrame:
    """Next-season averages by name, with enough games in both seasons."""
    seasons = facts.groupBy(name, "season_start").agg(F.count("*").alias("games"), F.avg("points").alias("avg_points")).where(F.col("games") >= least_games)
    after = seasons.select(name, (F.col("season_start") - 1).alias("season_start"), F.col("avg_points").alias("next_points"))
    return seasons.join(after, [name, "season_start"])


def busy_rows(facts: DataFrame, least_games: int = 5) -> DataFrame:
    """event rows with minutes of players with enough such rows."""
    played = facts.where(F.col("minutes") > 0)
    busy = played.groupBy("player_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_games).select("player_id")
    return played.join(busy, "player_id", "left_semi")


def learnable_rows(facts: DataFrame, targets: DataFrame, order: list[str], least_games: int = 5) -> DataFrame:
    """Of the rows of :func:`busy_rows` those that have a target or are their player's latest: all that a model is fitted to, measured on or asked for."""
    played, at = facts.where(F.col("minutes") > 0), F.struct(*order)
    last = played.groupBy("player_id").agg(F.count("*").alias("__n"), F.max(at).alias("__last")).where(F.col("__n") >= least_games)
    known = targets.groupBy("player_id").agg(F.collect_set("season_start").alias("__known"))  # a player's seasons, so that rows are shuffled once
    rows = played.join(last.join(known, "player_id", "left"), "player_id")
    return rows.where(F.array_contains("__known", F.col("season_start")) | at.eqNullSafe(F.col("__last"))).drop("__n", "__last", "__known")


def feature_mart(facts: DataFrame, sides: list[tuple[DataFrame, list[str]]], entity: str = "player_id", least_games: int = 5) -> DataFrame:
    """Event rows with minutes of players with enough games, and the columns of every ``(side, keys)`` joined to them.

    The semi-join on busy players comes first, so the wide joins see only rows that stay; with ``least_games`` 0 the rows are taken as they are.
    """
    rows = busy_rows(facts, least_games) if least_games else facts
    out = rows.withColumn("match_weight", match_weight(F.col("group_name")))
    for side, keys in sides:
        out = joined_by(out, side, keys, entity) if entity in keys else out.join(side, keys, "left")
    return out


def joined_by(rows: DataFrame, side: DataFrame, keys: list[str], one: str) -> DataFrame:
    """``rows`` with the columns of ``side``, joined from the left by all ``keys``; tasks meet by ``one`` of them, so that rows that lie by it are not shuffled.

    The other keys are ranges of a single value: an equality would count as a key that rows have to be shuffled by as well.
    """
    side = side.select(*[F.col(k).alias(f"__{k}") for k in keys], *[x for x in side.columns if x not in keys])
    met = F.col(one) == F.col(f"__{one}")
    for k in keys:
        met = met if k == one else met & F.col(k).between(F.col(f"__{k}"), F.col(f"__{k}"))
    return rows.join(side, met, "left").drop(*[f"__{k}" for k in keys])


def numeric_features(df: DataFrame, exclude: list[str]) -> DataFrame:
    """Numeric columns that are not excluded, booleans as 0 and 1, nulls as 0."""
    keep = [(c, t) for c, t in df.dtypes if c not in exclude and (t in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint") or t.startswith("decimal"))]
    return df.select(*[c for c in exclude if c in df.columns], *[F.coalesce(F.col(c).cast("int" if t == "boolean" else t), F.lit(0)).cast("double").alias(c) for c, t in keep])


def latest_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; two rows at most are compared at a time, so a hot key is combined first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def profile_detail(profiles: DataFrame, metrics: DataFrame, potential: DataFrame) -> DataFrame:
    """Profiles with their metrics and potential, where there are any."""
    return profiles.join(metrics, "profile_id", "left").join(potential, "profile_id", "left")


def career_list(careers: DataFrame, profiles: DataFrame, name: str = "name", least: float = 0.0, top: int = 50) -> DataFrame:
    """The best careers with the team of the latest profile of that name in their last season, where there is one."""
    latest = latest_of(profiles.select(name, F.col("season_start").alias("last_season"), "profile_id", "team_id"), [name, "last_season"], "profile_id")
    return careers.where(F.col("unified") >= least).join(latest, [name, "last_season"], "left").orderBy(F.desc("unified"), name, "birth_year").limit(top)


def active_teams(games: DataFrame, facts: DataFrame, profiles: DataFrame, season: int, least: int = 5) -> DataFrame:
    """Teams of one season's games with the distinct players who played for them or are registered with them.

    A team counts a player if the row is of the team, or if the player's profile is: each row is exploded to both, so
    the disjunction stays an equi-join.
    """
    sides = games.where(F.col("season_start") == season).select("game_id", F.explode(F.array_distinct(F.array("home_id", "away_id"))).alias("team_id"))
    registered = profiles.where(F.col("season_start") == season).select("player_id", F.col("team_id").alias("of_profile"))
    rows = facts.select("game_id", "player_id", F.col("team_id").alias("of_row")).join(registered, "player_id")
    either = rows.select("game_id", "player_id", F.explode(F.array_distinct(F.array_compact(F.array("of_row", "of_profile")))).alias("team_id"))
    return sides.join(either, ["game_id", "team_id"]).groupBy("team_id").agg(F.count_distinct("player_id").alias("players")).where(F.col("players") >= least)


def candidate_report(pairs: DataFrame, profiles: DataFrame, least: float = 0.75, top: int = 50, status: str | None = None) -> DataFrame:
    """The best candidates with both names; of one status only if that is given."""
    pairs = pairs if status is None else pairs.where(F.col("status") == status)
    names = profiles.select("profile_id", "name")
    a, b = (names.select(F.col("profile_id").alias(f"id{k}"), F.col("name").alias(f"name{k}")) for k in (1, 2))
    return pairs.where(F.col("score") >= least).join(a, "id1").join(b, "id2").select("id1", "name1", "id2", "name2", "score", "confidence").orderBy(F.desc("score"), "id1", "id2").limit(top)


def scored_by_name(rows: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """Rows ``(name, birth_year)`` with one score each: that of the same name and birth year (an unknown one is equal to an unknown one), else the highest of the name. Namesakes don't multiply rows."""
    own = scores.groupBy(F.col(name).alias("__name"), F.col("birth_year").alias("__born")).agg(F.max("score").alias("__own"))
    rows = rows.join(own, (F.col(name) == F.col("__name")) & F.col("birth_year").eqNullSafe(F.col("__born")), "left").drop("__name", "__born")
    best = scores.groupBy(name).agg(F.max("score").alias("__best"))
    return rows.join(best, name, "left").withColumn("score", F.coalesce("__own", "__best")).drop("__own", "__best")


def team_players(facts: DataFrame, name: str, least_games: int = 3) -> DataFrame:
    """Each team's players of enough games with their names, birth years and averages."""
    averages = [F.avg(c).alias(f"avg_{c}") for c in ("minutes", "points", "reb", "ast", "efficiency")]
    of_player = [F.max(c).alias(c) for c in dict.fromkeys([name, "birth_year"]) if c != "player_id"]
    return facts.groupBy("team_id", "player_id").agg(*of_player, F.count_distinct("game_id").alias("games"), *averages).where(F.col("games") >= least_games)


def roster(facts: DataFrame, potential: DataFrame, name: str, least_games: int = 3) -> DataFrame:
    """Each team's players with their averages and the one score that ``potential (name, birth_year, score)`` has for them."""
    return scored_by_name(team_players(facts, name, least_games), potential, name)


def roster_summary(rows: DataFrame, current: str, projected: str, by: str = "team_id") -> DataFrame:
    """Average current and projected values, their difference, and how many have a projection."""
    return rows.groupBy(by).agg(F.avg(current).alias("avg_current"), F.avg(projected).alias("avg_projected"), (F.avg(projected) - F.avg(F.when(F.col(projected).isNotNull(), F.col(current)))).alias("delta"), F.count(projected).alias("covered"), F.count("*").alias("players"))


def top(df: DataFrame, n: int, by: list[Column], where: Column | None = None) -> DataFrame:
    """The first n rows of an order; ``by`` ends in a unique key."""
    return (df if where is None else df.where(where)).orderBy(*by).limit(n)


def top_per_group(df: DataFrame, keys: list[str], n: int, by: list[Column]) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def deterministic_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """The same n rows each time, by the hash of the key."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def top_features(values: dict[str, Column], k: int) -> Column:
    """The names of the k largest values, largest first."""
    pairs = F.array(*[F.struct((-v.cast("double")).alias("v"), F.lit(name).alias("name")) for name, v in values.items()])
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["name"])


def surrogate_keys(df: DataFrame, natural: list[str], name: str) -> DataFrame:
    """Distinct natural keys with a key that is their hash, the same in every run."""
    return df.select(*natural).distinct().withColumn(name, F.xxhash64(*natural))
