"""Reading and writing nested game documents (S01-S20, N01-N18): flattening, keyed upserts, incremental loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import boxscore, scalars
from courtside.plans.storage import saved

_S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


#: The field names of the two vocabularies of player rows.
MODERN = ["name", "no", "inn", "minFormatted", "min", "pts", "p1m", "p1a", "p2m", "p2a", "p3m", "p3a", "ro", "rd", "rt", "assist", "to", "st", "bs", "mt", "pf", "rf", "pllss", "val", "birth_year", "birth_date"]
LEGACY = ["player_id", "playerid", "playername", "shirtnumber", "dorsal", "is_starter", "is_home", "team_name", "minutes", "points", "field_goals_made", "field_goals_attempted", "two_points_made", "two_points_attempted", "three_points_made", "three_points_attempted", "free_throws_made", "free_throws_attempted", "offensive_rebounds", "defensive_rebounds", "total_rebounds", "assists", "steals", "turnovers", "blocks", "blocks_received", "personal_fouls", "fouls_received", "plus_minus", "efficiency"]
PLAYER = _struct(*MODERN, *LEGACY)
SIDE = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("win_lose", _S), T.StructField("won", _S), T.StructField("TOTAL", _struct("pts")), T.StructField("PLAYER", T.ArrayType(PLAYER))])
#: The nested document; numbers arrive as strings. TEAM is the modern list, SIDES the older map, PLAYER the flat list.
GAME = T.StructType(
    [
        T.StructField("HEADER", T.StructType([*_struct("game_code", "season", "competition_name", "group", "starttime", "location", "gender").fields, T.StructField("TEAM", T.ArrayType(_struct("id", "team_id", "name", "pts", "score")))])),
        T.StructField("BOXSCORE", T.StructType([T.StructField("TEAM", T.ArrayType(SIDE)), T.StructField("SIDES", T.MapType(_S, SIDE)), T.StructField("PLAYER", T.ArrayType(PLAYER))])),
        T.StructField("SHOTCHART", _S),
        T.StructField("PLAYBYPLAY", _S),
    ]
)


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents by an explicit schema; keys that are missing are null, numbers become strings."""
    return spark.read.schema(GAME).json(path)


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, rejected (line, reason))`` of a folder of JSON lines: together as many rows as lines that are not blank.

    A line is rejected if it is no JSON object of the schema (``malformed``) or names no game (``no game code``). The
    lines are parsed once and written, as both results read them.
    """
    schema = T.StructType([*GAME.fields, T.StructField("line", _S)])
    parsed = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "line"}).alias("g"))
    code = F.nullif(F.trim("g.HEADER.game_code"), F.lit(""))
    broken = F.col("g").isNull() | F.col("g.line").isNotNull()
    reason = F.when(broken, "malformed").when(code.isNull(), "no game code")
    # a document is written as it was parsed, a rejected line as it stands, neither as both
    lines = parsed.select("value", "g", reason.alias("reason"))
    document = F.when(F.col("reason").isNull(), F.struct(*[F.col(f"g.{f.name}") for f in GAME.fields]))
    lines = saved(lines.select(F.when(F.col("reason").isNotNull(), F.col("value")).alias("line"), "reason", document.alias("g")))
    return lines.where(F.col("reason").isNull()).select(*[f"g.{f.name}" for f in GAME.fields]), lines.where(F.col("reason").isNotNull()).select("line", "reason")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A limit after a stable order."""
    return df.orderBy(*order).limit(n)


def unprocessed(raw: DataFrame, done: DataFrame, key: str, newest_by: str | None = None, cap: int | None = None) -> DataFrame:
    """Rows whose key is not among the processed ones; with a cap, the newest."""
    rest = raw.join(done.select(key).distinct(), key, "left_anti")
    return rest if cap is None else rest.orderBy(F.desc(newest_by or key), key).limit(cap)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def filtered(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns have these values; nested fields are written with ``__`` for the dot."""
    for name, value in values.items():
        df = df.where(F.col(name.replace("__", ".")) == F.lit(value))
    return df


def filtered_count(df: DataFrame, **values) -> DataFrame:
    """How many rows :func:`filtered` leaves."""
    return filtered(df, **values).agg(F.count("*").alias("n"))


def rebuilt(df: DataFrame, path: str) -> DataFrame:
    """A table truncated and written anew, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def union_of(**collections: DataFrame) -> DataFrame:
    """Collections of one kind in one table, with the name of each in ``collection``; missing columns are null."""
    parts = [df.withColumn("collection", F.lit(name)) for name, df in collections.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def attachments(games: DataFrame) -> DataFrame:
    """The shot charts and play-by-play lists that documents carry, as JSON text."""
    return games.select(F.col("HEADER.game_code").alias("game_code"), F.col("SHOTCHART").alias("shot_chart"), F.col("PLAYBYPLAY").alias("play_by_play"))


def existing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], newest_by: str) -> DataFrame:
    """Both tables, the latest row of each key; rows without a full key are left out."""
    both = old.select("*", F.lit(0).alias("__batch")).unionByName(new.select("*", F.lit(1).alias("__batch")), allowMissingColumns=True)
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    latest = Window.partitionBy(*keys).orderBy(F.desc("__batch"), F.desc(newest_by), F.xxhash64(*[c for c in old.columns]))
    return both.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn", "__batch")


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows an upsert inserts, updates and skips for a missing key."""
    missing = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    known = old.select(*keys).distinct().withColumn("__known", F.lit(True))
    marked = new.withColumn("__missing", missing).join(known, keys, "left")
    keyed = F.struct(*keys)
    return marked.agg(
        F.count_distinct(F.when(~F.col("__missing") & F.col("__known").isNull(), keyed)).alias("inserted"),
        F.count_distinct(F.when(F.col("__known"), keyed)).alias("updated"),
        F.count_if("__missing").alias("skipped"),
    )


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is neither in the old table nor earlier in the new one."""
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(*new.columns))
    fresh = new.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    return fresh.join(old.select(*keys).distinct(), keys, "left_anti")


def load_state(df: DataFrame, keys: list[str], code: str, at: str) -> DataFrame:
    """Last code, number of distinct codes and last time of each key, newest first."""
    return df.where(F.col(code).isNotNull()).groupBy(*keys).agg(F.max_by(code, F.struct(at, code)).alias("last_code"), F.count_distinct(code).alias("total"), F.max(at).alias("last_update")).orderBy(F.desc("last_update"), *keys)


def processed_codes(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """The distinct codes that each competition, season (and group) has."""
    return df.where(F.col(code).isNotNull()).select(*keys, code).distinct()


def reset_state(state: DataFrame, **values) -> DataFrame:
    """The state without the entries of the given values; all of it goes without values."""
    match = F.lit(True)
    for k, v in values.items():
        match = match & (F.col(k) == v)
    return state.where(~match)


def run_report(found: DataFrame, done: DataFrame, key: str, by: str) -> DataFrame:
    """Found, skipped and new counts of each group."""
    known = done.select(key).distinct().withColumn("__known", F.lit(True))
    return found.join(known, key, "left").groupBy(by).agg(F.count("*").alias("found"), F.count("__known").alias("skipped"), (F.count("*") - F.count("__known")).alias("new"))


def summary(**tables: DataFrame) -> DataFrame:
    """``(name, n)`` for each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def header(games: DataFrame) -> DataFrame:
    """Header fields with defaults, both scores if there are two teams, and whether the structure is valid."""
    h = F.col("HEADER")
    side = lambda i, *names: F.coalesce(*[F.get(h["TEAM"], i)[n] for n in names])
    two = F.size(F.coalesce(h["TEAM"], F.array())) >= 2
    home, away = (scalars.safe_int(side(i, "pts", "score")) for i in (0, 1))
    return games.select(
        h["game_code"].alias("game_code"),
        F.coalesce(h["season"], F.lit("")).alias("season"),
        F.coalesce(h["competition_name"], F.lit("")).alias("competition_name"),
        group_label(F.lit(None).cast("string"), h["group"]).alias("group_name"),
        scalars.game_time(h["starttime"]).alias("game_time"),
        F.coalesce(h["location"], F.lit("")).alias("venue"),
        F.coalesce(h["gender"], F.lit("masc")).alias("gender"),
        F.when(two, side(0, "id", "team_id")).alias("home_team"),
        F.when(two, side(1, "id", "team_id")).alias("away_team"),
        F.when(two, home).alias("home_score"),
        F.when(two, away).alias("away_score"),
        F.when(two, home - away).alias("score_diff"),
        (F.size(F.coalesce(F.col("BOXSCORE.TEAM"), F.array())) == 2).alias("is_valid"),
    )


def group_label(series: Column, round_: Column) -> Column:
    """The series, else a known round, else a single group."""
    known = lambda x: F.nullif(F.nullif(F.trim(x), F.lit("")), F.lit("Unknown"))
    return F.coalesce(known(series), known(round_), F.lit("Único"))


def win_lose(own: Column, other: Column) -> Column:
    """W or L by points; E for a tie or if either is no number."""
    a, b = own.try_cast("int"), other.try_cast("int")
    return F.when(a > b, "W").when(a < b, "L").otherwise("E")


def played_flag(minutes: Column) -> Column:
    """1 if the whole number of minutes is not zero, else 0."""
    return F.coalesce((minutes.try_cast("int") != 0).cast("int"), F.lit(0))


#: Parts of team names that say nothing about the team.
TEAM_STOP_WORDS = ("C.B.", "C.D.", "S.A.D.", "BALONCESTO", "CLUB")


def fuzzy_same_team(a: Column, b: Column) -> Column:
    """Half of the shorter name's words in common, without the parts that differ by source; an empty name matches nothing."""

    def words(x: Column) -> Column:
        name = F.upper(x)
        for part in TEAM_STOP_WORDS:
            name = F.replace(name, F.lit(part), F.lit(""))
        return F.array_distinct(F.array_remove(F.split(F.trim(name), r"\s+"), ""))

    shared, least = F.size(F.array_intersect(words(a), words(b))), F.least(F.size(words(a)), F.size(words(b)))
    return F.coalesce((least > 0) & (shared >= 0.5 * least), F.lit(False))


def same_team(a: Column, b: Column) -> Column:
    """One name contains the other in upper case, or :func:`fuzzy_same_team`."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False)) | fuzzy_same_team(a, b)


def split_points(players: DataFrame, game: str = "game_code", pos: str = "pos", starter: str = "starter") -> DataFrame:
    """Where the second team begins in a flat list: half of a list under ten; else the sixth starter; else a starter after a bench player within two of the middle; else half.

    Windows are over one game's rows, a bounded group.
    """
    w = Window.partitionBy(game).orderBy(pos)
    rows = players.withColumns({"run": F.sum(F.col(starter).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag(starter).over(w)})
    half = F.floor(F.count("*") / 2)
    sized = rows.join(players.groupBy(game).agg(F.count("*").alias("n")), game)
    middle = F.floor(F.col("n") / 2)
    near = F.col(starter) & ~F.col("before") & F.col(pos).between(middle - 2, middle + 2)
    out = sized.groupBy(game).agg(half.alias("half"), F.first("n").alias("n"), F.min(F.when(F.col(starter) & (F.col("run") == 6), F.col(pos))).alias("sixth"), F.min(F.when(near, F.col(pos))).alias("near"))
    return out.select(game, F.when(F.col("n") < 10, F.col("half")).otherwise(F.coalesce("sixth", "near", "half")).cast("int").alias("split_at"))


def _first_key(p: Column, *names: str) -> Column:
    return F.coalesce(*[p[n] for n in names])


def player_row(p: Column, game_time: Column | None = None) -> dict[str, Column]:
    """One player of any vocabulary in the unified fields; numbers that do not parse are 0.

    Field goals of the older vocabulary are its own; those of the modern one are the sum of two- and three-point shots.
    Rates that need the team's totals (rebound percentages) are null here; see ``boxscore.rebound_rate``.
    """
    number = lambda *names: scalars.safe_int(_first_key(p, *names))
    legacy = boxscore.is_legacy(p["p2m"], p["p3m"], p["pts"])
    two, three = (number("p2m", "two_points_made"), number("p2a", "two_points_attempted")), (number("p3m", "three_points_made"), number("p3a", "three_points_attempted"))
    goals = [F.when(legacy, number(f"field_goals_{k}")).otherwise(x + y) for k, x, y in zip(("made", "attempted"), two, three)]
    year = F.year(game_time) if game_time is not None else F.lit(None).cast("int")
    born = scalars.birth_year(p["birth_year"].try_cast("int"), p["birth_date"], year)
    return {
        "player_name": F.trim(_first_key(p, "playername", "name")),
        "player_key": _first_key(p, "playerid", "player_id"),
        "shirt": _first_key(p, "shirtnumber", "no", "dorsal"),
        "birth_year": born,
        "age_at_game": scalars.age(born, year),
        "is_starter": F.coalesce(p["inn"] == "1", F.lower(p["is_starter"]) == "true", F.lit(False)),
        "minutes": scalars.minutes(p["minFormatted"], _first_key(p, "min", "minutes")),
        "points": number("pts", "points"),
        "fgm": goals[0],
        "fga": goals[1],
        "fg2m": two[0],
        "fg2a": two[1],
        "fg3m": three[0],
        "fg3a": three[1],
        "ftm": number("p1m", "free_throws_made"),
        "fta": number("p1a", "free_throws_attempted"),
        "orb": number("ro", "offensive_rebounds"),
        "drb": number("rd", "defensive_rebounds"),
        "reb": number("rt", "total_rebounds"),
        "ast": number("assist", "assists"),
        "stl": number("st", "steals"),
        "tov": number("to", "turnovers"),
        "blk": number("bs", "blocks"),
        "blocks_received": number("mt", "blocks_received"),
        "fouls": number("pf", "personal_fouls"),
        "fouls_received": number("rf", "fouls_received"),
        "plus_minus": scalars.safe_int(F.regexp_replace(_first_key(p, "pllss", "plus_minus"), r"^\+", "")),
        "efficiency": scalars.safe_float(_first_key(p, "val", "efficiency")),
        "is_legacy": legacy,
        "played": played_flag(_first_key(p, "min", "minutes")),
    }


def with_rates(rows: DataFrame) -> DataFrame:
    """The shooting percentages and advanced statistics of player rows."""
    c, rates = F.col, boxscore.advanced()
    return rows.withColumns(
        {
            **{k: rates[k] for k in ("field_goal_pct", "free_throw_pct", "true_shooting", "effective_fg", "turnover_rate", "free_throw_rate", "assist_turnover", "offensive_rating", "efficiency_rating", "usage", "win_shares", "win_shares_36")},
            "two_point_pct": boxscore.percentage(c("fg2m"), c("fg2a")),
            "three_point_pct": boxscore.percentage(c("fg3m"), c("fg3a")),
        }
    )


def assigned_sides(players: DataFrame, game: str = "game_code", pos: str = "pos", team: str = "team", home: str = "home_name", away: str = "away_name", starter: str = "is_starter", label: str = "is_home") -> DataFrame:
    """Players of flat lists with ``is_home`` filled in.

    A label stays. Else the team's name decides, the home side first (one name holds the other, or most words agree).
    Players that neither decides are dealt in document order: before the split point of the undecided ones at home,
    the others away (:func:`split_points`). Games without both names in their header keep what they have.
    """
    named = F.when(same_team(F.col(home), F.col(team)), True).when(same_team(F.col(away), F.col(team)), False)
    known = F.coalesce(F.col(label), F.when(F.coalesce(F.trim(F.col(team)), F.lit("")) != "", named))
    two = F.col(home).isNotNull() & F.col(away).isNotNull()
    rows = players.withColumn("__known", known)
    undecided = rows.where(F.col("__known").isNull() & two)
    order = Window.partitionBy(game).orderBy(pos)
    nth = undecided.select(game, pos, starter, (F.row_number().over(order) - 1).alias("__nth"))
    splits = split_points(nth.select(game, F.col("__nth").alias("pos"), F.col(starter).alias("starter")), game)
    dealt = nth.join(splits, game).select(game, pos, (F.col("__nth") < F.col("split_at")).alias("__dealt"))
    return rows.join(dealt, [game, pos], "left").withColumn(label, F.coalesce("__known", "__dealt")).drop("__known", "__dealt")


def player_rows(games: DataFrame) -> DataFrame:
    """One row per player of every format: the list of teams, the map of sides, the flat list."""
    head, box = F.col("HEADER"), F.col("BOXSCORE")
    code, at = head["game_code"].alias("game_code"), scalars.game_time(head["starttime"]).alias("game_time")
    opponent = lambda side, all_: F.get(F.filter(all_, lambda t: ~t["id"].eqNullSafe(side["id"])), 0)
    listed = games.where(F.size(F.coalesce(box["TEAM"], F.array())) > 0).select(code, at, F.posexplode(box["TEAM"]).alias("k", "side"), box["TEAM"].alias("all"))
    outcome = F.coalesce(F.col("side.win_lose"), win_lose(F.col("side.TOTAL.pts"), opponent(F.col("side"), F.col("all"))["TOTAL"]["pts"]))
    listed = listed.select("game_code", "game_time", "side", (F.col("k") == 0).alias("is_home"), (outcome == "W").alias("team_won"))
    mapped = games.where(box["SIDES"].isNotNull()).select(code, at, F.explode(box["SIDES"]).alias("k", "side")).select("game_code", "game_time", "side", (F.col("k") == "1").alias("is_home"), (F.col("side.won") == "1").alias("team_won"))
    of_sides = listed.unionByName(mapped).select("game_code", "game_time", "is_home", "team_won", F.col("side.id").alias("team"), F.posexplode("side.PLAYER").alias("pos", "p"))
    teams = F.coalesce(head["TEAM"], F.array())
    two = F.size(teams) >= 2
    name = lambda i: F.when(two, F.coalesce(F.get(head["TEAM"], i)["name"], F.lit("")))
    score = lambda i: F.coalesce(F.get(head["TEAM"], i)["pts"], F.get(head["TEAM"], i)["score"])
    flat = games.where(F.size(F.coalesce(box["PLAYER"], F.array())) > 0).select(code, at, name(0).alias("home_name"), name(1).alias("away_name"), win_lose(score(0), score(1)).alias("home_outcome"), F.posexplode(box["PLAYER"]).alias("pos", "p"))
    flat = flat.select("*", F.when(F.lower(F.col("p.is_home")).isin("true", "false"), F.lower(F.col("p.is_home")) == "true").alias("is_home"), F.col("p.team_name").alias("team"), F.coalesce(F.lower(F.col("p.is_starter")) == "true", F.lit(False)).alias("is_starter"))
    won = F.when(F.col("home_name").isNotNull() & F.col("is_home").isNotNull(), F.col("home_outcome") == F.when(F.col("is_home"), "W").otherwise("L"))
    figures = lambda: player_row(F.col("p"), F.col("game_time")).items()
    # figures and not texts go through the shuffles that deal players to their sides
    flat = flat.withColumn("row", F.struct(*[v.alias(k) for k, v in figures()])).drop("p", "game_time")
    flat = assigned_sides(flat).select("game_code", "team", "is_home", won.alias("team_won"), "pos", "row.*")
    return of_sides.select("game_code", "team", "is_home", "team_won", "pos", *[v.alias(k) for k, v in figures()]).unionByName(flat)


def first_source(df: DataFrame, key: str, rank: str, *order: str) -> DataFrame:
    """Of rows with the same key from several sources the one of the first source."""
    w = Window.partitionBy(key).orderBy(rank, *order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """``player_name,birth_year`` with a header."""
    return spark.read.schema("player_name string, birth_year int").csv(path, header=True)


def corrected(players: DataFrame, corrections: DataFrame, name: str = "player_name") -> DataFrame:
    """Birth years filled or replaced by the corrections; the last value wins if a name is corrected twice."""
    fixes = corrections.groupBy(F.col("player_name").alias(name)).agg(F.max("birth_year").alias("__fix"))
    return players.join(fixes, name, "left").withColumn("birth_year", F.coalesce("__fix", "birth_year")).drop("__fix")


def write_missing_birth_years(players: DataFrame, path: str) -> None:
    """A CSV of the players that lack one, for :func:`read_corrections` once it is filled in."""
    players.where(F.col("birth_year").isNull()).write.mode("overwrite").csv(path, header=True)
