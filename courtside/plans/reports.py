"""Further registered queries: sources and sinks, identities, rosters and ranked reports, with the SQL that checks them."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.functions import names, scalars
from courtside.operators import aggregates, identity, mart, scoring
from courtside.plans import bind, catalog
from courtside.plans.catalog import CAREER, GAMES, MATCH, NORMAL, ORACLE_SQL, PERF, PROFILES, QUERIES, SCORED, query, r, table
from courtside.plans.storage import saved, shared_folder, small_side
from courtside.sources import ingest, tables
from courtside.streaming import incremental


def _folder(spark, name: str) -> str:
    return posixpath.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def s10_filtered_orders(spark, sf_dir):
    """Orders by the values of two columns."""
    return ingest.filtered(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'""")
def s11_filtered_count(spark, sf_dir):
    """How many orders have a status."""
    return ingest.filtered_count(table(spark, sf_dir, "orders"), o_orderstatus="F")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def s06_appended(spark, sf_dir):
    """New orders, but for those whose key is there already."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ingest.appended(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0"), ["o_orderkey"])


@query("""SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS inserted, count(*) FILTER (o_orderkey % 3 = 0) AS updated, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS skipped FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""")
def s07_upsert_counts(spark, sf_dir):
    """Rows that an upsert inserts, updates and skips for want of a key."""
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderkey % 2 = 0 or o_orderkey % 5 = 0").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("k"))
    return ingest.upsert_counts(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k")), new, ["k"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""")
def s08_existing(spark, sf_dir):
    """Orders that have a large line."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.existing(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lines, "o_orderkey")


@query(ORACLE_SQL["a35_consolidated"])
def s18_rebuilt(spark, sf_dir):
    """Consolidated ids written, truncated and written anew, and read back."""
    path, out = _folder(spark, "rebuilt"), identity.consolidated(bind.view(spark, sf_dir, bind.PROFILES))
    ingest.rebuilt(out.where("profile_id % 2 = 0"), path)
    return ingest.rebuilt(out, path)


@query("""SELECT collection, count(*) AS n, sum(CAST(o_orderkey AS BIGINT)) AS keys FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS collection FROM orders) GROUP BY 1""")
def u01_united_collections(spark, sf_dir):
    """Two collections of orders as one table."""
    o = table(spark, sf_dir, "orders")
    both = ingest.union_of(male=o.where("o_custkey % 2 = 0"), female=o.where("o_custkey % 2 = 1").drop("o_totalprice"))
    return both.groupBy("collection").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"""SELECT DISTINCT level, season_start, competition_id FROM ({PERF})""")
def u02_contexts(spark, sf_dir):
    """The distinct contexts of all events."""
    return bind.view(spark, sf_dir, bind.PERF).select("level", "season_start", "competition_id").distinct()


@query("""SELECT o_orderkey AS code, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS source FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def n15_first_source(spark, sf_dir):
    """Keys of two sources, each from the first that has it."""
    code = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code"))
    both = code.where("code % 2 = 0").withColumn("source", F.lit(0)).unionByName(code.where("code % 3 = 0").withColumn("source", F.lit(1)))
    return ingest.first_source(both, "code", "source")


@query(f"""
WITH t AS (SELECT game_id, game_id % 3 AS format, max(game_date) AS game_time, sum(CASE WHEN line_no % 2 = 0 THEN points ELSE 0 END) AS h, sum(CASE WHEN line_no % 2 = 1 THEN points ELSE 0 END) AS a, count(DISTINCT line_no % 2) AS sides FROM ({PERF}) GROUP BY 1, 2)
SELECT CAST(game_id AS VARCHAR) AS game_code, '' AS season, 'Único' AS group_name, 'masc' AS gender, date_trunc('minute', CAST(game_time AS TIMESTAMP)) AS game_time, CASE WHEN format = 2 THEN CAST(h AS INT) END AS home_score, CASE WHEN format = 2 THEN CAST(a AS INT) END AS away_score, CASE WHEN format = 2 THEN CAST(h - a AS INT) END AS score_diff, format = 0 AND sides = 2 AS is_valid FROM t""")
def n02_headers(spark, sf_dir):
    """The headers of the documents that n06 flattens, with defaults."""
    return ingest.header(catalog._game_documents(spark, sf_dir)).select("game_code", "season", "group_name", "gender", "game_time", "home_score", "away_score", "score_diff", "is_valid")


@query("""
WITH p AS (SELECT o_custkey AS game, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_orderkey % 3 = 0 AS starter FROM orders),
q AS (SELECT *, sum(CAST(starter AS INT)) OVER (PARTITION BY game ORDER BY pos) AS run, lag(starter) OVER (PARTITION BY game ORDER BY pos) AS before, count(*) OVER (PARTITION BY game) AS n FROM p)
SELECT game, CAST(CASE WHEN max(n) < 10 THEN floor(max(n) / 2) ELSE coalesce(min(CASE WHEN starter AND run = 6 THEN pos END), min(CASE WHEN starter AND NOT before AND pos BETWEEN floor(n / 2) - 2 AND floor(n / 2) + 2 THEN pos END), floor(max(n) / 2)) END AS INT) AS split_at FROM q GROUP BY game""")
def w09_split_points(spark, sf_dir):
    """Where the second half of each customer's orders begins, by the rules for flat player lists."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("game"), at.alias("pos"), (F.col("o_orderkey") % 3 == 0).alias("starter"))
    return ingest.split_points(rows, "game")


@query("""SELECT c_custkey, c_name AS player_name, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1990 + c_custkey % 10 WHEN c_custkey % 3 = 0 THEN NULL ELSE 1980 END AS INT) AS birth_year FROM customer""")
def s25_corrected(spark, sf_dir):
    """Birth years filled and replaced by the corrections of a CSV file."""
    path = _folder(spark, "corrections")
    c = table(spark, sf_dir, "customer")
    c.where("c_custkey % 4 = 0").select(F.col("c_name").alias("player_name"), (1990 + F.col("c_custkey") % 10).alias("birth_year")).write.csv(path, header=True)
    players = c.select("c_custkey", F.col("c_name").alias("player_name"), F.when(F.col("c_custkey") % 3 != 0, 1980).cast("int").alias("birth_year"))
    return ingest.corrected(players, ingest.read_corrections(spark, path)).select("c_custkey", "player_name", "birth_year")


@query("""SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events""")
def x01_streamed_events(spark, sf_dir):
    """Events that come in two drops, of which the second has the older half and some of the first again, and are then read anew by a stream that knows nothing of the first; each is there once."""
    source, target = _folder(spark, "drops"), _folder(spark, "ingested")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    schema, checkpoint = events.schema, _folder(spark, "stream")
    middle = events.agg(F.timestamp_seconds(F.avg(F.unix_timestamp("ts"))).alias("t")).first().t
    late = F.col("ts") < F.lit(middle)
    for drop, again in ((events.where(~late), checkpoint), (events.where(late | (F.col("event_id") % 3 == 0)), checkpoint), (None, _folder(spark, "stream"))):
        if drop is not None:
            drop.write.mode("append").parquet(source)
        incremental.ingest(spark, source, schema, target, again, "event_id", "ts").awaitTermination()
    return incremental.ingested(spark, target, schema).select("event_id", "user_id", "ts")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'third' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS stage, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 * o_custkey WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE o_custkey END AS BIGINT) AS value FROM orders""")
def s16_keyed_table(spark, sf_dir):
    """Orders in a table laid out by key, of which a half and then a quarter is replaced in place."""
    path = _folder(spark, "keyed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("value"), F.col("o_orderdate").alias("at"))
    stages = (("first", rows), ("second", rows.where("o_orderkey % 2 = 0").withColumn("value", F.col("value") + 1)), ("third", rows.where("o_orderkey % 4 = 0").withColumn("value", 2 * F.col("value"))))
    for stage, part in stages:
        new = part.withColumn("stage", F.lit(stage))
        tables.upsert(new, path, ["o_orderkey"], "at", 32)
    return tables.read_table(spark, path, new.schema).select("o_orderkey", "stage", "value")


RUNNING = ["points", "efficiency"]


@query(f"""SELECT player_id, season_start, competition_id, games, avg_points, avg_efficiency, std_points, std_efficiency, trend_points, trend_efficiency, CAST(total_points AS DOUBLE) AS total_points, first_game, last_game FROM ({catalog.SEASON})""")
def x02_streamed_moments(spark, sf_dir):
    """Season figures of every player kept by a stream that gets the days of all seasons in three drops, interleaved."""
    source, target, checkpoint = (_folder(spark, x) for x in ("games", "moments", "stream"))
    keys, order = ["player_id", "season_start", "competition_id"], ["game_id", "line_no", "part_id", "squad_id", "price"]
    rows = saved(bind.view(spark, sf_dir, bind.RATED).select(*keys, "game_date", *order, *RUNNING))
    for k in (2, 0, 1):
        rows.where(F.pmod(F.unix_date(F.to_date("game_date")), F.lit(3)) == k).write.mode("append").parquet(source)
        incremental.ingest_moments(spark, source, rows.schema, target, checkpoint, keys, "game_date", RUNNING, order).awaitTermination()
    out = incremental.moments(spark, target, rows.schema, keys, "game_date", RUNNING, order)
    return out.drop("total_efficiency").withColumnsRenamed({"first_at": "first_game", "last_at": "last_game"})


# --- scalars over whole tables ----------------------------------------------------------------------------------------

LEAGUE = "CASE o_custkey % 6 WHEN 0 THEN 'acb' WHEN 1 THEN 'L.F.-2' WHEN 2 THEN 'Liga Femenina' WHEN 3 THEN 'LEB PLATA' WHEN 4 THEN NULL ELSE o_orderpriority END"


@query(f"""
SELECT o_orderkey, CASE WHEN league LIKE '%Femenina%' THEN 'fem' ELSE 'masc' END AS gender, level, CAST(CASE level WHEN 1 THEN 1.5 WHEN 2 THEN 1.25 ELSE 1.0 END AS DOUBLE) AS weight, seasons, CAST(code AS VARCHAR) AS year, number
FROM (SELECT o_orderkey, {LEAGUE} AS league, CAST(CASE o_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN year(o_orderdate) >= 1996 THEN 3 ELSE 2 END WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS INT) AS level, CAST(greatest(0, year(o_orderdate) - 1995 + 1) AS INT) AS seasons,
  CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE 2000 + year(o_orderdate) % 100 END AS code, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(o_orderkey AS INT) END AS number FROM orders)""")
def p42_levels(spark, sf_dir):
    """Level, weight and gender of each order's league, and parsed years and numbers."""
    c = F.col
    league, year = F.expr(LEAGUE), F.year("o_orderdate")
    level = scalars.season_level(league, year, changing={"L.F.-2": (1996, 2, 3)})
    written = F.when(c("o_orderkey") % 2 == 0, F.format_string("%d/%02d", year, (year + 1) % 100)).otherwise(F.format_string("%02d", year % 100))
    number = F.when(c("o_orderkey") % 5 == 0, "x").otherwise(F.concat(F.lit(" "), c("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.gender(league).alias("gender"), level.alias("level"), scalars.level_weight(level).alias("weight"), F.size(scalars.seasons_between(F.lit(1995), year)).alias("seasons"), scalars.four_digit_year(written).alias("year"), scalars.safe_int(number, -1).alias("number"))


# --- identities -------------------------------------------------------------------------------------------------------


@query(f"""SELECT CASE WHEN id1 = 1 THEN id2 ELSE id1 END AS profile_id, score, confidence FROM ({MATCH}) WHERE id1 = 1 OR id2 = 1""")
def j11_matches_of(spark, sf_dir):
    """One profile against all others."""
    return identity.matches_of(bind.view(spark, sf_dir, bind.PROFILES), 1)


@query(f"""SELECT g.name, g.birth_year, count(*) AS members, min(profile_id) AS first_profile FROM (SELECT DISTINCT name, birth_year FROM ({PROFILES}) WHERE trim(name) <> '') g JOIN ({PROFILES}) p ON p.name = g.name AND (p.birth_year IS NULL OR p.birth_year = g.birth_year) GROUP BY ALL""")
def j12_career_members(spark, sf_dir):
    """Profiles of each identity, those without a birth year among them."""
    p = bind.view(spark, sf_dir, bind.PROFILES)
    identities = aggregates.identity_groups(p, "name", "birth_year").select("name", "birth_year")
    return scoring.career_members(identities, p.select("name", "birth_year", "profile_id")).groupBy("name", "birth_year").agg(F.count("*").alias("members"), F.min("profile_id").alias("first_profile"))


@query(f"""SELECT * FROM (SELECT name, season_start, profile_id, team_id, row_number() OVER (PARTITION BY name, season_start ORDER BY profile_id DESC) AS rn FROM ({PROFILES})) WHERE rn = 1""")
def w04_latest_profiles(spark, sf_dir):
    """The latest profile of each name and season."""
    p = bind.view(spark, sf_dir, bind.PROFILES).select("name", "season_start", "profile_id", "team_id")
    return mart.latest_of(p, ["name", "season_start"], "profile_id").withColumn("rn", F.lit(1))


@query(f"""SELECT confidence, count(*) AS pairs, count(*) FILTER (id1 % 5 = 0) AS confirmed, count(*) FILTER (id1 % 5 = 1) AS rejected, count(*) FILTER (id1 % 5 > 1) AS pending FROM ({MATCH}) WHERE confidence IN ('very_high', 'high') GROUP BY 1""")
def r30_validated(spark, sf_dir):
    """Decisions applied to the candidates of a high confidence, counted by status."""
    pairs = saved(identity.candidates(bind.view(spark, sf_dir, bind.PROFILES), 0.7).where(F.col("confidence").isin("very_high", "high")).select("id1", "id2", "confidence"))
    decisions = pairs.where("id1 % 5 < 2").select("id1", "id2", F.when(F.col("id1") % 5 == 0, "confirmed").otherwise("rejected").alias("status"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return identity.validated(pairs, decisions).groupBy("confidence").agg(F.count("*").alias("pairs"), count("confirmed"), count("rejected"), count("pending"))


@query(f"""SELECT id1, a.name AS name1, id2, b.name AS name2, score, confidence FROM ({MATCH}) m JOIN ({PROFILES}) a ON id1 = a.profile_id JOIN ({PROFILES}) b ON id2 = b.profile_id WHERE score >= 0.75 AND id1 % 5 <> 0 ORDER BY score DESC, id1, id2 LIMIT 50""")
def t13_pending_candidates(spark, sf_dir):
    """The best candidates that are still pending."""
    p = bind.view(spark, sf_dir, bind.PROFILES)
    decided = lambda pairs: identity.validated(pairs, pairs.where("id1 % 5 = 0").select("id1", "id2", F.lit("confirmed").alias("status")))
    return catalog._best_candidates(p, decided, "pending")


CONSOLIDATED = f"SELECT p.*, min(profile_id) OVER (PARTITION BY {NORMAL}) AS consolidated_id FROM ({PROFILES}) p"


def _consolidated(spark, sf_dir):
    p = bind.view(spark, sf_dir, bind.PROFILES)
    return p.join(identity.consolidated(p).select("profile_id", "consolidated_id"), "profile_id").where("consolidated_id is not null")


@query(f"""WITH c AS ({CONSOLIDATED}) SELECT consolidated_id, profile_id, name, season_start FROM c WHERE consolidated_id = (SELECT consolidated_id FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def t15_identity_profiles(spark, sf_dir):
    """All profiles of the consolidated identity that has most, in season order."""
    rows = _consolidated(spark, sf_dir)
    first = mart.top(rows.groupBy("consolidated_id").agg(F.count("*").alias("n")), 1, [F.desc("n"), F.col("consolidated_id")]).select("consolidated_id")
    return rows.join(F.broadcast(first), "consolidated_id").select("consolidated_id", "profile_id", "name", "season_start").orderBy("season_start", "profile_id")


@query(f"""WITH c AS ({CONSOLIDATED}) SELECT consolidated_id, count(*) AS profiles, count(DISTINCT season_start) AS seasons FROM c GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""")
def t04_top_identities(spark, sf_dir):
    """The consolidated identities with the most profiles."""
    grouped = _consolidated(spark, sf_dir).groupBy("consolidated_id").agg(F.count("*").alias("profiles"), F.count_distinct("season_start").alias("seasons"))
    return mart.top(grouped, 20, [F.desc("profiles"), F.desc("seasons"), F.col("consolidated_id")])


@query(f"""SELECT name, count(DISTINCT season_start) AS members FROM ({PROFILES}) WHERE lower(name) LIKE '%gear%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def a45_name_search(spark, sf_dir):
    """Seasons of each name that holds a text."""
    p = bind.view(spark, sf_dir, bind.PROFILES).where(names.contains_text(F.col("name"), "Gear"))
    return mart.top(aggregates.distinct_members(p, ["name"], "season_start"), 50, [F.desc("members"), F.col("name")])


# --- rosters and ranked reports ---------------------------------------------------------------------------------------

#: The teams and seasons that players are registered with.
PLAYERS = "SELECT c_custkey AS player_id, CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS BIGINT) AS team_id, CAST(1995 + c_custkey % 3 AS INT) AS season_start FROM {customer}"


@query(f"""
SELECT g.team_id, count(DISTINCT f.player_id) AS players FROM (SELECT game_id, season_start, home_id AS team_id FROM ({GAMES}) UNION SELECT game_id, season_start, away_id FROM ({GAMES})) g JOIN ({PERF}) f ON g.game_id = f.game_id JOIN ({bind.duckdb_sql(PLAYERS)}) p ON f.player_id = p.player_id
WHERE g.season_start = 1996 AND p.season_start = 1996 AND (g.team_id = f.team_id OR EXISTS (SELECT 1 FROM ({bind.duckdb_sql(PLAYERS)}) q WHERE q.player_id = p.player_id AND q.season_start = p.season_start AND q.team_id = g.team_id)) GROUP BY 1 HAVING count(DISTINCT f.player_id) >= 5""")
def j18_active_teams(spark, sf_dir):
    """Teams of the current season with players who played for them or are registered with them."""
    return mart.active_teams(bind.view(spark, sf_dir, bind.GAMES), bind.view(spark, sf_dir, bind.PERF), bind.view(spark, sf_dir, PLAYERS), 1996)


@query(f"""
WITH c AS ({CAREER}), l AS (SELECT * FROM (SELECT player_id, season_start, team_id, row_number() OVER (PARTITION BY player_id, season_start ORDER BY part_id DESC) AS rn FROM (SELECT player_id, season_start, team_id, max(part_id) AS part_id FROM ({PERF}) GROUP BY ALL)) WHERE rn = 1)
SELECT CAST(c.player_id AS VARCHAR) AS name, c.birth_year, c.last_season, c.seasons, c.unified, c.tier, l.team_id FROM c LEFT JOIN l ON c.player_id = l.player_id AND c.last_season = l.season_start WHERE c.unified >= 0.2 ORDER BY c.unified DESC, CAST(c.player_id AS VARCHAR), c.birth_year LIMIT 50""")
def j16_career_list(spark, sf_dir):
    """The best careers with the latest team of their last season."""
    c = F.col
    careers = catalog.rounded(catalog._careers(spark, sf_dir).withColumn("name", c("player_id").cast("string")))
    best = small_side(mart.top(careers, 50, [F.desc("unified"), c("name"), c("birth_year")], c("unified") >= 0.2))
    # the games of these players alone, so that the facts are not shuffled once more for the teams of fifty
    players = F.broadcast(best.select(c("player_id").alias("o_custkey")))
    orders = small_side(table(spark, sf_dir, "orders").join(players, "o_custkey", "left_semi"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    facts = bind.view(spark, sf_dir, bind.PERF, orders=orders, lineitem=lines)
    profiles = facts.groupBy(c("player_id").cast("string").alias("name"), "season_start", "team_id").agg(F.max("part_id").alias("profile_id"))
    return mart.career_list(best, profiles, "name", 0.2, 50).select("name", "birth_year", "last_season", "seasons", "unified", "tier", "team_id")


@query(f"""
WITH c AS ({CAREER}) SELECT player_id, tier, CASE tier WHEN 'elite' THEN 'ELI' WHEN 'very_high' THEN 'VER' WHEN 'high' THEN 'HIG' WHEN 'medium' THEN 'MED' ELSE 'LOW' END AS code, tier IN ('elite', 'very_high', 'high') AND unified < career_avg AS conservative,
  concat_ws(',', CASE WHEN rising_star THEN 'rising' END, CASE WHEN peak_performer THEN 'peak' END, CASE WHEN established THEN 'veteran' END, CASE WHEN trajectory > 0.15 THEN 'improving' WHEN trajectory < -0.10 THEN 'declining' END) AS labels FROM c""")
def p51_career_labels(spark, sf_dir):
    """Codes, alerts and labels of every career."""
    c = F.col
    rows = catalog._careers(spark, sf_dir)
    return rows.select("player_id", "tier", scalars.tier_code(c("tier")).alias("code"), scalars.is_conservative(c("tier"), c("unified"), c("career_avg")).alias("conservative"), F.concat_ws(",", scoring.career_labels()).alias("labels"))


YOUNG = f"WITH {SCORED} SELECT player_id, team_id, season_start, {r('potential', 'potential')} FROM sc WHERE coalesce(age < 30, false) AND s_perf >= 0.3 AND eligible"


@query(f"""SELECT * FROM ({YOUNG}) ORDER BY potential DESC, player_id, team_id, season_start LIMIT 10""")
def t03_young_talents(spark, sf_dir):
    """The ten best eligible profiles under an age, of some performance."""
    c = F.col
    rows = catalog.rounded(catalog._scored(spark, sf_dir).where((c("season_start") - c("birth_year") < 30) & (c("performance_score") >= 0.3) & c("eligible")).select("player_id", "team_id", "season_start", "potential"))
    return mart.top(rows, 10, [F.desc("potential"), c("player_id"), c("team_id"), c("season_start")])


@query(f"""SELECT player_id, season_start, competition_id, games, trend_points FROM ({ORACLE_SQL["a20_season_aggregates"]}) WHERE trend_points > 0.25 AND games >= 10 ORDER BY trend_points DESC, player_id, season_start, competition_id LIMIT 20""")
def t09_rising_players(spark, sf_dir):
    """The seasons that rose most."""
    c = F.col
    rows = QUERIES["a20_season_aggregates"](spark, sf_dir).select("player_id", "season_start", "competition_id", "games", "trend_points")
    return mart.top(rows, 20, [F.desc("trend_points"), c("player_id"), c("season_start"), c("competition_id")], (c("trend_points") > 0.25) & (c("games") >= 10))


@query(f"""SELECT player_id, season_start, team_id, avg_minutes, points_36 FROM ({ORACLE_SQL["a08_profile_metrics"]}) WHERE avg_minutes >= 10 ORDER BY points_36 DESC, player_id, season_start, team_id LIMIT 50""")
def t11_points_per_36(spark, sf_dir):
    """Profiles by points in 36 minutes, with a floor of minutes."""
    c = F.col
    rows = QUERIES["a08_profile_metrics"](spark, sf_dir).select("player_id", "season_start", "team_id", "avg_minutes", "points_36")
    return mart.top(rows, 50, [F.desc("points_36"), c("player_id"), c("season_start"), c("team_id")], c("avg_minutes") >= 10)


@query(f"""SELECT player_id, season_start, level, z FROM ({ORACLE_SQL["a24_season_standing"]}) WHERE z >= 2""")
def t12_elite_anywhere(spark, sf_dir):
    """Season averages two deviations above their context, best first."""
    return QUERIES["a24_season_standing"](spark, sf_dir).select("player_id", "season_start", "level", "z").where("z >= 2").orderBy(F.desc("z"), "player_id", "season_start", "level")


@query(f"""
WITH m AS (SELECT player_id AS profile_id, avg(points) AS avg_points, count(*) AS games FROM ({PERF}) GROUP BY 1), c AS (SELECT player_id AS profile_id, max(unified) AS unified FROM ({CAREER}) GROUP BY 1)
SELECT p.profile_id, name, games, {r("avg_points", "avg_points")}, unified FROM ({PROFILES}) p LEFT JOIN m USING (profile_id) LEFT JOIN c USING (profile_id)""")
def j14_profile_details(spark, sf_dir):
    """Every profile with its metrics and potential, where there are any."""
    metrics = bind.view(spark, sf_dir, bind.PERF).groupBy(F.col("player_id").alias("profile_id")).agg(F.avg("points").alias("avg_points"), F.count("*").alias("games"))
    potential = catalog._careers(spark, sf_dir).groupBy(F.col("player_id").alias("profile_id")).agg(F.max("unified").alias("unified"))
    return mart.profile_detail(bind.view(spark, sf_dir, bind.PROFILES).select("profile_id", "name"), metrics, potential).select("profile_id", "name", "games", "avg_points", "unified")
