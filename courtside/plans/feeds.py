"""Registered queries of documents and pages as they come from outside: made from the given tables, written, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.operators import mart
from courtside.plans import bind, catalog
from courtside.plans.catalog import GAMES, PERF, query, table
from courtside.plans.reports import _folder
from courtside.sources import ingest, pages

# --- documents --------------------------------------------------------------------------------------------------------


@query(f"""SELECT CASE game_id % 10 WHEN 3 THEN 'malformed' WHEN 7 THEN 'no game code' ELSE 'read' END AS status, count(*) AS n FROM (SELECT DISTINCT game_id FROM ({PERF})) GROUP BY 1""")
def s01_read_documents(spark, sf_dir):
    """A folder of documents of which some are cut off and some name no game: rows read and lines rejected, with the reason."""
    path, k = _folder(spark, "documents"), F.col("game_id") % 10
    doc = F.when(k == 3, F.substring("doc", F.lit(1), F.floor(F.length("doc") / 2).cast("int"))).when(k == 7, '{"HEADER": {"season": "2020"}}').otherwise(F.col("doc"))
    # a compressed file is read by one task, so its lines are bounded
    catalog._game_lines(spark, sf_dir).select(doc.alias("value")).write.option("maxRecordsPerFile", 1 << 16).text(path, compression="gzip")
    good, rejected = ingest.read_checked(spark, path)
    return good.select(F.lit("read").alias("status")).unionByName(rejected.select(F.col("reason").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey FROM orders""")
def s12_processed_codes(spark, sf_dir):
    """The distinct codes of each group."""
    return ingest.processed_codes(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey")


@query("""SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_orderkey) AS total, max(o_orderdate) AS last_update FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def s15_reset_state(spark, sf_dir):
    """The load state without one group's entry."""
    state = ingest.load_state(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", "o_orderdate")
    return ingest.reset_state(state, o_orderstatus="F", o_orderpriority="5-LOW").drop("last_code")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def s04_newest_unprocessed(spark, sf_dir):
    """The 500 newest of the orders that are not processed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ingest.unprocessed(o, o.where("o_orderkey % 3 = 0"), "o_orderkey", "o_orderdate", 500)


@query("""SELECT c_custkey, c_name AS player_name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1970 + c_custkey % 20 ELSE 1980 END AS INT) AS birth_year FROM customer""")
def s26_missing_birth_years(spark, sf_dir):
    """Players without a birth year written as CSV, filled in, and read back as corrections."""
    path, filled = _folder(spark, "missing"), _folder(spark, "filled")
    players = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("player_name"), F.when(F.col("c_custkey") % 3 != 0, 1980).cast("int").alias("birth_year"))
    ingest.write_missing_birth_years(players.select("player_name", "birth_year"), path)
    known = table(spark, sf_dir, "customer").select(F.col("c_name").alias("player_name"), (1970 + F.col("c_custkey") % 20).cast("int").alias("found"))
    ingest.read_corrections(spark, path).join(known, "player_name").select("player_name", F.coalesce("birth_year", "found").alias("birth_year")).write.csv(filled, header=True)
    return ingest.corrected(players, ingest.read_corrections(spark, filled)).select("c_custkey", "player_name", "birth_year")


@query(f"""SELECT competition_id, season_start, team_id, count(*) AS n, CAST(1 AS BIGINT) AS entries FROM ({PERF}) GROUP BY 1, 2, 3""")
def j15_surrogate_keys(spark, sf_dir):
    """Event rows that name their context by a key of its own, looked up again: rows and entries of each context."""
    natural = ["competition_id", "season_start", "team_id"]
    facts = bind.view(spark, sf_dir, bind.PERF).select(*natural)
    keys = mart.surrogate_keys(facts, natural, "context_key")
    resolved = facts.join(keys, natural).select("context_key")
    counted = resolved.groupBy("context_key").agg(F.count("*").alias("n")).join(keys, "context_key")
    return counted.groupBy(*natural).agg(F.sum("n").alias("n"), F.count("*").alias("entries"))


@query(f"""
WITH s AS (SELECT player_id, sum(points) AS points, sum(reb) AS reb, sum(ast) AS ast, sum(stl) AS stl, sum(blk) AS blk FROM ({PERF}) GROUP BY 1)
SELECT player_id, array_to_string(list_transform(list_sort([struct_pack(v := -points, n := 'points'), struct_pack(v := -reb, n := 'reb'), struct_pack(v := -ast, n := 'ast'), struct_pack(v := -stl, n := 'stl'), struct_pack(v := -blk, n := 'blk')])[1:3], lambda x: x.n), ',') AS strengths FROM s""")
def t07_strengths(spark, sf_dir):
    """The three largest totals of every player."""
    stats = ("points", "reb", "ast", "stl", "blk")
    totals = bind.view(spark, sf_dir, bind.PERF).groupBy("player_id").agg(*[F.sum(x).alias(x) for x in stats])
    return totals.select("player_id", F.array_join(mart.top_features({x: F.col(x) for x in stats}, 3), ",").alias("strengths"))


# --- pages ------------------------------------------------------------------------------------------------------------


def _game_pages(spark, sf_dir):
    """``(page_id, html)``: a page for each game: marked-up fields, the score by quarters, and a table of its players with a header, a total and a separator row."""
    c, text = F.col, lambda x: x.cast("string")
    shots = lambda made, tried: F.format_string("%d/%d %d,5%%", made, tried, made % 100)

    def row(r):
        cells = [F.concat(F.lit("<a href='?j="), text(r["squad_id"]), F.lit("'>Player "), text(r["squad_id"]), F.lit("</a>")), F.format_string("%d:00", r["minutes"].cast("int")), text(r["points"]), shots(r["fgm"] - r["fg3m"], r["fga"]), shots(r["fg3m"], r["fg3a"]), shots(r["ftm"], r["fta"]), *[text(r[x]) for x in ("orb", "drb", "reb", "ast", "stl", "tov", "blk")]]
        cells += [F.lit("&nbsp;")] * (20 - len(cells))
        return F.concat(F.lit("<tr class='row'>"), *[x for cell in cells for x in (F.lit("<td>"), cell, F.lit("</td>"))], F.lit("</tr>"))

    # numbers are gathered, and marked up once they have met
    numbers = ("minutes", "points", "fgm", "fg3m", "fga", "fg3a", "ftm", "fta", "orb", "drb", "reb", "ast", "stl", "tov", "blk")
    lines = F.array_sort(F.collect_list(F.struct("line_no", "part_id", "squad_id", "price", *numbers)))
    rows = bind.view(spark, sf_dir, bind.PERF).groupBy("game_id").agg(lines.alias("lines")).select("game_id", F.array_join(F.transform("lines", row), "").alias("players"))
    field = lambda name, *value: F.concat(F.lit(f'<span id="_ctl0_MainContent_{name}">'), *value, F.lit("</span>"))
    part = lambda x, k: text(F.floor(c(x) / 4) if k < 3 else c(x) - 3 * F.floor(c(x) / 4))
    team = lambda side, of: F.concat(F.lit(f'<div class="columna equipo {side}"><span class="nombre">Team '), text(c(f"{of}_id")), F.lit('</span><span class="resultado">'), text(c(f"{of}_score")), F.lit("</span></div>"))
    quarters = lambda side, of: F.concat(F.lit(f'<div class="columna equipo {side}">'), *[x for k in range(4) for x in (F.lit("<span>"), part(f"{of}_score", k), F.lit("</span>"))], F.lit("</div>"))
    both = lambda f: F.concat(f("local", "home"), f("visitante", "away"))
    html = F.concat(field("pabellon", F.lit("Hall "), text(c("competition_id"))), field("localidad", F.lit("&nbsp;")), field("arbitro1Nombre", F.lit("REF, "), text(c("game_id") % 7)), field("arbitro2Nombre", F.lit("")), F.lit('<div class="box-marcador">'), both(team), F.lit('<div class="fila parciales">'), both(quarters), F.lit("</div></div>"))
    dates = F.concat(F.lit("<table><tr><th>Fecha</th><th>Partido 01/01/1900 <a href='?p=0'>0</a></th></tr><tr><td>"), F.date_format("game_date", "dd/MM/yyyy"), F.lit("<td><a href='Partido.aspx?p="), text(c("game_id")), F.lit("'>ver</a></tr><tr><td>no link</td></tr></table>"))
    stats = F.concat(F.lit("<table><tr>" + "<th>x</th>" * 20 + "</tr>"), c("players"), F.lit("<tr class='row-total'>" + "<td>1</td>" * 20 + "</tr><tr><td colspan=20>short</td></tr></table>"))
    games = bind.view(spark, sf_dir, bind.GAMES).join(rows, "game_id")
    return games.select(c("game_id").alias("page_id"), F.concat(html, dates, stats).alias("html"))


@query(f"""SELECT game_id AS page_id, CAST(game_id AS VARCHAR) AS code, strftime(game_date, '%d/%m/%Y') AS date FROM ({GAMES}) WHERE game_id IN (SELECT game_id FROM ({PERF}))""")
def s21_result_rows(spark, sf_dir):
    """The codes of result tables with the date of their row, without header rows."""
    return pages.result_rows(_game_pages(spark, sf_dir), r"[?&]p=(\d+)")


QUARTERS = "concat_ws(',', {0} // 4, {0} // 4, {0} // 4, {0} - 3 * ({0} // 4))"


@query(f"""SELECT game_id AS page_id, concat('Hall ', competition_id) AS venue, CAST(NULL AS VARCHAR) AS city, concat('REF, ', game_id % 7) AS referees, concat('Team ', home_id) AS home_team, concat('Team ', away_id) AS away_team, home_score, away_score,
  {QUARTERS.format("home_score")} AS home_quarters, {QUARTERS.format("away_score")} AS away_quarters FROM ({GAMES}) WHERE game_id IN (SELECT game_id FROM ({PERF}))""")
def s22_game_boxes(spark, sf_dir):
    """Venue, referees, teams, final and quarter scores of every game's page."""
    joined = lambda x, by: F.array_join(x, by).alias(x)
    return pages.game_boxes(_game_pages(spark, sf_dir)).select("page_id", "venue", "city", joined("referees", "; "), "home_team", "away_team", "home_score", "away_score", joined("home_quarters", ","), joined("away_quarters", ","))


@query(f"""SELECT game_id AS page_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY line_no, part_id, squad_id, price) - 1 AS INT) AS row, concat('Player ', squad_id) AS name, CAST(minutes AS INT) AS minutes, points, fgm - fg3m AS fg2m, fga AS fg2a, CAST((fgm - fg3m) % 100 + 0.5 AS DOUBLE) AS fg2_pct, fg3m, fg3a, ftm, fta, orb, drb, reb, ast, stl, tov, blk FROM ({PERF})""")
def s23_player_tables(spark, sf_dir):
    """One row for each player of every game's page, with the shots cut into made, attempted and percentage."""
    c = F.col
    rows = pages.table_rows(_game_pages(spark, sf_dir))
    cell = lambda k: F.get("cells", F.lit(k))
    (two, two_of, pct), (three, three_of, _), (free, free_of, _) = (pages.made_attempted(cell(k)) for k in (3, 4, 5))
    minutes = F.regexp_extract(cell(1), r"^(\d+):", 1).cast("int")
    counts = [cell(6 + k).cast("int").alias(x) for k, x in enumerate(("orb", "drb", "reb", "ast", "stl", "tov", "blk"))]
    return rows.select("page_id", c("row"), cell(0).alias("name"), minutes.alias("minutes"), cell(2).cast("int").alias("points"), two.alias("fg2m"), two_of.alias("fg2a"), pct.alias("fg2_pct"), three.alias("fg3m"), three_of.alias("fg3a"), free.alias("ftm"), free_of.alias("fta"), *counts)
