import pytest
from pyspark.sql import functions as F

from courtside.functions import boxscore, names, scalars
from courtside.operators import aggregates, identity, mart, normalize, quality, scoring
from courtside.plans import components, model
from courtside.sources import ingest, pages
from courtside.streaming import incremental


def one(spark, *columns):
    row = tuple(spark.range(1).select(*columns).first())
    return row[0] if len(row) == 1 else row


def lit(x):
    return F.lit(x)


def test_conversions(spark):
    null = lit(None).cast("string")
    assert one(spark, *[scalars.safe_int(lit(x)) for x in ("12.5", " 7 ", "+5", "", "x")], scalars.safe_int(null, 3)) == (0, 7, 5, 0, 0, 3)
    assert one(spark, *[scalars.minutes(lit(a), lit(b)) for a, b in (("28:30", None), (None, "90"), (None, "1:30"), ("", "x"), (None, None))]) == (28.5, 1.5, 1.5, 0.0, 0.0)
    assert one(spark, *[scalars.game_year(lit(x)) for x in ("2024-09-15 18:00:00", "15-09-2023 - 18:00", "01-02-2022", "2021-01-01", "soon", None)]) == (2024, 2023, 2022, 2021, None, None)
    assert one(spark, *[scalars.season_start(lit(x)) for x in ("2023-2024", "2023/24", "2023", "2023-2025", "1800-1801", "x", None)]) == (2023, 2023, 2023, None, None, None, None)
    assert one(spark, scalars.shifted_season(lit("2023/2024"), 1), scalars.shifted_season(lit("2023-2024"), -1), scalars.compare_seasons(lit("2020-2021"), lit("2021-2022"))) == ("2024/2025", "2022-2023", -1)
    assert one(spark, *[scalars.four_digit_year(lit(x)) for x in ("2024/25", "24", "2024", "x")]) == ("2024", "2024", "2024", None)
    assert one(spark, scalars.seasons_between(lit(2020), lit(2022)), scalars.seasons_between(lit(3), lit(2))) == ([2020, 2021, 2022], [])
    assert one(spark, scalars.birth_year(lit(1990), null, lit(2020)), scalars.birth_year(lit(2019), lit("05/06/1995"), lit(2020)), scalars.birth_year(lit(1940), null, lit(None).cast("int"))) == (1990, 1995, None)
    assert one(spark, *[scalars.gender(lit(x)) for x in ("Liga Femenina", "ACB")], scalars.tier_code(lit("very_high")), scalars.tier_code(null)) == ("fem", "masc", "VER", "---")
    assert one(spark, *[scalars.match_weight(lit(x)) for x in ("Final Four", "Semifinal", "SUPERCOPA final", "Copa", "x")], scalars.match_weight(null)) == (1.5, 1.4, 1.2, 1.3, 1.0, 1.0)
    levels = lambda n, y: scalars.season_level(lit(n), lit(y), {"TOP": 1}, {"MID": (2021, 2, 3)})
    assert one(spark, levels("top", 2020), levels("MID", 2020), levels("MID", 2021), levels("?", 1)) == (1, 2, 3, 4)


def test_box_score(spark):
    n = lambda *v: [lit(x) for x in v]
    assert one(spark, boxscore.true_shooting(*n(20, 10, 5)), boxscore.true_shooting(*n(0, 0, 0)), boxscore.assist_turnover(*n(4, 0)), boxscore.assist_turnover(*n(0, 0)), boxscore.percentage(*n(1, 0))) == (pytest.approx(20 / 24.4), None, 4.0, None, 0.0)
    assert one(spark, boxscore.win_shares(*n(20.0, 40)), boxscore.rebound_rate(*n(5, 20, 5)), boxscore.per_36(*n(10, 18))) == (0.2, 0.2, 20.0)


def test_names(spark):
    normal = lambda x: names.normalise_name(lit(x).cast("string"))
    assert one(spark, normal("  josé  Pérez-López! "), normal(None), normal("Ñandú Øx")) == ("JOSE PEREZ-LOPEZ", "", "NANDU X")
    parts = lambda x: names.name_parts(normal(x))
    assert [tuple(p) for p in one(spark, parts("Pérez Ruiz, Juan Luis"), parts("J.M. Pérez"), parts("Pérez"), parts("Juan Pérez Ruiz"), parts(""))] == [("J", "JUAN", "PEREZ RUIZ"), ("J", "", "PEREZ"), ("", "", "PEREZ"), ("J", "JUAN", "PEREZ RUIZ"), ("", "", "")]
    like = lambda a, b: names.name_similarity(parts(a), parts(b))
    assert one(spark, like("J. Pérez", "Juan Pérez"), like("Juan Pérez", "Juan Pérez"), like("Juan de la Cruz", "Pedro Cruz"), like("", "x")) == (pytest.approx(0.9), 1.0, pytest.approx(0.6), 0.0)
    assert one(spark, names.fuzzy_score(lit("ABC"), lit("ABD")), names.fuzzy_score(lit(""), lit("A"))) == (pytest.approx(2 / 3), 0.0)


def test_identity_pairs_are_complete(spark):
    people = [(i, n, t, b, s) for i, (n, t, b, s) in enumerate([("Juan Pérez", 1, 1990, 2020), ("J. Pérez", 1, 1990, 2021), ("PÉREZ, JUAN", None, None, 2022), ("Ana Gil", 2, 1985, 2020), ("Luis Mas", 1, 1990, 2021), ("", None, 1990, 2021), (None, 3, None, None), ("Ana Mas Gil", None, 1986, 2021), ("de la", 4, 1990, 2020), ("de la", 5, 1991, 2021)])]
    df = spark.createDataFrame(people, "profile_id long, name string, team_id long, birth_year int, season_start int")
    ready = identity.with_parts(df)
    pairs = ready.select(F.struct("*").alias("a")).crossJoin(ready.select(F.struct("*").alias("b"))).where("a.profile_id < b.profile_id")
    want = {(r.a.profile_id, r.b.profile_id) for r in identity.pair_scores(pairs).where("score >= 0.5").collect()}
    got = identity.candidates(df).collect()
    assert {(r.id1, r.id2) for r in got} == want and len(got) == len(want) and (0, 1) in want
    assert identity.matches_of(df, 0).first().profile_id == 1
    merged = {r.profile_id: r.identity_id for r in identity.merged_identities(df, spark.createDataFrame([(0, 1), (1, 2), (7, 3)], "id1 long, id2 long")).collect()}
    assert merged == {0: 0, 1: 0, 2: 0, 3: 3, 7: 3, 4: 4, 5: 5, 6: 6, 8: 8, 9: 9}
    statuses = identity.validated(identity.candidates(df), spark.createDataFrame([(0, 1, "confirmed")], "id1 long, id2 long, status string")).where("id1 = 0").select("id2", "status").collect()
    assert {r.id2: r.status for r in statuses}[1] == "confirmed"


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_season_rules(spark):
    """Expected values of the rules for a season: tiers, consistency, shooting, ages, phases, birth years, keywords, levels."""
    null = lit(None).cast("double")
    assert one(spark, *[scoring.tier(lit(x), scoring.SEASON_TIERS) for x in (0.80, 0.75, 0.65, 0.60, 0.50, 0.45, 0.35, 0.30, 0.2)]) == ("very_high", "very_high", "high", "high", "medium", "medium", "low", "low", "very_low")
    assert one(spark, *[scoring.tier(lit(x), scoring.CAREER_TIERS) for x in (0.70, 0.60, 0.50, 0.40, 0.39)]) == ("elite", "very_high", "high", "medium", "low")
    got = one(spark, *[scoring.consistency_score(lit(cv).cast("double"), lit(std).cast("double")) for cv, std in ((0.0, None), (0.4, None), (0.9, 5.0), (None, 10.0), (None, 60.0), (None, 0.0), (None, None))])
    assert got == pytest.approx((1.0, 0.5, 0.0, 0.8, 0.0, 0.5, 0.5))
    got = one(spark, *[scoring.advanced_score(lit(ts).cast("double"), lit(e).cast("double")) for ts, e in ((65.0, None), (32.5, None), (65.0, 1.5), (65.0, 0.5), (65.0, 1.1), (None, 1.0))])
    assert got == pytest.approx((1.0, 0.5, 1.2, 0.8, 1.1, 0.5))
    assert one(spark, *[scoring.age_score(lit(a).cast("int")) for a in (None, 18, 21, 24, 27, 30, 35)]) == (0.5, 1.0, 1.0, 0.8, 0.5, 0.3, 0.1)
    assert one(spark, *[scalars.match_weight(lit(x)) for x in ("Super Copa 2020", "super copa final", "Cuartos de final", "Eliminatoria", "PlayOff", "Liga", "")]) == (1.2, 1.2, 1.4, 1.4, 1.4, 1.0, 1.0)
    assert one(spark, scalars.birth_year(lit(None).cast("int"), lit("05/06/1995"), lit(2020)), scalars.birth_year(lit(0), lit("05/06/1995"), lit(2020)), scalars.birth_year(lit(1900), lit("05/06/1995"), lit(2020)), scalars.birth_year(lit(1900), lit("1995"), lit(2020))) == (None, None, 1995, None)
    assert one(spark, scalars.season_age(lit(2010), lit(2015)), scalars.age(lit(2010), lit(2015))) == (5, None)
    assert one(spark, scalars.gender(lit("Primera"), lit("http://x/lf2")), scalars.gender(lit("Women"), null.cast("string")), scalars.gender(lit("Copa Femenino")), scalars.gender(lit(None).cast("string"))) == ("fem", "fem", "fem", "masc")
    level = lambda name, year: scalars.season_level(lit(name), lit(year))
    assert one(spark, level("acb", 2020), level("L.F.-2", 2020), level("L.F.-2", 2021), level("other", 2021), level("Liga Femenina 2", 2000)) == (1, 2, 3, 4, 2)
    assert one(spark, names.fuzzy_score(lit("José"), lit(" JOSE ")), names.fuzzy_score(lit("!"), lit("A"))) == (1.0, 0.0)


def test_scores(spark):
    assert one(spark, scoring.age_score(lit(20)), scoring.career_age_score(lit(0)), scoring.performance_score(lit(3.0), lit(3.0), lit(1)), scoring.consistency_score(lit(None), lit(25.0)), scoring.momentum_score(lit(None), lit(0.0)), scoring.confidence_multiplier(lit(15), lit(200), lit(15))) == (1.0, 0.5, 1.0, 0.5, 0.5, 1.0)
    assert one(spark, scoring.eligibility_notes(lit(3), lit(10.0), lit(None).cast("double"))) == "few games (3<8); few minutes (10<80); marginal role (0.0<8)"
    assert one(spark, *[normalize.percentile(lit(z)) for z in (-9.0, 0.0, 1.0, 9.0)], normalize.percentile(lit(None).cast("double"))) == (0, 50, 84, 100, 50)
    members = scoring.career_members(spark.createDataFrame([("A", 1990), ("A", None)], "name string, birth_year int"), spark.createDataFrame([(1, "A", 1990), (2, "A", None), (3, "A", 1991)], "profile_id long, name string, birth_year int"))
    assert sorted((r.birth_year or 0, r.profile_id) for r in members.collect()) == [(0, 2), (1990, 1), (1990, 2)]


def test_nested_documents_of_every_format(spark, tmp_path):
    path = tmp_path / "games.json"
    path.write_text(
        '{"HEADER": {"game_code": 1, "season": "2024-2025", "starttime": "15-09-2024 - 18:00", "TEAM": [{"id": "a", "pts": "80"}, {"id": "b", "pts": "70"}]}, "BOXSCORE": {"TEAM": [{"id": "a", "TOTAL": {"pts": "80"}, "PLAYER": [{"name": "X", "inn": "1", "minFormatted": "20:30", "pts": "12", "p2m": "3", "p2a": "5", "p3m": "2", "p3a": "4", "pllss": "+4", "min": "1230"}]}, {"id": "b", "TOTAL": {"pts": "70"}, "PLAYER": []}]}}\n'
        '{"HEADER": {"game_code": "2"}, "BOXSCORE": {"SIDES": {"1": {"won": "1", "PLAYER": [{"name": "Y"}]}, "2": {"won": "0", "PLAYER": [{"name": "Z"}]}}}}\n'
        '{"HEADER": {"game_code": "3", "TEAM": [{"team_id": "c", "score": "5"}, {"team_id": "d", "score": "6"}]}, "BOXSCORE": {"PLAYER": [{"player_id": "9", "name": "W", "dorsal": "4", "is_home": "true", "minutes": "10:00", "points": "7", "plus_minus": "+3"}]}}\n'
    )
    games = ingest.read_games(spark, str(path))
    rows = {r.player_name: r for r in ingest.player_rows(games).collect()}
    assert (rows["X"].fgm, rows["X"].fga, rows["X"].minutes, rows["X"].plus_minus, rows["X"].is_home, rows["X"].team_won, rows["X"].is_starter, rows["X"].is_legacy) == (5, 9, 20.5, 4, True, True, True, False)
    assert (rows["Y"].is_home, rows["Y"].team_won, rows["Z"].is_home, rows["Z"].team_won) == (True, True, False, False)
    assert (rows["W"].points, rows["W"].minutes, rows["W"].plus_minus, rows["W"].shirt, rows["W"].is_legacy) == (7, 10.0, 3, "4", True)
    assert (rows["W"].is_home, rows["W"].team_won) == (True, False)
    rates = {r.player_name: r for r in ingest.with_rates(ingest.player_rows(games)).collect()}
    assert (rates["X"].field_goal_pct, rates["X"].three_point_pct, rates["X"].two_point_pct, rates["W"].field_goal_pct) == (pytest.approx(500 / 9), 50.0, 60.0, 0.0)
    heads = {r.game_code: r for r in ingest.header(games).collect()}
    assert (heads["1"].score_diff, heads["1"].is_valid, heads["1"].group_name, heads["2"].home_score, heads["3"].away_score, heads["3"].is_valid) == (10, True, "Único", None, 6, False)
    assert one(spark, ingest.same_team(lit("C.B. Rio Norte"), lit("Club Rio Sur")), ingest.same_team(lit("Alba"), lit("CB ALBA")), ingest.same_team(lit(""), lit("x"))) == (True, True, False)
    flat = spark.createDataFrame([("g", i, i < 5 or i == 7 or i > 8) for i in range(14)] + [("h", i, True) for i in range(6)], "game_code string, pos int, starter boolean")
    assert {r.game_code: r.split_at for r in ingest.split_points(flat).collect()} == {"g": 7, "h": 3}


def test_flat_players_get_their_sides(spark):
    rows = [("g", i, t, None, i < 5 or i == 7, "C.B. Rio Norte", "Alba Sur") for i, t in enumerate(["Rio Norte", "ALBA SUR", "Alba", None, "", "x", None, None, None, None, None, None, None, None, None])]
    rows += [("label", 0, "Alba Sur", True, False, "C.B. Rio Norte", "Alba Sur"), ("no header", 0, "Alba Sur", None, True, None, None)]
    df = spark.createDataFrame(rows, "game_code string, pos int, team string, is_home boolean, is_starter boolean, home_name string, away_name string")
    got = {(r.game_code, r.pos): r.is_home for r in ingest.assigned_sides(df).collect()}
    assert [got["g", i] for i in range(3)] == [True, False, False]
    # twelve undecided players with three starters among them: a starter after a bench player near the middle, or else half
    undecided = [i for i in range(3, 15)]
    starters = [i < 5 or i == 7 for i in undecided]
    split = next((k for k in range(4, 9) if starters[k] and not starters[k - 1]), 6)
    assert [got["g", i] for i in undecided] == [k < split for k in range(12)]
    assert got["label", 0] is True and got["no header", 0] is None


def test_upserts_and_corrections(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3), (None, "x", 9)], "k long, v string, at int")
    assert sorted((r.k, r.v) for r in ingest.upserted(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert tuple(ingest.upsert_counts(old, new, ["k"]).first()) == (1, 1, 1)
    assert {r.k for r in ingest.appended(old, new.where("k is not null"), ["k"]).collect()} == {3}
    state = ingest.load_state(old, ["v"], "k", "at")
    assert ingest.reset_state(state, v="a").count() == 1 and ingest.reset_state(state).count() == 0
    (tmp_path / "c.csv").write_text("player_name,birth_year\nA,1990\n")
    players = spark.createDataFrame([("A", None), ("B", 1980)], "player_name string, birth_year int")
    fixed = ingest.corrected(players, ingest.read_corrections(spark, str(tmp_path / "c.csv")))
    assert {r.player_name: r.birth_year for r in fixed.collect()} == {"A": 1990, "B": 1980}
    ingest.write_missing_birth_years(players, str(tmp_path / "missing"))
    assert spark.read.csv(str(tmp_path / "missing"), header=True).count() == 1


def test_pages(spark):
    cells = "".join(f"<td>{i}</td>" for i in range(19))
    html = f"<table><tr><th>h</th></tr><tr><td><b>7/12 58,3%</b></td>{cells}</tr><tr class='row-total'><td>9/9</td>{cells}</tr></table>2023/2024 on 01/02/2024 at 18:30 Resultado: 80 - 75"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    row = pages.table_rows(df).select("page_id", "cells", *pages.made_attempted(F.col("cells")[0])).collect()
    assert len(row) == 1 and tuple(row[0])[2:] == (7, 12, 58.3)
    head = pages.game_headers(df).where("page_id = 1").first()
    assert tuple(head) == (1, "2023/2024", "01/02/2024", "18:30", 80, 75)


def test_game_boxes(spark):
    field = lambda name, value: f'<span id="_ctl0_MainContentPlaceHolderMaster_{name}">{value}</span>'
    team = lambda side, name, score: f'<div class="columna equipo {side}"><div class="logo"><img src="x.png"></div><span class="nombre"><a href="?i=7">{name}</a></span><span class="resultado">{score}</span></div>'
    quarters = lambda side, points: f'<div class="columna equipo {side}">' + "".join(f"<span>{x}</span>" for x in points) + "</div>"
    box = f'<div class="box-marcador">{team("local", "Alpha", 80)}{team("visitante", "Beta CB", 75)}<div class="fila parciales">{quarters("local", [20, 25, "-", 15, 20])}{quarters("visitante", [18, 22, 20, 15])}</div></div><span>99</span>'
    first = field("pabellon", " Main Hall ") + field("localidad", "Town") + field("arbitro1Nombre", "A, B") + field("arbitro2Nombre", "&nbsp;") + field("arbitro3Nombre", "C, D") + box
    df = spark.createDataFrame([(1, first), (2, "<p>GARCIA PEREZ, ANA</p>" + field("pabellon", "&nbsp;")), (3, None)], "page_id long, html string")
    got = {r.page_id: r for r in pages.game_boxes(df).collect()}
    assert tuple(got[1]) == (1, "Main Hall", "Town", ["A, B", "C, D"], "Alpha", 80, [20, 25, 15, 20], "Beta CB", 75, [18, 22, 20, 15])
    assert tuple(got[2])[:6] == (2, None, None, ["GARCIA PEREZ, ANA"], None, None) and got[3].venue is None and got[3].home_team is None


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = incremental.running(stream, "user_id", "value", "ts", delay="4000 days").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.window_start, r.user_id)
    got = {key(r): (r.n, round(r.total, 6)) for r in spark.sql("SELECT * FROM running").collect()}
    assert got == {key(r): (r.n, round(r.total, 6)) for r in incremental.running(events, "user_id", "value", "ts").collect()}


def test_models(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z")).withColumn("y", 3 * F.col("x") + F.col("z"))
    train, test = model.split(df, "id")
    fitted = model.train_all(train, ["x", "z"], ["y"], depth=3, trees=5)["y"]
    assert model.metrics(fitted.transform(test), "y").first().r2 > 0.8
    assert model.importance(fitted, ["x", "z"])[0][0] == "x" and {r.feature: r.growth > 1 for r in model.permutation_importance(fitted, test, "y", ["x", "z"], "id").collect()} == {"x": True, "z": False}
    assert model.select_features(df, ["x", "z"], "y", 1) == ["x"]
    assert model.what_if(fitted, test, "x", 16.0, ["id"]).agg(F.avg("prediction")).first()[0] > 40
    model.save(fitted, str(tmp_path / "m"), ["x", "z"])
    again, columns = model.load(str(tmp_path / "m"))
    assert columns == ["x", "z"] and again.transform(test).count() == test.count()
    assert len(model.tune(train, ["x", "z"], "y", [2], [0.1, 0.3], "id", folds=2, trees=2).avgMetrics) == 2
    model.log_run(model.metrics(fitted.transform(test), "y"), str(tmp_path / "log"), "m")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 7.0, 2), (2, 1.0, 1)], "k long, v double, at int")
    assert {(r.k, r.v) for r in mart.latest_of(df, ["k"], "at").collect()} == {(1, 7.0), (2, 1.0)}
    assert mart.deterministic_sample(df, 2, "v").count() == 2
    assert spark.range(1).select(mart.top_features({"a": lit(1), "b": lit(3), "c": lit(2)}, 2)).first()[0] == ["b", "c"]
    assert mart.surrogate_keys(df, ["k"], "id").count() == 2
    assert [r.n for r in aggregates.counts_by(df, "k").orderBy("n").collect()] == [1, 2, 3]
    assert quality.violations(df, {"v": quality.in_range("v", 0, 6)}).first().violations == 1


def test_scores_without_a_value_are_half(spark):
    null = lit(None).cast("double")
    assert one(spark, scoring.production_score(null, lit(0.5)), scoring.performance_score(null, lit(1.0), lit(1)), scoring.advanced_score(null, lit(1.0)), scoring.consistency_score(null, null), scoring.momentum_score(null, null)) == (0.5, 0.5, 0.5, 0.5, 0.5)
