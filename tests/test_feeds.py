"""Pages and documents that are not as they should be."""

from pyspark.sql import functions as F

from courtside.sources import ingest, pages


def test_table_rows_of_careless_markup(spark):
    cells = "".join(f"<TD class=x>{i}" for i in range(19))  # never closed
    html = f"<table><TR><th>h</th>{cells}</TR><tr class='a'><td><b>7/12\n 58,3%</b></td>{cells}<tr class=\"row-total\"><td>9</td>{cells}</tr><tr><td>few</td></tr><tr><td>&nbsp;A&nbsp; B </td>{cells}</table><p><td>after"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<td>" * 30)], "page_id long, html string")
    got = [(r.page_id, r.row, r.cells[0], len(r.cells)) for r in pages.table_rows(df).orderBy("row").collect()]
    assert got == [(1, 0, "7/12 58,3%", 20), (1, 1, "A B", 20)]
    assert [r.row for r in pages.table_rows(df, least_cells=1).orderBy("row").collect()] == [0, 1, 2]


def test_result_rows_skip_headers_and_keep_the_first_date(spark):
    html = "<tr><th>p=1 01/01/2000</th></tr><tr><td>02/02/2024<td><a href='x?p=7'>a</a></tr><tr><td>03/03/2024<td><a href='x?p=7'>a</a><a href='x?p=8'></tr><tr><td><a href='x?p=9'></tr>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert sorted((r.page_id, r.code, r.date) for r in pages.result_rows(df, r"p=(\d+)").collect()) == [(1, "7", "02/02/2024"), (1, "8", "03/03/2024"), (1, "9", None)]


def test_every_line_is_read_or_rejected(spark, tmp_path):
    lines = ['{"HEADER": {"game_code": "1"}}', '{"HEADER": {"game_code": 2}, "other": [1]}', '{"HEADER": {"game_code": "3"', "[]", "5", "null", '{"HEADER": {"game_code": " "}}', "{}", "", "  ", '{"HEADER": "x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "d"))
    good, bad = ingest.read_checked(spark, str(tmp_path / "d"))
    assert sorted(r[0] for r in good.select("HEADER.game_code").collect()) == ["1", "2"]
    assert good.columns == [f.name for f in ingest.GAME.fields]
    reasons = {r.line: r.reason for r in bad.collect()}
    assert reasons['{"HEADER": {"game_code": "3"'] == "malformed" and reasons["{}"] == "no game code" == reasons['{"HEADER": {"game_code": " "}}']
    assert good.count() + bad.count() == sum(1 for x in lines if x.strip())
    empty = spark.createDataFrame([], "value string")
    empty.write.text(str(tmp_path / "e"))
    assert [x.count() for x in ingest.read_checked(spark, str(tmp_path / "e"))] == [0, 0]


def test_words_of_team_names_decide_where_neither_holds_the_other(spark):
    same = lambda a, b: spark.range(1).select(ingest.same_team(F.lit(a), F.lit(b))).first()[0]
    assert same("C.B. Local Norte", "Norte Local") and same("Club Baloncesto Sur", "SUR ESTE") and not same("Norte Uno Dos", "Sur Dos Tres Cuatro") and not same("", "x")


def test_small_sides_are_weighed_by_type_and_only_if_they_are_few(spark, monkeypatch):
    from courtside.plans import storage

    df = spark.createDataFrame([(i, "x" * 100, [i]) for i in range(50)], "k long, text string, more array<int>")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(storage.small_side(df)) and hinted(storage.small_side(df, 50, 50 * 150)) and not hinted(storage.small_side(df, 50, 50 * 110))
    weighed = []
    monkeypatch.setattr(storage, "_weight", lambda x: weighed.append(x) or F.lit(1))
    assert not hinted(storage.small_side(df, 49)) and not weighed
    assert hinted(storage.small_side(df.limit(0), 0, 0))
