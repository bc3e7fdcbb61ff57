"""The mart's rows are dealt by player once, and meet their sides where they lie."""

from pyspark.sql import functions as F

from courtside.operators import mart
from courtside.plans import catalog, model


def test_events_meet_their_sides_without_a_shuffle(spark, sf_dir):
    plan = catalog._joined(*catalog._sides(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "Exchange hashpartitioning" not in plan and "RebalancePartitions" not in plan


def test_a_side_is_joined_by_all_keys_and_dealt_by_one(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 1, "d"), (2, 1, "e")], "p long, s int, v string")
    side = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, None, 30), (None, 1, 40), (3, 1, 50)], "p long, s int, x int")
    got = {r.v: r.x for r in mart.joined_by(rows, side, ["p", "s"], "p").collect()}
    assert got == {r.v: r.x for r in rows.join(side, ["p", "s"], "left").collect()} == {"a": 10, "b": 20, "c": None, "d": None, "e": None}
    lying = lambda df: df.repartition(3, "p")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mart.joined_by(lying(rows), lying(side), ["p", "s"], "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 2


def test_targets_are_of_the_very_next_season(spark):
    facts = spark.createDataFrame([(1, 2000, 300.0, 1, 2.0), (1, 2001, 200.0, 3, 4.0), (1, 2001, 100.0, 5, 6.0), (1, 2003, 300.0, 7, 8.0), (1, None, 300.0, 9, 9.0), (None, 2000, 300.0, 1, 1.0), (None, 2001, 300.0, 1, 1.0), (2, 2000, 1.0, 1, 1.0), (2, 2001, 199.0, 1, 1.0)], "player_id long, season_start int, minutes double, points int, efficiency double")
    assert [tuple(r) for r in mart.next_season_targets(facts).collect()] == [(1, 2000, 4.0, 5.0)]


def test_games_and_teams_that_repeat_multiply_rows_of_the_mart_alone(spark, sf_dir, tmp_path):
    for t in ("lineitem", "customer", "nation", "orders"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (df.unionByName(df.where("o_orderkey % 50 = 0")) if t == "orders" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "customer", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    # of a game that is there twice each line is there twice, and meets two results and two contexts; streaks at such ties are open in the SQL
    sums = "count(*) AS n, sum(score_diff) AS d, sum(points) AS p, count(streak) AS s"
    want = con.execute(f"SELECT {sums} FROM ({catalog.ORACLE_SQL['m01_feature_mart']}) WHERE game_id % 50 <> 0").fetchone()
    m = catalog.QUERIES["m01_feature_mart"](spark, str(tmp_path)).persist()
    got = m.where("game_id % 50 <> 0").agg(F.count("*"), F.sum("score_diff"), F.sum("points"), F.count("streak")).first()
    again = con.execute(f"SELECT count(*), sum(games), sum(points) FROM ({catalog.ORACLE_SQL['m01_feature_mart']})").fetchone()
    whole = m.agg(F.count("*"), F.sum("games"), F.sum("points")).first()
    m.unpersist()
    assert tuple(got) == want and tuple(whole) == again


def test_no_copy_of_a_row_is_shuffled_to_be_explained(spark):
    class Sum:
        def transform(self, df):
            return df.withColumn("prediction", F.col("a") + 10 * F.col("b"))

    rows = spark.range(50).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    out = model.explained(Sum(), rows, ["a", "b"], {"a": 1.0, "b": 2.0}, "k", 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the shuffle comes first
    got = {r.k: (r.prediction, r.top_features[0].feature, r.top_features[0].effect) for r in out.collect()}
    assert got[3] == (33.0, "b", 10.0) and got[49] == (49.0, "a", 48.0) and len(got) == 50
