"""Blocking of identity candidates against all pairs, and what careers and rosters take from teams and namesakes."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import aggregates, identity, mart, scoring

PROFILE = "profile_id long, name string, team_id long, birth_year int, season_start int"


def profiles(seed: int, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    first = ["ANA", "MARIANA", "MARIA", "J", "JO", "JOSE", "JUAN", "ANTON", "TON", ""]
    last = ["GARCIA", "GARCIA LOPEZ", "LOPEZ", "DE LA", "DE LA CRUZ", "PEREZ RUIZ SANZ", "RUIZ", ""]
    out = []
    for i in range(n):
        given, family = rng.choice(first), rng.choice(last)
        name = rng.choice([f"{given} {family}", f"{given[:1]}. {family}", family, given])
        out.append((i, name, rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1990, 1991, 1992, 1993]), rng.choice([None, 2015, 2016, 2017, 2018, 2020])))
    return out


@pytest.mark.parametrize("seed,tile", [(1, 1 << 12), (2, 5), (3, 17)])
def test_candidates_are_all_pairs_that_reach_the_score(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(identity, "TILE", tile)
    df = spark.createDataFrame(profiles(seed), PROFILE)
    ready = identity.with_parts(df).select(F.struct("profile_id", "parts", "team_id", "birth_year", "season_start").alias("p"))
    pairs = ready.select(F.col("p").alias("a")).join(ready.select(F.col("p").alias("b")), F.col("a.profile_id") < F.col("b.profile_id"))
    scored = identity.pair_scores(pairs).where("score >= 0.5")
    want = sorted((r.x, r.y, round(r.score, 6)) for r in scored.select(F.col("a.profile_id").alias("x"), F.col("b.profile_id").alias("y"), "score").collect())
    got = sorted((r.id1, r.id2, round(r.score, 6)) for r in identity.candidates(df.unionByName(df.limit(20))).collect())
    assert len(want) > 500 and got == want
    for least in (0.7, 0.75):
        high = sorted((r.id1, r.id2) for r in identity.candidates(df, least).collect())
        assert high == [(x, y) for x, y, s in want if s >= least]
    assert identity.pairs_met(df, 0.7).first().met < identity.pairs_met(df).first().met


def test_candidates_of_an_empty_table_and_of_one_hot_name(spark, monkeypatch):
    monkeypatch.setattr(identity, "TILE", 8)
    assert identity.candidates(spark.createDataFrame([], PROFILE)).count() == 0
    same = spark.createDataFrame([(i, "A. SMITH", 1, 1990, 2020) for i in range(60)], PROFILE)
    assert identity.candidates(same).count() == 60 * 59 // 2
    assert identity.pairs_met(same).first().met >= 60 * 59 // 2


def test_strength_of_the_highest_competition_changes_a_career(spark):
    rows = spark.createDataFrame([(1, 2020, 1, 1.05), (1, 2020, 7, 0.95), (2, 2020, 1, 1.0)], "team_id long, season_start int, competition_id long, strength double")
    factor = aggregates.strength_of_seasons(rows)
    assert {tuple(r) for r in factor.collect()} == {(1, 2020, 0.95), (2, 2020, 1.0)}
    scored = spark.createDataFrame([(5, 1, 2020, 10, 300.0, 0.6, 3, True), (6, 9, 2020, 10, 300.0, 0.6, 3, True)], "player_id long, team_id long, season_start int, games long, total_minutes double, potential double, level int, eligible boolean")
    got = {r.player_id: r.score for r in scoring.career_seasons(scoring.with_strength(scored, factor), ["player_id"]).collect()}
    assert got[5] == pytest.approx(0.6 * (1 + 0.5 * (0.95 - 1))) and got[6] == pytest.approx(0.6)


def test_namesakes_do_not_multiply_a_roster(spark):
    facts = spark.createDataFrame([(1, p, n, y, g, 1.0, 10, 1, 1, 1.0) for p, n, y in ((1, "A", 1990), (2, "A", 1991), (3, "A", None), (4, "B", 1990), (5, "C", 1990)) for g in range(3)], "team_id long, player_id long, name string, birth_year int, game_id int, minutes double, points int, reb int, ast int, efficiency double")
    potential = spark.createDataFrame([("A", 1990, 0.3), ("A", 1990, 0.4), ("A", 1985, 0.9), ("A", None, 0.2), ("B", 1970, 0.5), ("B", None, 0.6)], "name string, birth_year int, score double")
    got = {r.player_id: r.score for r in mart.roster(facts, potential, "name").collect()}
    assert got == {1: 0.4, 2: 0.9, 3: 0.2, 4: 0.6, 5: None} and mart.roster(facts, potential, "name").count() == 5
