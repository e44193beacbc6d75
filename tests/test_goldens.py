"""Known names against known rosters. The rosters, the names and what they have to give."""

import pytest
from pyspark.sql import functions as F

from lineupforge.operators import matching

ROSTER = [
    "Unai Simón", "Álex Padilla", "Dani Vivian", "Yeray Álvarez", "Jesús Areso", "Aymeric Laporte", "Yuri Berchiche", "Oihan Sancet", "Iñigo Ruiz de Galarreta",
    "Beñat Prados", "Iñaki Williams", "Nico Williams", "Gorka Guruzeta", "Álex Berenguer", "Thibaut Courtois", "Antonio Rüdiger", "Dani Carvajal", "Federico Valverde",
    "Jude Bellingham", "Vinícius Júnior", "Kylian Mbappé", "Joan Garcia", "Alejandro Balde", "Pau Cubarsí", "Jules Koundé", "Pedri", "Fermín López Marín", "Lamine Yamal",
    "Raphinha", "Jan Oblak", "Koke Resurrección", "Julián Alvarez", "Antoine Griezmann", "Bil Nsongo", "Lorenzo Amatucci", "Pierre-Emerick Aubameyang", "Bright Ede",
    "Gerard Moreno", "Denis Suárez", "Ademola Lookman",
]
FOUND = {
    "Guruzeta": "Gorka Guruzeta", "Nsongo": "Bil Nsongo", "Bellingham": "Jude Bellingham", "Courtois": "Thibaut Courtois", "Berenguer": "Álex Berenguer", "Rüdiger": "Antonio Rüdiger",
    "Oblak": "Jan Oblak", "Valverde": "Federico Valverde", "Laporte": "Aymeric Laporte", "Sancet": "Oihan Sancet", "Berchiche": "Yuri Berchiche", "Vivian": "Dani Vivian",
    "Padilla": "Álex Padilla", "Carvajal": "Dani Carvajal", "Cubarsí": "Pau Cubarsí", "Koundé": "Jules Koundé", "Raphinha": "Raphinha", "Ede": "Bright Ede", "Moreno": "Gerard Moreno",
    "Griezmann": "Antoine Griezmann", "Julián Álvarez": "Julián Alvarez", "Yeray": "Yeray Álvarez", "Gorka Guruzeta": "Gorka Guruzeta", "Bil Nsongo": "Bil Nsongo", "Pedri": "Pedri",
    "Vinícius Júnior": "Vinícius Júnior", "Ruiz de Galarreta": "Iñigo Ruiz de Galarreta", "Aubameyang": "Pierre-Emerick Aubameyang", "Mbappé": "Kylian Mbappé", "Mbappe": "Kylian Mbappé",
    "Lamine": "Lamine Yamal", "Ademola": "Ademola Lookman", "Amatucci": "Lorenzo Amatucci", "Lookman": "Ademola Lookman", "Prados": "Beñat Prados", "Areso": "Jesús Areso",
    "A. Balde": "Alejandro Balde", "Fermín López": "Fermín López Marín", "Denis Suárez": "Denis Suárez", "Balde": "Alejandro Balde", "Yamal": "Lamine Yamal", "Lamine Yamal": "Lamine Yamal",
    "Koke": "Koke Resurrección", "Resurrección": "Koke Resurrección", "Denis": "Denis Suárez",
}
NOBODY = ["Williams", "Iago Aspas", "Lionel Messi", "Cristiano Ronaldo", "Laporte Williams", "Mbappé Guruzeta"]
RULES = {"Lookman": "last-name-unique", "Ademola Lookman": "exact", "Padilla": "last-name-unique"}
SHORT_FORMS = [
    "Alejandro Grimaldo", "Alejandro Balde", "Javier Guerra", "Fernando Niño", "Facundo González", "Cristian Romero", "Manuel Sánchez", "Roberto Torres", "Francisco García", "Daniel Carvajal",
    "Antonio Rüdiger", "Jesús Areso", "Rafael Leão", "Youssef Enríquez", "Rubén García", "Rodrigo Riquelme",
]
BY_SHORT_FORM = {
    "Álex Grimaldo": "Alejandro Grimaldo", "Álex Balde": "Alejandro Balde", "Javi Guerra": "Javier Guerra", "Fer Niño": "Fernando Niño", "Facu González": "Facundo González",
    "Cuti Romero": "Cristian Romero", "Manu Sánchez": "Manuel Sánchez", "Roberto": "Roberto Torres", "Dani Carvajal": "Daniel Carvajal", "Toni Rüdiger": "Antonio Rüdiger",
    "Rafa Leão": "Rafael Leão", "Yusi Enríquez": "Youssef Enríquez", "Rubo García": "Rubén García", "Roro Riquelme": "Rodrigo Riquelme", "P. García": None,
}


def matched(spark, names, roster, minimum=0.6):
    """name -> (roster name, rule)."""
    cases = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "team string, case_id int, raw string")
    players = spark.createDataFrame([("t", i, i, n) for i, n in enumerate(roster)], "team string, ord int, player int, name string")
    return {names[r["case_id"]]: (roster[r["player"]], r["rule"], r["confidence"]) for r in matching.match_roster(cases, players, minimum).collect()}


@pytest.fixture(scope="module")
def found(spark):
    return matched(spark, [*FOUND, *NOBODY, "Ademola Lookman"], ROSTER)


@pytest.fixture(scope="module")
def short(spark):
    return matched(spark, list(BY_SHORT_FORM), SHORT_FORMS)


@pytest.mark.parametrize("name", FOUND)
def test_found(found, name):
    assert found[name][0] == FOUND[name]


@pytest.mark.parametrize("name", NOBODY)
def test_nobody(found, name):
    assert name not in found


@pytest.mark.parametrize("name", RULES)
def test_rule(found, name):
    assert found[name][1] == RULES[name]


@pytest.mark.parametrize("name", BY_SHORT_FORM)
def test_short_form(short, name):
    assert short.get(name, (None,))[0] == BY_SHORT_FORM[name]


def test_least_confidence(spark):
    assert matched(spark, ["García"], ["García"], 0.95) == {}
    assert matched(spark, ["Álex Padilla"], ["Padilla"], 0.5)["Álex Padilla"][0] == "Padilla"
    assert {k: v[1] for k, v in matched(spark, ["Ademola Lookman", "Lookman"], ROSTER, 1.0).items()} == {"Ademola Lookman": "exact"}


def test_near_misses(spark):
    cases = spark.createDataFrame([("t", 1, "Álex Grimaldo"), ("t", 2, "Lionel Messi")], "team string, case_id int, raw string")
    roster = spark.createDataFrame([("t", 1, 1, "Alejandro Grimaldo")], "team string, ord int, player int, name string")
    assert [(r["case_id"], r["confidence"], r["rule"]) for r in matching.near_misses(cases, roster).collect()] == [(1, 0.95, "first-name-alias-same-lastname")]


def test_a_token_of_the_whole_team_makes_no_square(spark):
    """Everybody is a García: names meet by what else they have."""
    n = 600
    roster = spark.createDataFrame([("t", i, i, f"Nombre{i} Segundo{i} García") for i in range(n)], "team string, ord int, player int, name string")
    cases = spark.createDataFrame([("t", i, f"Nombre{i} García" if i % 2 else f"Otro{i} García") for i in range(n)] + [("t", n, "García")], "team string, case_id int, raw string")
    got = {r["case_id"]: (r["player"], r["rule"]) for r in matching.match_roster(cases, roster).collect()}
    assert got == {i: (i, matching.ALIAS) for i in range(n) if i % 2}
    tokens = lambda c: matching.significant_tokens(F.col(c))
    left = cases.select("team", F.col("raw").alias("name"), matching.normalize_name(F.col("raw")).alias("norm"), tokens("raw").alias("inc")).distinct()
    right = roster.select("team", "ord", "player", matching.normalize_name(F.col("name")).alias("cnorm"), tokens("name").alias("canon"))
    first = F.get(F.col("inc"), 0)
    assert matching._indexed(left.where(F.size("inc") > 1), right, first, [], []).count() <= 2 * n  # of n * n pairs with a common token


def test_the_same_as_all_pairs(spark):
    """Every name of a made-up squad against all of it, by the keys and by holding each pair."""
    first, last = ["Ana", "A.", "Alex", "Alejandro", "Maria Jose", "J"], ["Gil", "Sol de la Mar", "Gil Sol", "Mar", "de Gil"]
    names = [f"{f} {x}" for f in first for x in last] + last + ["Ana", "Jose", "", "X Y", "x  y", "Gil Ana"]
    cases = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "team string, case_id int, raw string")
    roster = spark.createDataFrame([("t", i, i, n) for i, n in enumerate(names[::2])], "team string, ord int, player int, name string")
    by_keys, kept = matching.match_roster(cases, roster).collect(), matching._meeting
    near = matching.near_misses(cases, roster).collect()
    matching._meeting = lambda left, right: left.drop("lkeys").join(right.drop("rkeys"), "team")
    try:
        assert sorted(map(tuple, matching.match_roster(cases, roster).collect())) == sorted(map(tuple, by_keys)) and len(by_keys) > 20
        assert sorted(map(tuple, matching.near_misses(cases, roster).collect())) == sorted(map(tuple, near)) and len(near) > 60
    finally:
        matching._meeting = kept
