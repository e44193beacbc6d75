"""Hand-worked cases for the base library."""

import datetime as dt

from pyspark.sql import functions as F

from lineupforge.functions import numeric as N
from lineupforge.functions import text as T
from lineupforge.operators import consensus as C
from lineupforge.operators import lineup, matching
from lineupforge.operators import state as S
from lineupforge.sources import html
from lineupforge.streaming.pipeline import latest_state, read_state

ROSTER = ["Gorka Guruzeta", "Kylian Mbappé", "Lamine Yamal", "Alejandro Balde", "Fermín López Marín", "Iñigo Ruiz de Galarreta", "Iñaki Williams", "Nico Williams", "Alejandro Grimaldo", "Francisco García"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, T.normalize_name(F.lit("  Íñigo  Ruiz-de GALARRETA "))) == "inigo ruiz de galarreta"
    assert one(spark, T.fold_name(F.lit("Ødegaard"))) == "odegaard"


def test_odds(spark):
    d = lambda *o: one(spark, N.devig(*map(F.lit, map(float, o))))
    assert tuple(d(2, 3, 4)) == (46, 31, 23) and d(2, 0, 4) is None and d("nan", 3, 4) is None and d(0, 0, 0) is None


def test_weight_and_probability(spark):
    assert [one(spark, N.parse_weight(F.lit(w))) for w in ("1.5x", "abc", "0", "-2", "3")] == [1.5, 1, 1, 1, 3]
    assert [one(spark, N.clamp_probability(F.lit(p))) for p in (50.5, -3.0, 250.0, float("nan"))] == [51, 0, 100, 0]


def test_prices(spark):
    price = lambda *p: one(spark, N.positive_price(*(F.lit(x).cast("int") for x in p)))
    assert price(180, None, None) == 180 and price(0, 0, 0) is None and price(962, 42, 1000) == 42


def test_consensus_counts_silence_as_zero(spark):
    rows = [("p", "t", "a", 80), ("p", "t", "b", 100), ("q", "t", "c", 60), ("r", "u", "a", 50)]
    got = C.consensus(spark.createDataFrame(rows, "player string, team string, source string, probability int"), spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "source string, weight double"))
    assert {r["player"]: (r["probability"], r["sources_likely"], r["sources_total"]) for r in got.collect()} == {"p": (70, 2, 3), "q": (15, 1, 3), "r": (50, 0, 1)}


def test_rounds(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day), (2, day + dt.timedelta(days=3)), (3, day + dt.timedelta(days=6, milliseconds=1))]
    got = S.gap_rounds(spark.createDataFrame(rows, "id long, ts timestamp_ntz").withColumn("k", F.lit(1)), "ts", ["id"], 3 * 86_400, ["k"]).collect()
    assert {r["id"]: r["round"] for r in got} == {1: 1, 2: 1, 3: 2}


def test_upserts_are_idempotent(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 6, None)], "k int, v int, s string")
    delta = spark.createDataFrame([(2, None, "b"), (3, 7, "c")], base.schema)
    once = S.coalescing_upsert(base, delta, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, 5, "a"), (2, 6, "b"), (3, 7, "c")]
    assert sorted(map(tuple, S.coalescing_upsert(once, delta, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, S.upsert(S.upsert(base, delta, ["k"]), delta, ["k"]).collect()))[1] == (2, None, "b")
    assert S.delete_missing(base, base.where("false"), ["k"]).count() == 2


def test_zero_fill_needs_a_report(spark):
    previous = spark.createDataFrame([(1, "s", "t", 80), (2, "s", "t", 70), (3, "s", "u", 60)], "p int, source string, team string, v int")
    reported = previous.where("p = 1")
    assert [tuple(r) for r in S.zero_fill(previous, reported, "p", ["team", "source"], "v").select("p", "v").collect()] == [(2, 0)]
    assert S.zero_fill(previous, reported.where("false"), "p", ["team", "source"], "v").count() == 0


def test_conflict_at_equal_times_keeps_the_leader(spark):
    rows = spark.createDataFrame([(1, "s", 5, "own"), (2, "s", 5, "other"), (2, "z", 1, "only")], "p int, source string, ts int, x string")
    got = S.merge_followers(rows, spark.createDataFrame([(2, 1)], "p int, leader int"), "p", ["source"], "ts").collect()
    assert {(r["p"], r["source"]): r["x"] for r in got} == {(1, "s"): "own", (1, "z"): "only"}


def _match(spark, names, roster=ROSTER, minimum=0.6):
    cases = spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "team string, case_id int, raw string")
    players = spark.createDataFrame([("t", i, i, n) for i, n in enumerate(roster)], "team string, ord int, player int, name string")
    got = {r["case_id"]: roster[r["player"]] for r in matching.match_roster(cases, players, minimum).collect()}
    return [got.get(i) for i in range(len(names))]


def test_roster_match(spark):
    names = ["Guruzeta", "Mbappe", "Lamine", "A. Balde", "Fermín López", "Ruiz de Galarreta", "Williams", "Laporte Williams", "Álex Grimaldo", "P. García", "Francisco García"]
    want = ["Gorka Guruzeta", "Kylian Mbappé", "Lamine Yamal", "Alejandro Balde", "Fermín López Marín", "Iñigo Ruiz de Galarreta", None, None, "Alejandro Grimaldo", None, "Francisco García"]
    assert _match(spark, names) == want
    assert _match(spark, ["García"], ["García"], 0.95) == [None]


def test_eleven():
    squad = [(1, "POR", 90), (2, "POR", 80)] + [(10 + i, "DEF", 70) for i in range(4)] + [(20 + i, "MED", 70) for i in range(3)] + [(30 + i, "DEL", 70) for i in range(3)]
    got = lineup.pick(squad)
    assert got[0] == (1, "POR") and len(got) == 11 and [x for _, x in got[1:]] == ["DEF"] * 4 + ["MED"] * 3 + ["DEL"] * 3
    assert lineup.pick([(1, None, 50), (2, "DEL", 0)]) == [(1, "MED")]


def test_pages(spark):
    assert one(spark, html.round_number(F.lit("La Jornada 12"))) == 12
    text = """{{Jugador de fútbol con esquema|no=1|pos=POR|nombre=[[Unai Simón|Simón]]{{ref|x}}}} {{Jugador de fútbol con esquema|pos=DF|nombre='''Ángel&nbsp;Pérez''' (jugador nacido en 2002)|edad=3}}
    {{Jugador de fútbol con esquema|pos=DEL|nombre=[[Costa de Marfil]]}} {{Jugador de fútbol con esquema|pos=XX|nombre=Ana Gil}} {{Jugador de fútbol con esquema|pos=MED|nombre=Solo}}"""
    assert [tuple(p) for p in one(spark, html.squad(F.lit(text)))] == [("Unai Simón", "POR"), ("Ángel Pérez", "DEF")]
    assert one(spark, html.squad(F.lit(""))) == [] and one(spark, html.squad(F.lit(None).cast("string"))) is None
    assert [one(spark, html.is_squad_section(F.lit(t))) for t in ("Plantilla 2019", "Plantel 2026", "Plantel 2019")] == [True, True, False]


def test_streaming_keeps_the_latest(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k int, ts int, v string"
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b"), (None, 9, "bad")], [(1, 2, "c"), (2, 0, "old")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = latest_state(stream, str(tmp_path / "state"), ["k"], [F.desc("ts")], F.col("k").isNotNull(), str(tmp_path / "dead"), str(tmp_path / "check"))
        query.awaitTermination(60)
    assert sorted(map(tuple, read_state(spark, str(tmp_path / "state")).select("k", "v").collect())) == [(1, "c"), (2, "b")]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 1


def test_markup_of_names(spark):
    bare = lambda x: one(spark, html._bare(F.lit(x)))
    assert bare("[[Ana María Gil|Ana]] {{nota|y}}&nbsp;(cap.)") == "Ana María Gil" and bare(":en:Bea Sol <br>&amp; Co|") == "Bea Sol & Co"
    assert bare("Eva Mar archivo:foto.png") == "Eva Mar" and bare("'''Ana''' Gil<small>2</small>") == "Ana Gil2" and bare("[[Ana") == "[[Ana"
    assert one(spark, html.decoded(F.lit("España – 5 €".encode("windows-1252")), F.lit("Windows-1252"))) == "España – 5 €"
    assert one(spark, html.decoded(F.lit("España".encode()), F.lit(None).cast("string"))) == "España"
