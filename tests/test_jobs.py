"""Cycles over landed reports, hand-worked."""

import datetime as dt

from pyspark.sql import functions as F

from lineupforge.operators import jobs, lineup

NOW = dt.datetime(2024, 8, 10, 12)
OLD = NOW - dt.timedelta(hours=2)
REPORT = "source string, team string, ord int, raw string, probability double, certain boolean, kind string, note string, position string, photo string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at(when=NOW):
    return F.lit(when).cast("timestamp_ntz")


def tables(spark):
    players = spark.createDataFrame([(1, "t", 1, "Ana Gil", None, None), (2, "t", 2, "Bea Sol", "DEF", "b.png"), (3, "u", 3, "Eva Mar", None, None)], "player int, team string, ord int, name string, position string, photo string")
    forecasts = spark.createDataFrame([(1, "a", 50, False, "probable", None, OLD), (2, "a", 90, True, "confirmed", "x", OLD), (3, "a", 70, False, "probable", None, OLD), (2, "b", 40, False, "probable", None, OLD)], "player int, source string, probability int, certain boolean, kind string, note string, fetched_at timestamp_ntz")
    reports = spark.createDataFrame([
        ("a", "t", 1, "Gil", 10.0, None, None, None, "MED", ""), ("a", "t", 2, "Ana Gil", 80.4, True, "confirmed", "n", "??", "a.png"),
        ("a", "t", 3, "Nobody Known", 70.0, None, None, None, None, None), ("a", "x", 4, "Ana Gil", 70.0, None, None, None, None, None),
        ("c", "t", 5, "Bea Sol", 250.0, None, None, None, None, None)], REPORT)
    events = spark.createDataFrame([("a", "t", "Bea Sol", "injury", None, None), ("a", "t", "Nobody Known", "doubt", "none", None)], "source string, team string, raw string, event string, severity string, reason string")
    return reports, events, players, forecasts


def test_persist(spark):
    out = jobs.persist(*tables(spark), at())
    assert rows(out["forecasts"]) == sorted([
        (1, "a", 80, True, "confirmed", "n", NOW), (2, "a", 0, False, "probable", jobs.ABSENT, NOW), (2, "c", 100, False, "probable", None, NOW),
        (3, "a", 70, False, "probable", None, OLD), (2, "b", 40, False, "probable", None, OLD)], key=repr)
    assert rows(out["players"]) == [(1, "t", 1, "Ana Gil", "MED", "a.png"), (2, "t", 2, "Bea Sol", "DEF", "b.png"), (3, "u", 3, "Eva Mar", None, None)]
    assert rows(out["events"]) == [(2, "a", "injury", "none", None, None, None, NOW)]
    letter = ("t", "a", "Nobody Known", "Nobody Known")  # one of the report, one of the event
    assert rows(out["unmatched"]) == sorted([(*letter, 70, False, "probable", None, NOW), (*letter, None, False, "probable", None, NOW)], key=repr)
    assert rows(out["processed"]) == [("a", 2), ("c", 1)]


def test_cycle(spark):
    reports, events, players, forecasts = tables(spark)
    sources = spark.createDataFrame([("a", True, 1.0), ("b", True, 3.0), ("c", False, 1.0), ("d", True, 1.0)], "source string, enabled boolean, weight double")
    answers = spark.createDataFrame([("a", True, None), ("b", False, "timeout"), ("c", False, None), ("d", False, None), ("z", False, None)], "source string, partial boolean, error string")
    before = spark.createDataFrame([("t", 2, 99, 0, 1, None), ("z", 9, 40, 0, 1, None)], "team string, player int, probability int, sources_likely long, sources_total long, agreement array<struct<source:string,probability:int>>")
    out = jobs.cycle(answers, sources, reports, events, players, forecasts, before, at())
    assert rows(out["runs"].select("source", "status", "message", "items")) == [("a", "partial", jobs.IN_PART, 2), ("b", "failed", "timeout", 0), ("d", "failed", jobs.EMPTY, 0)]
    assert rows(out["consensus"].select("player", "probability", "sources_total")) == [(1, 20, 2), (2, 30, 2), (3, 70, 1), (9, 40, 1)]  # 9 is stale and stays
    out = jobs.cycle(answers.where("source != 'a'"), sources, reports, events, players, forecasts, before, at())
    assert rows(out["consensus"]) == rows(before) and rows(out["forecasts"]) == rows(forecasts)


def test_shown_rounds(spark):
    day = lambda n: NOW + dt.timedelta(days=n)
    matches = spark.createDataFrame([(1, day(-9), 1), (2, day(-1), 2), (3, day(0), 3), (4, day(5), 4), (5, day(9), 5), (6, day(2), None)], "match int, stamp timestamp_ntz, round int")
    of = lambda df, now=NOW: [r["match"] for r in jobs.shown_rounds(df, at(now)).orderBy("match").collect()]
    assert of(matches) == [3, 4] and of(matches.where("match in (3, 6)")) == [3, 6]
    assert of(matches.where("match in (1, 2)")) == [1, 2] and of(matches.where("round is not null"), day(50)) == [4, 5]
    assert of(matches.where("false")) == []


def test_eleven_of_a_large_squad(spark):
    """Bounded groups choose as the whole squad would; whom no source takes as likely is out."""
    squad = [(1, i, ["POR", "DEF", "MED", "DEL", None][i % 5], 1 + (i * 37) % 100, int(i % 9 != 0)) for i in range(200)]
    got = lineup.best_eleven(spark.createDataFrame(squad, "team long, player long, position string, probability int, sources_likely long")).collect()
    want = lineup.pick([(p, x, q) for _, p, x, q, n in squad if n])
    assert [(r["player"], r["line"]) for r in sorted(got, key=lambda r: r["seat"])] == want and len(want) == 11
