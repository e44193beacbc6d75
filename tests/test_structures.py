"""Near names, ordered scans, intervals, versions, cascades and documents against plain versions."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lineupforge.operators import documents, identity, intervals, matching, ordered, residual, similar, versions

DAY = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        row = out
    return row[-1]


@pytest.mark.parametrize("least", [0.7, 0.75, 0.8, 0.9])
def test_edit_join(spark, least):
    random.seed(int(least * 100))
    values = ["".join(random.choice("abñ") for _ in range(random.randint(0, 14))) for _ in range(160)] + [None, "", "aaaa", "aaaaa", "a" * 30, "a" * 40]
    values += [v[:k] + random.choice("abcd") + v[k + 1 :] for v in values[:160] for k in [random.randint(0, 13)] if v]
    data = [(i % 2, v) for i, v in enumerate(values)] + [(0, "copy")] * 50
    got = similar.edit_join(spark.createDataFrame(data, "team int, v string"), ["team"], "v", least)
    want = []
    for team in (0, 1):
        for a, b in combinations(sorted({v for t, v in data if t == team and v}), 2):
            if (s := 1.0 - distance(a, b) / max(len(a), len(b))) >= least:
                want.append((team, a, b, s))
    assert rows(got) == sorted(want, key=repr) and len(want) > 10


def test_edit_join_of_nothing_and_too_far(spark):
    empty = spark.createDataFrame([], "team int, v string")
    assert similar.edit_join(empty, ["team"], "v").count() == 0
    with pytest.raises(ValueError, match="2/3"):
        similar.edit_join(empty, ["team"], "v", 0.6)


def test_edit_join_meets_by_rare_pieces(spark):
    """A beginning that all share brings nobody together."""
    values = spark.createDataFrame([("t", f"nombre{i * 7919 % 100003:06d}") for i in range(400)], "team string, v string")
    got = similar.edit_join(values, ["team"], "v", 0.9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    words = [r["v"] for r in values.collect()]
    assert got.count() == sum(distance(a, b) <= 1 for a, b in combinations(words, 2))


def test_duplicates(spark):
    random.seed(5)
    first, last = ["Ana", "A", "Eva Ana", "Ana Eva", "Ana Ana", "Jo"], ["Gilbert", "Gilberto", "Gilbart", "Sol", "Sola", "", "X"]
    people = [(t, i * 10 + t, f"{random.choice(first)} {random.choice(last)}".strip(), random.choice(["", None, "s1", "s2", "s3"])) for t in (1, 2) for i in range(60)]
    people += [(1, 9001, None, ""), (1, 9002, "", None), (1, 9003, "Solo", ""), (1, 9004, "Solo", "")]
    players = spark.createDataFrame(people, "team long, player long, name string, slug string")
    got = rows(similar.duplicates(players))
    one = players.fillna("", ["name", "slug"])
    a, b = (one.select("team", *(F.col(c).alias(f"{c}_{s}") for c in ("player", "name", "slug"))) for s in "ab")
    kind = identity.duplicate_kind(F.col("name_a"), F.col("name_b"), F.col("slug_a"), F.col("slug_b"))
    every = rows(a.join(b, "team").where("player_a < player_b").select("team", "player_a", "player_b", kind.alias("kind")).where("kind is not null"))
    assert set(got) <= set(every) and len(got) == len(set(got)) > 100
    # pairs that are missing have an equal one (name and slug) in place of one side
    key = {p: (t, " ".join((n or "").lower().split()), s or "") for t, p, n, s in people}
    lead = {}
    for p in sorted(key):
        lead.setdefault(key[p], p)
    reduced = {(t, x, y, k) for t, x, y, k in every if lead[key[x]] == x and lead[key[y]] == y}
    assert reduced == {r for r in got if lead[key[r[1]]] == r[1] and lead[key[r[2]]] == r[2]}
    assert {r[2] for r in got if lead[key[r[2]]] != r[2]} == {p for p in key if lead[key[p]] != p}


def test_unique_references(spark):
    roster = spark.createDataFrame([("t", "Ana Gil"), ("t", "Eva Gil"), ("t", "Bea Sol"), ("u", "Ana Gil"), ("u", None)], "team string, name string")
    asked = spark.createDataFrame([("t", "Gil", "Ana Gil", 1), ("t", "Ana", "Ana Gil", 2), ("t", "Sol", "Bea Sol", 3), ("u", "Gil", "Ana Gil", 4), ("t", "Ana Gil", "Ana Gil", 5), ("t", None, "Ana Gil", 6), ("t", "Zed", "Zed Gil", 7), ("t", "Sol", None, 8)], "team string, short string, name string, id int")
    assert {r["id"]: r["unique_reference"] for r in matching.unique_references(asked, roster).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True, 8: False}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ordered_scans(spark, parts):
    random.seed(parts)
    at = [DAY + dt.timedelta(seconds=random.choice([1, 30, 61]) * i // 2 + (i // 50) * 500) for i in range(400)]
    data = [(i, None if i % 97 == 0 else at[i], i % 3) for i in range(400)] + [(400 + i, DAY, 9) for i in range(200)]  # many at one time
    df = spark.createDataFrame(data, "id long, at timestamp_ntz, x int").repartition(5)
    order = [F.asc_nulls_first("at"), F.col("id")]
    w = Window.orderBy(*order)
    assert rows(ordered.numbered(df, ["at", "id"], "n", parts)) == rows(df.withColumn("n", F.row_number().over(w) - 1))
    assert rows(ordered.batches(df, ["at", "id"], 20, parts=parts)) == rows(df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 20)))
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    gap = F.coalesce((micros - F.lag(micros).over(w) > 60_000_000).cast("long"), F.lit(0))
    want = df.withColumn("g", gap).withColumn("round", (F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long")).drop("g")
    assert rows(ordered.gap_rounds(df, "at", ["id"], 60, parts=parts)) == rows(want)
    sizes = [r["count"] for r in ordered.range_parts(df, ["at", "id"], parts).groupBy(ordered.PART).count().collect()]
    assert max(sizes) <= 3 * len(data) / parts + 10 and sum(sizes) == len(data)
    assert ordered.numbered(df.where("false"), ["at", "id"]).count() == 0 and ordered.gap_rounds(df.where("false"), "at", ["id"], 60).count() == 0


@pytest.mark.parametrize("parts", [1, 5, 30])
def test_places_within_hot_keys(spark, parts):
    random.seed(parts)
    data = [(i, "hot" if i % 3 else random.choice(["a", "b", None]), random.choice([1, 2, None])) for i in range(500)]
    df = spark.createDataFrame(data, "id long, k string, worth int").repartition(6)
    order = [F.desc("worth"), F.asc("id")]
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert rows(ordered.placed(df, ["k"], order, parts=parts)) == rows(want)
    assert ordered.placed(df.where("false"), ["k"], order).count() == 0


def test_intervals(spark):
    random.seed(3)
    points = [(i, random.choice("ab"), None if i % 41 == 0 else DAY + dt.timedelta(days=random.random() * 900, hours=i)) for i in range(300)] + [(900, "a", DAY), (901, "a", DAY + dt.timedelta(days=10))]
    spans = [(i, random.choice("ab"), DAY + dt.timedelta(days=i * 37), DAY + dt.timedelta(days=i * 37 + random.choice([0, 5, 80, 400]))) for i in range(20)]
    spans += [(50, "a", None, DAY), (51, "a", DAY, None), (52, "a", DAY + dt.timedelta(days=9), DAY), (53, "a", DAY, DAY + dt.timedelta(days=10))]
    p, s = spark.createDataFrame(points, "id long, k string, at timestamp_ntz"), spark.createDataFrame(spans, "span long, k string, a timestamp_ntz, b timestamp_ntz")
    for days in (1, 64, 1000):
        got = intervals.within(p, F.col("at"), s, "a", "b", ["k"], days)
        want = []
        for i, k, at in points:
            inside = [x for x, kk, a, b in spans if kk == k and at and a and b and a <= at <= b]
            want += [(i, x) for x in inside] or [(i, None)]
        assert rows(got.select("id", "span")) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_weeks_of_seasons(spark):
    seasons = spark.createDataFrame([("23/24", dt.date(2023, 8, 11), dt.date(2024, 5, 26)), ("24/25", dt.date(2024, 8, 15), dt.date(2025, 5, 25))], "season string, first date, last date")
    when = [dt.datetime(2023, 8, 10, 23), dt.datetime(2023, 8, 11), dt.datetime(2023, 8, 14), dt.datetime(2024, 5, 26, 23, 59), dt.datetime(2024, 7, 1), dt.datetime(2024, 8, 15), dt.datetime(2025, 5, 25, 20), None]
    points = spark.createDataFrame(list(enumerate(when)), "id int, at timestamp_ntz")
    got = intervals.weeks_of_seasons(points, "at", seasons).select("id", "season", "week")
    assert rows(got) == [(0, None, None), (1, "23/24", 1), (2, "23/24", 2), (3, "23/24", 38), (4, None, None), (5, "24/25", 1), (6, "24/25", 38), (7, None, None)]


def test_rosters_as_of(spark):
    at = lambda d: DAY + dt.timedelta(days=d)
    rosters = spark.createDataFrame([("t", at(0), "Ana", "POR"), ("t", at(0), "Eva", None), ("t", at(10), "Ana", "DEF"), ("u", at(5), "Bea", "MED"), ("t", None, "Zed", "MED")], "team string, fetched_at timestamp_ntz, name string, position string")
    asked = spark.createDataFrame([(1, "t", at(-1)), (2, "t", at(0)), (3, "t", at(9.9)), (4, "t", at(10)), (5, "t", at(39.9)), (6, "t", at(40)), (7, "u", at(6)), (8, "v", at(6)), (9, "t", None), (10, None, at(1))], "id int, team string, at timestamp_ntz")
    got = versions.rosters_as_of(asked, F.col("at"), rosters)
    seen = [("Ana", "POR"), ("Eva", "MED")]
    want = [(1, None, None), *((2, *x) for x in seen), *((3, *x) for x in seen), (4, "Ana", "DEF"), (5, "Ana", "DEF"), (6, None, None), (7, "Bea", "MED"), (8, None, None), (9, None, None), (10, None, None)]
    assert rows(got.select("id", "name", "position")) == sorted(want, key=repr)


def test_residual_cascade(spark):
    items = spark.createDataFrame([(i, i % 5) for i in range(10)] + [(3, 3), (None, 1)], "id long, x int")
    asked = []

    def stage(rule, answers):
        def run(left):
            asked.append(sorted({r["id"] for r in left.collect()}))
            return spark.createDataFrame(answers, "id long, answer string, confidence double, reason string")

        return run

    one = [(1, "a", 0.5, None), (1, "b", 0.9, None), (2, None, None, "weak"), (2, None, 0.1, "known"), (77, "z", 1.0, None), (4, "t", 0.5, None), (4, "s", 0.5, None)]
    two = [(1, "never", 1.0, None), (2, "c", None, None), (3, "d", 0.2, "sure")]
    got = {r["id"]: r for r in residual.residual(items, "id", [("first", stage(0, one)), ("second", stage(0, two)), ("third", stage(0, []))]).collect()}
    assert asked == [list(range(10)), [0, 2, 3, 5, 6, 7, 8, 9], [0, 5, 6, 7, 8, 9]] and len(got) == 10
    assert (got[1]["stage"], got[1]["answer"], got[1]["confidence"], got[1]["failures"]) == ("first", "b", 0.9, [])
    assert (got[4]["answer"], got[3]["stage"], got[3]["answer"]) == ("s", "second", "d")
    assert [tuple(f) for f in got[2]["failures"]] == [("first", "known")] and got[2]["answer"] == "c"
    assert got[0]["stage"] is None and [tuple(f) for f in got[0]["failures"]] == [("first", None), ("second", None), ("third", None)]


def test_top_lists(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "team long")
    news = spark.createDataFrame([(t, i, (i * 7) % 10, f"n{i}") for t in (1, 2, None) for i in range(100)], "team long, id long, worth int, text string")
    few = news.where("team = 2 and id < 2")
    parts = {"news": documents.Part(news, (F.desc("worth"), F.col("id")), 4, ("id", "worth")), "few": documents.Part(few, (F.col("id"),), 5, ("text",))}
    got = {r["team"]: r for r in documents.counted_lists(parents, "team", parts).collect()}
    best = sorted(((i * 7) % 10, -i) for i in range(100))[::-1][:4]
    assert [tuple(e) for e in got[1]["news"]] == [(-i, w) for w, i in best] and got[1]["news_total"] == 100
    assert [e["text"] for e in got[2]["few"]] == ["n0", "n1"] and got[1]["few"] == [] and got[3]["news"] == [] and got[3]["news_total"] == 0
    plan = documents.top_lists(parents, "team", parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
