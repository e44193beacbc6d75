"""Publishing several tables together, parts of tables, merging through declared references, cycles on a store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineupforge.operators import cascade, jobs
from lineupforge.sinks.store import PART, Change, Store

NOW = dt.datetime(2024, 8, 10, 12)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hours(n):
    return NOW + dt.timedelta(hours=n)


def at(when=NOW):
    return F.lit(when).cast("timestamp_ntz")


def frame(spark, data, schema="k long, v string"):
    return spark.createDataFrame(data, schema)


def test_publish_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=4)
    assert store.versions() == [] and store.verify() == []
    one, two = frame(spark, [(i, f"a{i}") for i in range(20)]), frame(spark, [(1, None), (None, "x"), (None, "x")])
    assert store.publish({"one": Change(one, ("k",)), "two": Change(two, ("k",))}) == 1
    broken = two.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):  # between the two tables
        store.publish({"one": Change(one.withColumn("v", F.lit("new")), ("k",)), "two": Change(broken, ("k",))})
    assert store.versions() == [1] and rows(store.read("one")) == rows(one) and rows(store.read("two")) == rows(two)
    assert store.publish({"one": Change(one.limit(0), ("k",))}) == 2
    assert store.read("one").count() == 0 and store.read("one").columns == ["k", "v"] and rows(store.read("two")) == rows(two)
    assert rows(store.read("one", version=1)) == rows(one) and store.verify() == [] and store.verify(1) == []
    assert store.roll_back(1) == 3 and rows(store.read("one")) == rows(one)
    assert len(store.vacuum(keep=1)) == 2 and store.versions() == [3]  # of the failed publication and of the second
    assert rows(store.read("one")) == rows(one) and store.verify() == []


def test_parts_and_logs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=8)
    one = frame(spark, [(i, f"a{i}") for i in range(40)])
    store.publish({"one": Change(one, ("k",)), "log": Change(one.limit(0), ("k",))})
    few = frame(spark, [(3, None), (7, None)]).select("k")
    parts = store.parts_of(few)
    inside = one.where(store.part_of("k").isin(list(parts)))
    assert 0 < len(parts) <= 2 and rows(store.read("one", parts)) == rows(inside)
    read = {f.split(f"{PART}=")[1].split("/")[0] for f in store.read("one", parts).inputFiles()}
    assert read == {str(p) for p in parts}  # the plan has the files of these parts alone
    paths = {k: v for k, v in store.manifest()["tables"]["one"]["parts"].items() if int(k) not in parts}
    store.publish({"one": Change(one.withColumn("v", F.lit("new")), ("k",), parts), "log": Change(few.withColumn("v", F.lit("l")), ("k",), append=True)})
    after = store.manifest()["tables"]["one"]["parts"]
    assert all(after[k] == v for k, v in paths.items())  # the rest was not written
    want = one.withColumn("v", F.when(store.part_of("k").isin(list(parts)), "new").otherwise(F.col("v")))
    assert rows(store.read("one")) == rows(want)
    store.publish({"log": Change(few.withColumn("v", F.lit("l")), ("k",), append=True)})
    assert rows(store.read("log")) == [(3, "l"), (3, "l"), (7, "l"), (7, "l")] and store.verify() == []
    with pytest.raises(ValueError, match="schema"):
        store.publish({"one": Change(few, ("k",), parts)})
    with pytest.raises(ValueError, match="no version"):
        store.read("one", version=99)


def test_verify_finds_damage(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=2)
    one = frame(spark, [(i, f"a{i}") for i in range(20)])
    store.publish({"one": Change(one, ("k",))})
    part, files = next(iter(store.manifest()["tables"]["one"]["parts"].items()))
    one.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/s/{files[0]['path']}")
    assert store.verify() == [("one", int(part))]
    with pytest.raises(ValueError, match="damaged"):
        store.roll_back(1)


def merged(spark, leaders, **tables):
    schemas = {
        "players": "player long, name string", "forecasts": "player long, source string, p int, fetched_at timestamp_ntz", "events": "player long, event string",
        "consensus": "player long, p int", "source_ids": "player long, source string, slug string", "mappings": "player long, slug string", "unmatched": "raw string, resolved long",
    }
    given = {k: frame(spark, tables.get(k, []), v) for k, v in schemas.items()}
    out = cascade.merge(cascade.PLAYERS, given, "players", "player", frame(spark, leaders, "follower long, leader long"))
    return {k: rows(v) for k, v in out.items()}, given, out


def test_cascade_moves_every_reference(spark):
    got, given, out = merged(
        spark, [(2, 1), (3, 1), (5, 4)], players=[(i, f"n{i}") for i in range(1, 7)],
        forecasts=[(1, "a", 10, hours(0)), (2, "a", 20, hours(0)), (3, "a", 30, hours(-1)), (2, "b", 40, hours(0)), (3, "b", 50, hours(1)), (4, "a", 60, hours(0)), (5, "a", 70, hours(2)), (6, "a", 80, hours(0)), (5, "c", 90, None), (4, "c", 95, hours(-9))],
        events=[(2, "x"), (2, "x"), (3, "y"), (6, "z"), (None, "n")], consensus=[(1, 1), (2, 2), (5, 5), (6, 6)],
        source_ids=[(1, "s", "one"), (2, "s", "two"), (3, "t", "three"), (2, "t", "four"), (None, "t", "five"), (None, "t", "six")], mappings=[(3, "m3"), (2, "m2")], unmatched=[("r", 2), ("r", None), ("q", 6)],
    )
    assert got["players"] == [(1, "n1"), (4, "n4"), (6, "n6")]
    # a tie stays with the leader, then the smallest follower; a newer row of a follower wins; no time is oldest
    assert got["forecasts"] == sorted([(1, "a", 10, hours(0)), (1, "b", 50, hours(1)), (4, "a", 70, hours(2)), (6, "a", 80, hours(0)), (4, "c", 95, hours(-9))], key=repr)
    assert got["events"] == sorted([(1, "x"), (1, "x"), (1, "y"), (6, "z"), (None, "n")], key=repr)
    assert got["consensus"] == [(1, 1), (4, 5), (6, 6)] and got["mappings"] == [(1, "m2")]
    assert got["source_ids"] == sorted([(1, "s", "one"), (1, "t", "four"), (None, "t", "five"), (None, "t", "six")], key=repr)
    assert got["unmatched"] == sorted([("r", 1), ("r", None), ("q", 6)], key=repr)
    names = {"players": "player"}
    assert cascade.dangling(cascade.PLAYERS, out, names).count() == 0
    without = out | {"players": out["players"].where("player != 6")}
    assert rows(cascade.dangling(cascade.PLAYERS, without, names)) == [("consensus", "player", 1), ("events", "player", 1), ("forecasts", "player", 1), ("unmatched", "resolved", 1)]


def test_cascade_without_leaders_or_rows(spark):
    got, given, _ = merged(spark, [], players=[(1, "a")], forecasts=[(1, "a", 1, None), (1, "a", 2, None)])
    assert got == {k: rows(v) for k, v in given.items()}
    got, _, _ = merged(spark, [(2, 1)])
    assert all(v == [] for v in got.values())


def test_cascade_wants_all_declared(spark):
    leaders = frame(spark, [(2, 1)], "follower long, leader long")
    players = frame(spark, [(1, "a")], "player long, name string")
    with pytest.raises(ValueError, match="not declared: .'extra'"):
        cascade.merge({"players": cascade.Table()}, {"players": players, "extra": players}, "players", "player", leaders)
    with pytest.raises(ValueError, match="not given: .'events'"):
        cascade.merge({"players": cascade.Table(), "events": cascade.Table({"player": "players"})}, {"players": players}, "players", "player", leaders)
    with pytest.raises(ValueError, match="clubs, which is not declared"):
        cascade.order_of({"players": cascade.Table({"club": "clubs"})}, "players")
    with pytest.raises(ValueError, match="circle"):
        cascade.order_of({"a": cascade.Table({"x": "b"}), "b": cascade.Table({"y": "a"})}, "a")
    chain = {"players": cascade.Table(), "bridge": cascade.Table({"player": "players"}), "notes": cascade.Table({"bridge": "bridge"}), "other": cascade.Table()}
    assert cascade.order_of(chain, "players") == ["notes", "bridge", "players"]


def test_cascade_can_drop_followers_rows(spark):
    schema = {"players": cascade.Table(), "source_ids": cascade.Table({"player": "players"}, drop=True)}
    tables = {"players": frame(spark, [(1, "a"), (2, "b")], "player long, name string"), "source_ids": frame(spark, [(1, "x"), (2, "y")], "player long, slug string")}
    out = cascade.merge(schema, tables, "players", "player", frame(spark, [(2, 1)], "follower long, leader long"))
    assert rows(out["source_ids"]) == [(1, "x")] and rows(out["players"]) == [(1, "a")]


REPORT = "source string, team string, ord int, raw string, probability double, certain boolean, kind string, note string, position string, photo string"
EVENT = "source string, team string, raw string, event string, severity string, reason string, expected_return string, note string"
INFO, PIECES = "team string, source string, coach string, formation string, news string", "team string, source string, penalty array<string>, corner array<string>, free_kick array<string>"
SQUAD = "player long, team string, ord long, name string, position string, photo string, closed boolean"


def started(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=16)
    squad = [(10 * t + i, f"t{t}", i, f"First{t}x{i} Last{t}x{i}", None, None, True) for t in range(12) for i in range(3)]
    squad += [(500, "t1", 9, "Lookman", None, None, True), (501, "t1", 10, "Ademola Lookman", None, None, True), (502, "t2", 11, "Open Door", None, None, False)]
    jobs.begin(store, frame(spark, squad, SQUAD))
    sources = frame(spark, [("a", True, 1.0), ("b", True, 3.0), ("c", False, 1.0)], "source string, enabled boolean, weight double")
    return store, sources


def asked(spark, **errors):
    return frame(spark, [(s, False, errors.get(s)) for s in ("a", "b", "c")], "source string, partial boolean, error string")


def told(spark, source, team, names, **more):
    return [(source, team, i, n, float(p), more.get("certain"), more.get("kind"), None, None, None) for i, (n, p) in enumerate(names)]


def cycle(spark, store, sources, reports, when, events=(), info=(), pieces=(), everything=False, **errors):
    frames = frame(spark, reports, REPORT), frame(spark, list(events), EVENT), frame(spark, list(info), INFO), frame(spark, list(pieces), PIECES)
    return jobs.run(store, asked(spark, **errors), sources, *frames, at(when), everything=everything)


def test_cycles_on_a_store(spark, tmp_path):
    store, sources = started(spark, tmp_path)
    first = [r for t in range(4) for s in ("a", "b") for r in told(spark, s, f"t{t}", [(f"First{t}x{i} Last{t}x{i}", 30 * i) for i in range(3)])]
    cycle(spark, store, sources, first, hours(0), info=[("t0", "a", "Coach", "4-4-2", None), ("t0", "b", None, "4-3-3", "n")], pieces=[("t0", "a", ["x"], [], None)])
    had = {r["player"]: r for r in store.read("consensus").collect()}
    assert had[2]["probability"] == 60 and had[2]["sources_total"] == 2 and len(had) == 12
    assert [(a["source"], a["probability"], a["fetched_at"], a["kind"]) for a in had[2]["agreement"]] == [("a", 60, hours(0), "probable"), ("b", 60, hours(0), "probable")]
    about = {r["team"]: r for r in store.read("team_consensus").collect()}
    assert len(about) == 12 and about["t0"]["formation"] == "4-3-3" and about["t0"]["coach"] == "Coach" and about["t5"]["set_pieces"] is None
    assert about["t0"]["set_pieces"].asDict() == {"penalty": ["x"], "corner": [], "free_kick": []}
    assert rows(store.read("players").where("name like '%ookman'").select("player")) == [(501,)]  # merged before the consensus

    # one source reports one team, another fails; a name nobody has, an event of nobody, a row outside the closed roster
    before = store.manifest()["tables"]
    news = told(spark, "a", "t0", [("Last0x1", 90), ("Nobody Known", 70.4), ("  ", 5)], certain=True, kind="confirmed") + told(spark, "a", "t2", [("Open Door", 50)]) + told(spark, "b", "t1", [("Last1x1", 99)])
    events = [("a", "t0", "Last0x2", "injury", None, "knee", "soon", "out"), ("a", "t0", "Some Body", "doubt", "light", None, None, "gone")]
    version, parts = cycle(spark, store, sources, news, hours(1), events=events, info=[("t0", "a", None, None, None)], b="timeout")
    after = store.manifest()["tables"]
    assert version == 3 and set(parts) == set(store.parts_of(frame(spark, [("t0",), ("t2",)], "team string")))
    for name in jobs.TABLES:  # untouched parts are the same files
        assert all(before[name]["parts"].get(k) == v for k, v in after[name]["parts"].items() if int(k) not in parts)
    now = {r["player"]: r for r in store.read("consensus").collect()}
    assert (now[1]["probability"], now[2]["probability"], now[2]["sources_likely"]) == (45, 45, 1) and now[1]["updated_at"] == hours(1)  # (90 + 3 * 30) / 4, (0 + 3 * 60) / 4
    assert [(a["source"], a["kind"]) for a in now[1]["agreement"]] == [("a", "confirmed"), ("b", "probable")]
    assert all(now[p] == had[p] for p in had if p >= 10 and p // 10 != 2)  # other teams' rows stay as they were
    letters = store.read("unmatched").select("team", "source", "raw", "normalized", "probability", "certain", "kind", "note", "fetched_at")
    assert rows(letters) == sorted([
        ("t0", "a", "Nobody Known", "Nobody Known", 70, True, "confirmed", None, hours(1)), ("t0", "a", "Some Body", "Some Body", None, False, "probable", None, hours(1)),
        ("t2", "a", "Open Door", "Open Door", 50, False, "probable", None, hours(1))], key=repr)
    assert rows(store.read("events")) == [("t0", 2, "a", "injury", "none", "knee", "soon", "out", hours(1))]
    runs = {(r["source"], r["finished_at"]): (r["status"], r["items"]) for r in store.read("runs").collect()}
    assert runs == {("a", hours(0)): ("success", 12), ("b", hours(0)): ("success", 12), ("a", hours(1)): ("success", 1), ("b", hours(1)): ("failed", 0)}
    assert rows(store.read("info").where("team = 't0' and source = 'a'"))[0][2:4] == ("Coach", "4-4-2")  # what is missing keeps the old

    # nothing but a failure: the ledger alone
    version, parts = cycle(spark, store, sources, news, hours(2), a="timeout", b="timeout")
    assert parts == () and store.manifest()["tables"]["consensus"] == after["consensus"] and store.read("runs").count() == 6

    # what source b said goes stale by itself: only a's report of t0 at hour 1 is fresh at hour 12.5
    version, parts = cycle(spark, store, sources, told(spark, "a", "t7", [("Last7x1", 10)]), hours(12) + dt.timedelta(minutes=30))
    late = {r["player"]: r for r in store.read("consensus").collect()}
    assert (late[1]["probability"], late[1]["sources_total"]) == (90, 1)
    assert late[12] == now[12]  # nothing fresh is known of it: the stale row stays
    about = {r["team"]: r for r in store.read("team_consensus").collect()}
    assert about["t0"]["formation"] == "4-4-2" and about["t0"]["set_pieces"] is None  # of a alone; nulls are written over

    # the same as a cycle over everything
    kept = {name: rows(store.read(name).drop("updated_at")) for name in ("consensus", "team_consensus", "due", "forecasts")}
    cycle(spark, store, sources, told(spark, "a", "t7", [("Last7x1", 10)]), hours(12) + dt.timedelta(minutes=30), everything=True)
    assert {name: rows(store.read(name).drop("updated_at")) for name in kept} == kept
    assert store.verify() == []
