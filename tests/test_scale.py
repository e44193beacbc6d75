"""Steps whose cost must not grow with the rows that repeat a value."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from lineupforge.operators import bridging, identity, matching, odds, ranking, similar
from lineupforge.plans import structures
from lineupforge.sinks.shared import looked_up


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_looked_up_keeps_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, None, 3), ("b", "c", 4)], "x string, y string, i int")
    got = looked_up(rows, ["x", "y"], both=F.concat_ws("/", "x", "y")).orderBy("i").collect()
    assert [(r["i"], r["both"]) for r in got] == [(1, "a"), (2, "a"), (3, ""), (4, "b/c")]


def test_evidence_compares_distinct_values(spark):
    local = spark.createDataFrame([(i, "Ana Ruiz", "Betis", "2000-01-01", "España") for i in range(3)] + [(9, "Eva", None, None, None)], "local_id long, name string, team string, born string, nationality string")
    found = spark.createDataFrame([(i, f"s{i}", "Ruiz Ana", None, None, "Real Betis", None, "2000-01-01T00:00", "espana") for i in range(3)], "local_id long, slug string, display string, first string, last string, club string, club_slug string, born string, nationality string")
    seen = identity.evidence(local, found)
    assert "regexp_replace" not in _plan(seen)  # names and clubs are read once a value, not once a row
    got = {r["local_id"]: tuple(r)[1:] for r in seen.collect()}
    assert got[0] == ("s0", 1.0, True, True, True, False) and got[9] == (None, None, None, None, None, True)


def test_club_is_normalised_once(spark):
    df = spark.createDataFrame([("Real Betis",), ("x",)], "c string").select(identity.club_key(F.col("c")).alias("k"))
    assert _plan(df).count("regexp_replace") <= 2
    assert [r["k"] for r in df.collect()] == ["betis", None]


def test_bridge_reads_decisions_once(spark):
    cols = "local_id long, slug string, external_id string, name string, confidence long, status string, method string, reason string"
    made = spark.createDataFrame([(1, "a", "xa", "n", 900, "matched", "m", "r"), (2, "a", "xa", "n", 900, "matched", "m", "r")], cols)
    ranked = spark.createDataFrame([(1, "a", 0.9)], "local_id long, slug string, confidence double")
    held = spark.createDataFrame([(7, "b")], "local_id long, slug string")
    out = bridging.bridge_rows(made, ranked, held, F.current_timestamp())
    assert _plan(out).count("Join") == 2
    assert {r["local_id"]: (r["status"], r["reason"]) for r in out.collect()} == {1: ("matched", "r"), 2: ("manual_review", bridging.TAKEN)}


def test_near_misses_meet_by_distinct_names(spark):
    roster = spark.createDataFrame([("t", i, i, "Ana Ruiz") for i in range(40)] + [("t", 50, 50, None)], "team string, ord long, player long, name string")
    cases = spark.createDataFrame([("t", i, "Ruiz") for i in range(30)] + [("t", 99, None)], "team string, case_id long, raw string")
    near = matching.near_misses(cases, roster)
    assert near.count() == 1200 and near.select("rule", "confidence").distinct().count() == 1
    plan = near._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan  # no rows of either side go to the driver


def test_match_counts_players_of_one_name(spark):
    roster = spark.createDataFrame([("t", 2, 12, "Ana Ruiz"), ("t", 1, 11, "Ana Ruiz"), ("t", 3, 13, "Eva Paz")], "team string, ord long, player long, name string")
    cases = spark.createDataFrame([("t", 1, "Ruiz"), ("t", 2, "Ana Ruiz"), ("t", 3, "Paz")], "team string, case_id long, raw string")
    found = matching.match_roster(cases, roster)
    assert {r["case_id"]: (r["player"], r["rule"]) for r in found.collect()} == {2: (11, "exact"), 3: (13, matching.UNIQUE)}
    left = matching.unmatched(cases, found)
    assert [r["case_id"] for r in left.collect()] == [1] and "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()


def test_name_pairs_are_scored_once_a_name(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def both(a, b):
        calls.add(1)
        return f"{a}{b}"

    rows = spark.createDataFrame([("g", i, "xy"[i % 2]) for i in range(20)] + [("h", 30, "x"), (None, 31, "x"), (None, 32, "x")], "g string, i long, n string")
    got = similar.name_pairs(rows, ["g"], "i", "n", said=both(F.col("a_name"), F.col("b_name")))
    pairs = [(r["a_i"], r["b_i"], r["said"]) for r in got.collect()]
    assert sorted(pairs) == [(i, j, "xy"[i % 2] + "xy"[j % 2]) for i in range(20) for j in range(i + 1, 20)]
    assert calls.value <= 5


def test_ranking_and_search_compare_distinct_values(spark):
    rows = spark.createDataFrame([(i, "Fede Ruiz", "Real Azul", f"s{i}", "Federico Ruiz", "Azul CF", None) for i in range(3)], "local_id long, name string, team string, slug string, display_name string, club string, club_slug string")
    made = ranking.scored(rows)
    assert "regexp_replace" not in _plan(made) and {(r["name_score"], r["team_match"]) for r in made.collect()} == {(1.0, True)}
    local = spark.createDataFrame([(1, "Ana Ruiz", "Betis", "2000-01-01", "España")], "local_id long, name string, team string, born string, nationality string")
    hits = spark.createDataFrame([(1, "s1", "Ruiz Ana", "Real Betis", "2000-01-01T00:00", "espana")], "local_id long, slug string, display string, club string, born string, nationality string")
    seen = identity.searched(local, hits)
    assert "regexp_replace" not in _plan(seen) and [tuple(r) for r in seen.collect()] == [(1, "s1", 1.0, True, True, True)]
    named = identity.with_name_score(local, F.col("name"), F.lit("Ruiz Ana"), F.lit(""))
    assert named.columns == [*local.columns, "name_score"] and "regexp_replace" not in _plan(named)


def _feed(spark):
    """Three matches with lines of bookmakers, and the same with the bookmakers nested."""
    line = "event_id long, place int, key string, title string, home double, draw double, away double"
    lines = spark.createDataFrame([(1, 2, "z", "Z", 2.0, 3.0, 4.0), (1, 1, "p", "P", 1.0, 3.0, 4.0), (1, 3, "y", "Y", 5.0, 5.0, 5.0), (2, 4, "p", "P", 2.0, 2.0, 2.0), (2, 1, "z", "Z", 3.0, 3.0, 4.0), (3, 1, "p", "P", None, 3.0, float("inf"))], line)
    events = spark.sql("SELECT id + 1 AS event_id, 'l' AS competition, timestamp_ntz'2024-08-10 12:00:00' + make_dt_interval(4 * CAST(id AS INT)) AS commence, 'A FC' AS home_team, 'B' AS away_team FROM range(4)")
    outcomes = F.expr("array(struct('A FC' AS name, home AS price), struct('Draw' AS name, draw AS price), struct('B' AS name, away AS price))")
    book = F.struct("place", "key", "title", F.array(F.struct(F.lit("h2h").alias("key"), outcomes.alias("outcomes"))).alias("markets"))
    books = lines.groupBy("event_id").agg(F.sort_array(F.collect_list(book)).alias("bookmakers"))
    return events, lines, events.join(books, "event_id", "left")


def test_odds_of_a_match_are_made_before_it_meets_its_competition(spark):
    events, lines, nested = _feed(spark)
    teams, aliases = spark.createDataFrame([("a", 7)], "slug string, team_id int"), spark.createDataFrame([("a", "a")], "key string, slug string")
    season = (F.lit("2020-08-05").cast("timestamp_ntz"), F.lit("2020-12-01").cast("timestamp_ntz"))
    flat = odds.normalized(events, teams, aliases, ["p"], season, lines)
    both = [odds.normalized(nested, teams, aliases, ["p"], season), flat]
    want = [(1, 7, None, 1, 46, 31, 23, "Z"), (2, 7, None, 2, 34, 33, 33, "P"), (3, 7, None, 3, None, None, None, None), (4, 7, None, 4, None, None, None, None)]
    for made in both:
        assert [tuple(r) for r in made.drop("competition", "commence").orderBy("event_id").collect()] == want
        plan = _plan(made)  # the outermost step comes first
        assert plan.index("Window") < plan.index("array_min" if made is both[0] else "min(struct")
    assert "collect_list" not in _plan(flat)


def test_odds_normalized_by_sql_on_a_match_without_clubs(spark, tmp_path):
    spark.sql("SELECT CAST(id AS INT) AS n_nationkey, concat('N', id) AS n_name FROM range(25)").write.parquet(str(tmp_path / "nation.parquet"))
    orders = "SELECT id AS o_orderkey, IF(id = 2, NULL, id * 7) AS o_custkey, timestamp_ntz'1995-08-01 00:00:00' + make_dt_interval(3 * CAST(id AS INT)) AS o_orderdate FROM range(40)"
    spark.sql(orders).write.parquet(str(tmp_path / "orders.parquet"))
    lineitem = "SELECT id % 38 AS l_orderkey, CAST(id % 5 AS INT) AS l_linenumber, CAST(id % 11 AS DOUBLE) AS l_quantity, (id % 10) / 100D AS l_discount, (id % 9) / 100D AS l_tax, element_at(array('A', 'N', 'R'), CAST(id % 3 AS INT) + 1) AS l_returnflag, IF(id % 2 = 0, 'O', 'F') AS l_linestatus FROM range(150)"
    spark.sql(lineitem).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = structures.odds_normalized(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("nation", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(structures.SQL["odds_normalized"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert [r["bookmaker"] is not None for r in got.where("event_id = 2").collect()] == [True]
