"""Relational operators, upserts, odds, prices and reports over the TPC-like tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numeric as N
from ..operators import prices, roster
from ..operators import state as S
from ..operators.odds import best_lines, three_way
from .registry import registry, table

QUERIES, SQL, query = registry()
C = F.col


def _t(spark, sf_dir, *names):
    out = [table(spark, sf_dir, n) for n in names]
    return out if len(out) > 1 else out[0]


@query("""SELECT c_custkey, CASE WHEN d.c_acctbal IS NOT NULL THEN d.c_acctbal ELSE b.c_acctbal END AS c_acctbal, coalesce(d.seg, b.c_mktsegment) AS c_mktsegment FROM customer b FULL JOIN
(SELECT c_custkey + 10 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END AS seg FROM customer WHERE c_custkey % 5 = 0) d USING (c_custkey)""")
def coalesce_upsert(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    delta = base.where("c_custkey % 5 = 0").select((C("c_custkey") + 10).alias("c_custkey"), F.when(C("c_custkey") % 2 == 0, C("c_acctbal") + 1).alias("c_acctbal"), F.when(C("c_custkey") % 3 == 0, F.lit("NEW")).alias("c_mktsegment"))
    return S.coalescing_upsert(base, delta, ["c_custkey"])


@query("""SELECT p_partkey, array_to_string(CASE WHEN len(d.takers) > 0 THEN d.takers ELSE b.takers END, '|') AS takers FROM (SELECT p_partkey, [p_brand, p_type] AS takers FROM part) b LEFT JOIN
(SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_type] ELSE [] END AS takers FROM part WHERE p_partkey % 4 = 0) d USING (p_partkey)""")
def array_upsert(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    base = p.select("p_partkey", F.array("p_brand", "p_type").alias("takers"))
    delta = p.where("p_partkey % 4 = 0").select("p_partkey", F.when(C("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("takers"))
    return S.array_upsert(base, delta, ["p_partkey"]).select("p_partkey", F.array_join("takers", "|").alias("takers"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def guarded_upsert(spark, sf_dir):
    """Rows already settled (F) are never overwritten."""
    base = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.guarded_upsert(base, base.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"], C("o_orderstatus") != "F")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 50, 'new' FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark, sf_dir):
    base = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return S.insert_ignore(base, base.select((C("s_suppkey") + 50).alias("s_suppkey"), F.lit("new").alias("s_name")), ["s_suppkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def delete_not_in_feed(spark, sf_dir):
    part, li = _t(spark, sf_dir, "part", "lineitem")
    return S.delete_missing(part.select("p_partkey", "p_name"), li.where("l_quantity > 45").select(C("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 10 = 0")
def upsert_last_wins(spark, sf_dir):
    base = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.upsert(base, base.where("o_orderkey % 10 = 0").withColumn("o_totalprice", C("o_totalprice") * 2), ["o_orderkey"])


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_partkey % 2 = 0 THEN 'fresh' ELSE p_type END AS p_type FROM part""")
def partial_group_upsert(spark, sf_dir):
    base = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_type", "p_size")
    delta = base.withColumn("p_retailprice", C("p_retailprice") + 1).withColumn("p_type", F.lit("fresh"))
    out = S.group_upsert(base, delta, ["p_partkey"], {"price": ["p_retailprice"], "kind": ["p_type"], "size": ["p_size"]}, {"price": C("p_size") > 25, "kind": C("p_partkey") % 2 == 0, "size": F.lit(False)})
    return out.select("p_partkey", "p_retailprice", "p_type")


DEVIG = """SELECT l_orderkey, l_linenumber, CAST(b1 + CASE WHEN a1 < l THEN 1 ELSE 0 END AS INTEGER) AS home, CAST(b2 + CASE WHEN a2 < l THEN 1 ELSE 0 END AS INTEGER) AS draw, CAST(b3 + CASE WHEN a3 < l THEN 1 ELSE 0 END AS INTEGER) AS away FROM (
SELECT *, 100 - b1 - b2 - b3 AS l, (r2 > r1)::INT + (r3 > r1)::INT AS a1, (r1 >= r2)::INT + (r3 > r2)::INT AS a2, (r1 >= r3)::INT + (r2 >= r3)::INT AS a3 FROM (
SELECT *, x1 - b1 AS r1, x2 - b2 AS r2, x3 - b3 AS r3 FROM (SELECT *, floor(x1)::INT AS b1, floor(x2)::INT AS b2, floor(x3)::INT AS b3 FROM (
SELECT *, 100.0::DOUBLE * i1 / (i1 + i2 + i3) AS x1, 100.0::DOUBLE * i2 / (i1 + i2 + i3) AS x2, 100.0::DOUBLE * i3 / (i1 + i2 + i3) AS x3 FROM (
SELECT l_orderkey, l_linenumber, 1.0::DOUBLE / o1 AS i1, 1.0::DOUBLE / o2 AS i2, 1.0::DOUBLE / o3 AS i3 FROM (
SELECT l_orderkey, l_linenumber, CASE WHEN fine THEN o1 END AS o1, CASE WHEN fine THEN o2 END AS o2, CASE WHEN fine THEN o3 END AS o3 FROM (
SELECT *, o1 > 1 AND o2 > 1 AND o3 > 1 AS fine FROM (SELECT l_orderkey, l_linenumber, l_quantity / 4.0::DOUBLE AS o1, 3.0::DOUBLE + l_discount AS o2, 1.0::DOUBLE + l_tax * 50 AS o3 FROM lineitem))))))))"""


@query(DEVIG)
def devig_odds(spark, sf_dir):
    """Odds without the margin, as percentages that sum to 100; null where an odd is not above 1."""
    li = _t(spark, sf_dir, "lineitem")
    d = N.devig(C("l_quantity") / 4.0, 3.0 + C("l_discount"), 1.0 + C("l_tax") * 50)
    return li.select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", "d.home", "d.draw", "d.away")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 0), 99), o_orderkey) AS rn
FROM orders WHERE o_totalprice > 1000) WHERE rn = 1""")
def best_bookmaker(spark, sf_dir):
    """The first valid market by preference."""
    rank = F.array_position(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM"])), C("o_orderpriority"))
    rows = _t(spark, sf_dir, "orders").where("o_totalprice > 1000").select("o_custkey", "o_orderkey", "o_orderpriority")
    return S.first_per_key(rows, ["o_custkey"], [F.when(rank > 0, rank).otherwise(99), C("o_orderkey")])


@query("""SELECT l_partkey, min(l_extendedprice) AS floor_price, arg_min(l_suppkey, (l_extendedprice, l_orderkey, l_linenumber)) AS floor_supplier FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_partkey""")
def floor_price(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    return li.groupBy("l_partkey").agg(F.min("l_extendedprice").alias("floor_price"), F.min_by("l_suppkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("floor_supplier"))


@query("""SELECT p_partkey, CASE WHEN d > 0 THEN d WHEN p > 0 THEN p WHEN a > 0 THEN a END AS sale, CASE WHEN least(CASE WHEN d > 0 THEN d END, CASE WHEN p > 0 THEN p END, CASE WHEN a > 0 THEN a END) > 0 THEN least(CASE WHEN d > 0 THEN d END, CASE WHEN p > 0 THEN p END, CASE WHEN a > 0 THEN a END) END AS lowest
FROM (SELECT p_partkey, p_size - 30 AS d, CASE WHEN p_size % 2 = 0 THEN p_size END AS p, p_size - 10 AS a FROM part)""")
def price_choice(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (C("p_size") - 30).alias("d"), F.when(C("p_size") % 2 == 0, C("p_size")).alias("p"), (C("p_size") - 10).alias("a"))
    return p.select("p_partkey", N.sale_price(C("d"), C("p"), C("a")).alias("sale"), N.positive_price(C("d"), C("p"), C("a")).alias("lowest"))


@query("""SELECT n_name, count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS matched, count(*) FILTER (c_acctbal <= 0) AS not_found,
floor(count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 0) * 100.0::DOUBLE * 100 / count(*) + 0.5) / 100 AS coverage FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def status_pivot(spark, sf_dir):
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    matched = F.count_if((C("c_mktsegment") == "BUILDING") & (C("c_acctbal") > 0))
    rows = customer.join(nation, C("c_nationkey") == C("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("total"), matched.alias("matched"), F.count_if(C("c_acctbal") <= 0).alias("not_found"))
    return rows.withColumn("coverage", N.percent(C("matched"), C("total")))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000")
def left_composite_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    on = (C("o_custkey") == C("c_custkey")) & (C("o_orderstatus") == "F") & (C("o_totalprice") > 200000)
    return customer.join(orders, on, "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def semi_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return customer.join(orders.where("o_totalprice > 150000"), C("c_custkey") == C("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def anti_join(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return customer.join(orders.where("o_totalprice > 150000"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT l.l_orderkey, l.l_linenumber, coalesce(a.p_name, b.p_name) AS name FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size < 25) a ON a.p_partkey = l.l_partkey LEFT JOIN part b ON b.p_partkey = l.l_suppkey""")
def priority_join(spark, sf_dir):
    """The first key if it matches, else the second: two joins, no OR."""
    li, part = _t(spark, sf_dir, "lineitem", "part")
    first = part.where("p_size < 25").select(C("p_partkey").alias("l_partkey"), C("p_name").alias("a"))
    second = part.select(C("p_partkey").alias("l_suppkey"), C("p_name").alias("b"))
    return li.join(first, "l_partkey", "left").join(second, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("a", "b").alias("name"))


@query("""SELECT n_name, r_name, count(*) AS suppliers, CAST(count(DISTINCT s_acctbal > 0) AS BIGINT) AS signs FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 OR s_nationkey = 3 GROUP BY ALL""")
def joined_counts(spark, sf_dir):
    s, n, r = _t(spark, sf_dir, "supplier", "nation", "region")
    rows = s.where((C("s_acctbal") > 0) | (C("s_nationkey") == 3)).join(n, C("s_nationkey") == C("n_nationkey")).join(r, C("n_regionkey") == C("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.countDistinct(C("s_acctbal") > 0).alias("signs"))


@query("""WITH m AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 5 > 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS matchday FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10),
r AS (SELECT DISTINCT matchday FROM m ORDER BY matchday DESC NULLS LAST LIMIT 2) SELECT m.o_orderkey, m.matchday FROM m WHERE EXISTS (SELECT 1 FROM r WHERE r.matchday IS NOT DISTINCT FROM m.matchday)""")
def rounds_current_next(spark, sf_dir):
    """Fixtures of the first two rounds among the newest ten; a null round equals a null round."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(C("o_orderkey") % 5 > 0, F.month("o_orderdate")).alias("matchday"))
    newest = orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    rounds = newest.select(C("matchday").alias("r")).distinct().orderBy(F.desc_nulls_last("r")).limit(2)
    return newest.join(rounds, C("matchday").eqNullSafe(C("r")), "left_semi").select("o_orderkey", "matchday")


@query("""SELECT n_nationkey, lag(n_name) OVER (ORDER BY n_name) AS previous, lead(n_name) OVER (ORDER BY n_name) AS next FROM nation""")
def team_nav(spark, sf_dir):
    """Neighbours in name order; nation is a catalogue of fixed size."""
    w = Window.orderBy("n_name")
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.lag("n_name").over(w).alias("previous"), F.lead("n_name").over(w).alias("next"))


@query("""SELECT l_orderkey, list_avg(s) AS average, s[1] AS latest, CAST(len(s) AS INTEGER) AS records, s[1] AS s1, s[2] AS s2, s[3] AS s3, s[4] AS s4, s[5] AS s5
FROM (SELECT l_orderkey, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_quantity) AS s FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_orderkey)""")
def score_slots(spark, sf_dir):
    """Mean, first, number and five slots (null where missing) of the last five scores, the latest first; what is no
    finite number doesn't count."""
    finite = (~F.isnan("l_quantity")) & (F.abs("l_quantity") != float("inf"))
    last = _t(spark, sf_dir, "lineitem").where("l_linenumber <= 5").where(finite).select("l_orderkey", F.struct("l_linenumber", C("l_quantity").cast("double").alias("q")).alias("x"))
    scores = last.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x"))["q"].alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    slots = [F.try_element_at("s", F.lit(i)).alias(f"s{i}") for i in range(1, 6)]
    return scores.select("l_orderkey", mean.alias("average"), F.try_element_at("s", F.lit(1)).alias("latest"), F.size("s").alias("records"), *slots)


@query("""SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 7""")
def set_difference(spark, sf_dir):
    s, li = _t(spark, sf_dir, "supplier", "lineitem")
    return s.select("s_suppkey").distinct().join(li.where("l_quantity > 49 and l_linenumber = 7"), C("s_suppkey") == C("l_suppkey"), "left_anti")


@query("""SELECT c_custkey, '"' || replace(c_name, '"', '""') || ',x"' AS cell, c_custkey // 1000000 AS span,
(row_number() OVER (PARTITION BY c_custkey // 1000000 ORDER BY c_custkey) - 1) // 20 AS batch FROM customer""")
def csv_batches(spark, sf_dir):
    """CSV cells, and batches of 20 requests, numbered within spans of a million keys: no task numbers all of them."""
    from ..functions.text import csv_cell

    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name").withColumn("span", F.floor(C("c_custkey") / 1_000_000))
    batch = F.floor((F.row_number().over(Window.partitionBy("span").orderBy("c_custkey")) - 1) / 20)
    return rows.select("c_custkey", csv_cell(F.concat("c_name", F.lit(",x"))).alias("cell"), "span", batch.alias("batch"))


@query("""SELECT coalesce(n_name, 'all') AS team, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS matched, floor(count(*) FILTER (c_acctbal > 0) * 100.0::DOUBLE * 100 / count(*) + 0.5) / 100 AS coverage
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)""")
def coverage_report(spark, sf_dir):
    """Matched per team, with a row for all."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    rows = customer.join(nation, C("c_nationkey") == C("n_nationkey")).rollup("n_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(C("c_acctbal") > 0).alias("matched"))
    return rows.select(F.coalesce("n_name", F.lit("all")).alias("team"), "total", "matched", N.percent(C("matched"), C("total")).alias("coverage"))


@query("""SELECT o_custkey, o_orderkey, CAST(seat AS INTEGER) AS seat FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seat FROM orders WHERE o_orderdate >= DATE '1997-01-01') WHERE seat <= 5""")
def next_five(spark, sf_dir):
    """The next five fixtures of each team from a day on; tasks keep five rows a team before the exchange."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = _t(spark, sf_dir, "orders").where(C("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey", "o_orderdate")
    return rows.withColumn("seat", F.row_number().over(w)).where("seat <= 5").select("o_custkey", "o_orderkey", "seat")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.05)
SELECT p_partkey, CASE WHEN a.k IS NOT NULL THEN 'verified' WHEN b.k IS NOT NULL THEN 'probed' ELSE 'not_found' END AS stage FROM part LEFT JOIN a ON a.k = p_partkey LEFT JOIN b ON b.k = p_partkey""")
def staged_search(spark, sf_dir):
    """Each stage takes on only what the one before left open."""
    part, li = _t(spark, sf_dir, "part", "lineitem")
    first = li.where("l_quantity > 49").select(C("l_partkey").alias("p_partkey"))
    second = li.where("l_discount > 0.05").select(C("l_suppkey").alias("p_partkey"))
    keys = part.select("p_partkey")
    verified = keys.join(first, "p_partkey", "left_semi")
    rest = keys.join(first, "p_partkey", "left_anti")
    stage = lambda df, name: df.withColumn("stage", F.lit(name))
    return stage(verified, "verified").unionByName(stage(rest.join(second, "p_partkey", "left_semi"), "probed")).unionByName(stage(rest.join(second, "p_partkey", "left_anti"), "not_found"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    """Violations of a key that must be unique among some rows."""
    return roster.repeated_keys(_t(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], C("l_returnflag") == "R")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def broken_references(spark, sf_dir):
    orders, customer = _t(spark, sf_dir, "orders", "customer")
    return roster.broken_references(orders.select("o_custkey", "o_orderkey"), "o_custkey", customer.where("c_acctbal > 0"), "c_custkey")


@query("""SELECT DISTINCT CASE WHEN length(a.p_name) >= length(b.p_name) THEN b.p_partkey ELSE a.p_partkey END AS player, CASE WHEN length(a.p_name) >= length(b.p_name) THEN a.p_partkey ELSE b.p_partkey END AS leader
FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey WHERE l_returnflag IN ('N', 'R')""")
def reviewed_merges(spark, sf_dir):
    """Followers and leaders of reviewed pairs."""
    li, part = _t(spark, sf_dir, "lineitem", "part")
    decision = F.when(C("l_returnflag") == "N", "confirmed").when(C("l_returnflag") == "R", " Likely ").otherwise("rejected")
    return roster.reviewed_plan(li.select(C("l_partkey").alias("first"), C("l_suppkey").alias("second"), decision.alias("decision")), part.select(C("p_partkey").alias("player"), C("p_name").alias("name")))


def _roster(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    players = part.where("p_size > 10").select(C("p_brand").alias("team"), C("p_partkey").alias("player"), C("p_name").alias("name"), F.when(C("p_size") % 2 == 0, C("p_name")).alias("canonical"), (C("p_retailprice") > 950).alias("active"))
    return players, part.where("p_size < 20").select(C("p_brand").alias("team"), C("p_name").alias("name"), C("p_type").alias("position"))


PLAN = """WITH players AS (SELECT p_brand AS team, p_partkey AS player, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_name END AS canonical, p_retailprice > 950 AS active FROM part WHERE p_size > 10),
feed AS (SELECT p_brand AS team, p_name AS name, min(p_type) AS position FROM part WHERE p_size < 20 GROUP BY 1, 2),
known AS (SELECT f.team, f.name, f.position, coalesce((SELECT max(player) FROM players p WHERE p.team = f.team AND p.canonical = f.name), (SELECT max(player) FROM players p WHERE p.team = f.team AND p.name = f.name)) AS player FROM feed f),
plan AS (SELECT k.team, CASE WHEN k.player IS NULL THEN 'insert' ELSE 'reactivate' END AS action, k.player, k.name, k.position FROM known k LEFT JOIN players p ON p.player = k.player WHERE k.player IS NULL OR NOT p.active
UNION ALL SELECT p.team, 'deactivate', p.player, p.canonical, NULL FROM players p WHERE p.active AND p.canonical IS NOT NULL AND p.team IN (SELECT team FROM feed) AND NOT EXISTS (SELECT 1 FROM feed f WHERE f.team = p.team AND f.name = p.canonical)) """


@query(PLAN + "SELECT team, action, player, name, position FROM plan")
def roster_plan(spark, sf_dir):
    """What to insert, reactivate and deactivate so that the roster is the feed's."""
    return roster.sync_plan(*_roster(spark, sf_dir))


@query(PLAN + """SELECT p.team, p.player, p.name, CASE WHEN x.action = 'reactivate' THEN x.name ELSE p.canonical END AS canonical, CASE WHEN x.action = 'reactivate' THEN true WHEN x.action = 'deactivate' THEN false ELSE p.active END AS active
FROM players p LEFT JOIN plan x ON x.player = p.player UNION ALL SELECT team, -CAST(('0x' || left(md5(team || '/' || name), 8)) AS BIGINT), name, name, true FROM plan WHERE action = 'insert'""")
def roster_applied(spark, sf_dir):
    """The roster after its plan; new players get a key from their team and name."""
    players, feed = _roster(spark, sf_dir)
    key = -F.conv(F.left(F.md5(F.concat_ws("/", "team", "name").cast("binary")), F.lit(8)), 16, 10).cast("long")
    return roster.apply_plan(players, roster.sync_plan(players, feed), key)


@query("""SELECT player, leader FROM (SELECT p_partkey AS player, first_value(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY length(p_name) DESC, p_partkey) AS leader FROM part) WHERE player <> leader""")
def cluster_leaders(spark, sf_dir):
    """Who leads each cluster of one player's names (names here all have two tokens)."""
    members = _t(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", C("p_size").cast("string")).alias("cluster"), C("p_partkey").alias("player"), C("p_name").alias("name"), C("p_partkey").alias("ord"))
    return roster.choose_leaders(members)


@query("""SELECT event_id, CAST(day(ts) AS VARCHAR) || ' ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sept', 'oct', 'nov', 'dic'][month(ts)] || strftime(ts, ', %H:%M') AS short,
['domingo', 'lunes', 'martes', 'miércoles', 'jueves', 'viernes', 'sábado'][dayofweek(ts) + 1] || ', ' || CAST(day(ts) AS VARCHAR) || ' de ' ||
['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(ts)] || strftime(ts, ', %H:%M') AS long, CAST(floor((900000000 - epoch_us(ts) % 900000000) / 1000) AS BIGINT) AS wait FROM events""")
def event_dates(spark, sf_dir):
    ts = C("ts")
    return _t(spark, sf_dir, "events").select("event_id", L.day_and_time(ts).alias("short"), L.match_date(ts, long=True).alias("long"), L.to_next_quarter(ts).alias("wait"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'hace un momento' WHEN s < 3600 THEN 'hace ' || CAST(s // 60 AS VARCHAR) || ' min' WHEN s < 86400 THEN 'hace ' || CAST(s // 3600 AS VARCHAR) || ' h'
WHEN s < 2592000 THEN 'hace ' || CAST(s // 86400 AS VARCHAR) || ' d' ELSE CAST(day(ts) AS VARCHAR) || '/' || CAST(month(ts) AS VARCHAR) || '/' || CAST(year(ts) AS VARCHAR) END AS age
FROM (SELECT *, CAST(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000 + 0.5) AS BIGINT) AS s FROM events)""")
def event_ages(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "ts")
    return events.select("event_id", L.age(C("ts"), F.lit(events.agg(F.max("ts")).first()[0])).alias("age"))


@query("""SELECT o_orderkey, CASE WHEN w >= 10000 THEN replace(format('{:,}', w), ',', '.') ELSE CAST(w AS VARCHAR) END || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || chr(160) || '€' AS price
FROM (SELECT o_orderkey, c, c // 100 AS w FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders))""")
def euro_prices(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", L.euros(F.floor(C("o_totalprice") * 100 + 0.5)).alias("price"))


LINE = "l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax"


ODDS = f"""WITH d AS ({DEVIG.replace("l_orderkey, l_linenumber", LINE)}) SELECT l_orderkey, o.home, o.draw, o.away, o.bookmaker FROM (SELECT o_orderkey AS l_orderkey FROM orders) LEFT JOIN (
SELECT l_orderkey, arg_min({{'home': home, 'draw': draw, 'away': away, 'bookmaker': l_linestatus}}, (CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 100 END, l_linenumber, l_linestatus, l_quantity, l_discount, l_tax))
FILTER (home IS NOT NULL) AS o FROM d GROUP BY l_orderkey) USING (l_orderkey)"""


@query(ODDS)
def odds_feed(spark, sf_dir):
    """Percentages per match from the preferred bookmaker with valid odds (orders stand for matches, lines for bookmakers)."""
    orders, li = _t(spark, sf_dir, "orders", "lineitem")
    lines = li.select(C("l_orderkey"), C("l_linenumber").alias("place"), C("l_returnflag").alias("key"), C("l_linestatus").alias("title"), (C("l_quantity") / 4.0).cast("double").alias("home"), (3.0 + C("l_discount")).cast("double").alias("draw"), (1.0 + C("l_tax") * 50).cast("double").alias("away"))
    best = best_lines(lines, ["l_orderkey"], ["N", "R"])
    return orders.select(C("o_orderkey").alias("l_orderkey")).join(best, "l_orderkey", "left").select("l_orderkey", "home", "draw", "away", "bookmaker")


@query(ODDS)
def odds_nested(spark, sf_dir):
    """The same from nested payloads, a match with its bookmakers, markets and outcomes in one row."""
    orders, li = _t(spark, sf_dir, "orders", "lineitem")
    price = lambda name, p: F.struct(F.lit(name).alias("name"), p.cast("double").alias("price"))
    outcomes = F.array(price("h", C("l_quantity") / 4.0), price("Draw", 3.0 + C("l_discount")), price("a", 1.0 + C("l_tax") * 50))
    markets = F.array(F.struct(F.lit("h2h").alias("key"), outcomes.alias("outcomes")))
    books = li.groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", C("l_returnflag").alias("key"), C("l_linestatus").alias("title"), markets.alias("markets")))).alias("books"))
    odds = three_way(F.lit("h"), F.lit("a"), F.transform("books", lambda b: F.struct(b["key"], b["title"], b["markets"])), ["N", "R"])
    rows = orders.select("o_orderkey").join(books, "o_orderkey", "left").select(C("o_orderkey").alias("l_orderkey"), odds.alias("o"))
    return rows.select("l_orderkey", "o.home", "o.draw", "o.away", "o.bookmaker")


CARDS = """SELECT l_partkey, 's' || l_suppkey AS slug, CASE WHEN l_linenumber <= 4 THEN 'limited' ELSE 'rare' END AS rarity, l_linestatus = 'O' AS in_season, CAST(floor(l_extendedprice) AS BIGINT) - 5000 AS direct, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"""
CARD_FLOORS = f"""SELECT l_partkey AS p_partkey, min(direct) FILTER (NOT in_season) AS fc, arg_min(slug, (direct, ord)) FILTER (NOT in_season) AS fcs, min(direct) FILTER (in_season) AS fs, arg_min(slug, (direct, ord)) FILTER (in_season) AS fss
FROM ({CARDS}) WHERE rarity = 'limited' AND direct > 0 GROUP BY 1"""


@query(f"""SELECT p_partkey, coalesce(cs, fc, cb) AS classic, CASE WHEN cs IS NOT NULL THEN 'c' WHEN fc IS NOT NULL THEN fcs WHEN cb IS NOT NULL THEN 'c' END AS classic_slug, coalesce(ss, fs, sb) AS in_season, CASE WHEN ss IS NOT NULL THEN 'i' WHEN fs IS NOT NULL THEN fss WHEN sb IS NOT NULL THEN 'i' END AS in_season_slug,
cs IS NULL OR ss IS NULL AS asked FROM (SELECT p_partkey, CAST(CASE WHEN p_size > 30 THEN p_size - 30 WHEN p_size % 3 = 0 THEN p_size END AS BIGINT) AS cs, CAST(p_size AS BIGINT) AS cb,
CAST(CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size > 40 THEN p_size END AS BIGINT) AS ss, CAST(CASE WHEN p_size % 5 > 0 THEN p_size END AS BIGINT) AS sb FROM part) LEFT JOIN ({CARD_FLOORS}) USING (p_partkey)""")
def card_prices(spark, sf_dir):
    """Price and slug per edition: on sale, the market's floor, an auction."""
    part, li = _t(spark, sf_dir, "part", "lineitem")
    cards = li.select(C("l_partkey").alias("p_partkey"), F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("slug"), F.when(C("l_linenumber") <= 4, "limited").otherwise("rare").alias("rarity"), (C("l_linestatus") == "O").alias("in_season"), (F.floor("l_extendedprice") - 5000).alias("direct"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("ord"))
    floors = prices.floors(cards, ["p_partkey"]).select("p_partkey", C("classic").alias("fc"), C("in_season").alias("fs"))
    size = C("p_size")
    card = lambda slug, season, direct, public: F.struct(F.lit(slug).alias("slug"), F.lit("limited").alias("rarity"), season.alias("in_season"), direct.alias("direct"), public.alias("public"), size.alias("auction"))
    classic, season = card("c", F.lit(False), size - 30, F.when(size % 3 == 0, size)), card("i", size % 5 > 0, size - size, F.when(size > 40, size))
    rows = part.select("p_partkey", classic.alias("c"), season.alias("i")).join(floors, "p_partkey", "left")
    a, b = prices.edition(C("c"), C("fc"), False), prices.edition(C("i"), C("fs"), True)
    rows = rows.select("p_partkey", a.alias("a"), b.alias("b"), prices.needs_floor(C("c"), C("i")).alias("asked"))
    return rows.select("p_partkey", C("a.eur_cents").alias("classic"), C("a.slug").alias("classic_slug"), C("b.eur_cents").alias("in_season"), C("b.slug").alias("in_season_slug"), "asked")
