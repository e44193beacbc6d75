"""Queries on keeping a roster: references between names, requests and their answers, back-fills, reviews, reports, orders
for display. Customers stand for players, nations for teams, orders for forecasts, parts for names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bridging, identity, matching, ordered
from .registry import registry, table

QUERIES, SQL, query = registry()
C = F.col


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


CLUB_NAMES = ["Real Madrid CF", "Club Atlético de Madrid", "RCD Espanyol", "FC Barcelona", "Athletic Club", "Real Club Celta", "Unknown United", "RC Deportivo La Coruña"]
CLUB_LIST = ", ".join(f"'{x}'" for x in CLUB_NAMES)
PLAIN = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT n_nationkey, club, CASE WHEN contains(p, 'athletic bilbao') OR contains(p, 'athletic') THEN 'athletic-bilbao' WHEN contains(p, 'atletico madrid') OR contains(p, 'atletico de madrid') THEN 'atletico-madrid'
WHEN contains(p, 'barcelona') THEN 'barcelona' WHEN contains(p, 'celta vigo') OR contains(p, 'real club celta') THEN 'celta-vigo' WHEN contains(p, 'deportivo la coruna') THEN 'deportivo'
WHEN contains(p, 'espanyol') THEN 'espanyol' WHEN contains(p, 'real madrid') THEN 'real-madrid' END AS key
FROM (SELECT n_nationkey, club, {PLAIN.format('club')} AS p FROM (SELECT n_nationkey, [{CLUB_LIST}][n_nationkey % {len(CLUB_NAMES)} + 1] AS club FROM nation))""")
def club_keys(spark, sf_dir):
    """Club names to the club's key."""
    club = F.element_at(F.array(*map(F.lit, CLUB_NAMES)), (C("n_nationkey") % len(CLUB_NAMES) + 1).cast("int"))
    return _t(spark, sf_dir, "nation")[0].select("n_nationkey", club.alias("club"), identity.club_key(club).alias("key"))


KNOWN_AS = ["Mbappé", "V. Jr", "Lookman", "Pedri", "Nobody Known", "P. E. Aubameyang"]
OTHERS = ["mbappe!", "Vinicius", "A. Lookman", "Gavi", "Somebody Else", "Pierre Emerick"]


def _sql(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "][n_nationkey % 6 + 1]"


@query(f"""SELECT n_nationkey, {_sql(KNOWN_AS)} AS raw, {_sql(['Kylian Mbappé', 'Vinícius Júnior', 'Ademola Lookman', 'Pedro González', 'Nobody Known', 'Pierre-Emerick Aubameyang'])} AS name,
n_nationkey % 6 NOT IN (3, 4) AS alias FROM nation""")
def canonical_names(spark, sf_dir):
    """Names known by another to the full name, and whether two names are one player's."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (C("n_nationkey") % 6 + 1).cast("int"))
    raw = pick(KNOWN_AS)
    return _t(spark, sf_dir, "nation")[0].select("n_nationkey", raw.alias("raw"), T.canonical_name(raw).alias("name"), T.is_canonical_alias(raw, pick(OTHERS)).alias("alias"))


LONG = "{0} || ' de ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' Jr' ELSE '' END"
SET = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t NOT IN ('', 'de', 'la', 'el', 'real', 'club', 'ca', 'ud', 'fc', 'cf', 'rcd', 'jr', 'junior', 'sr', 'senior', 'ii', 'iii', 'iv')))"


def _score(a: str, b: str) -> str:
    common = f"2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"
    near = f"2.0::DOUBLE * len(list_filter({a}, lambda s: len(list_filter({b}, lambda t: starts_with(s, t) OR starts_with(t, s))) > 0)) / (len({a}) + len({b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE greatest({common}, {near}) END"


@query(f"""WITH n AS (SELECT c_custkey, {PLAIN.format(LONG.format('p_name'))} AS own, {PLAIN.format("split_part(p_name, ' ', 2) || ' ' || c_mktsegment")} AS display, {PLAIN.format("p_name || ' ' || c_mktsegment")} AS full_name
FROM customer JOIN part ON p_partkey = c_custkey), s AS (SELECT *, {SET.format('own')} AS x, {SET.format('display')} AS y, {SET.format('full_name')} AS z FROM n)
SELECT c_custkey, CAST(floor(1000 * CASE WHEN own = display OR own = full_name THEN 1.0::DOUBLE ELSE greatest({_score('x', 'y')}, {_score('x', 'z')}) END + 0.5) AS BIGINT) AS score FROM s""")
def name_scores(spark, sf_dir):
    """Names of three to five tokens, with particles and suffixes, against a display name and a full name (per mille)."""
    customer, part = _t(spark, sf_dir, "customer", "part")
    rows = customer.join(part, C("p_partkey") == C("c_custkey"))
    own = F.concat("p_name", F.lit(" de "), "c_mktsegment", F.when(C("c_custkey") % 3 == 0, " Jr").otherwise(""))
    display = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), "c_mktsegment")
    scored = identity.with_name_score(rows.select("c_custkey", "p_name", "c_mktsegment"), own, display, F.concat_ws(" ", "p_name", "c_mktsegment"))
    return scored.select("c_custkey", F.floor(1000 * C("name_score") + 0.5).alias("score"))


@query("""WITH r AS (SELECT p_brand, p_size, list(lower(p_name)) AS names FROM part GROUP BY ALL)
SELECT p_partkey, len(list_filter(names, lambda n: list_contains(string_split(n, ' '), lower(string_split(p_name, ' ')[2])))) <= 1 AS unique_reference FROM part JOIN r USING (p_brand, p_size)""")
def unique_references(spark, sf_dir):
    """Whether a last name alone means one player of its squad (brand and size)."""
    part = _t(spark, sf_dir, "part")[0].select(F.concat_ws("/", "p_brand", C("p_size").cast("string")).alias("team"), "p_partkey", C("p_name").alias("name"))
    asked = part.withColumn("short", F.element_at(F.split("name", " "), -1))
    return matching.unique_references(asked, part).select("p_partkey", "unique_reference")


@query("""SELECT c_custkey, name, regexp_matches(name, '(^|\\s)[A-Za-z]\\.(\\s|$)') OR regexp_matches(name, '(?i)\\b(jr|junior|ii|iii|iv)\\b') AS abbreviated,
CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN regexp_matches(name, '(^|\\s)[A-Za-z]\\.(\\s|$)') OR regexp_matches(name, '(?i)\\b(jr|junior|ii|iii|iv)\\b') THEN 0 ELSE 1 END, c_custkey) AS INTEGER) AS turn
FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'J. ' || c_mktsegment WHEN 1 THEN c_mktsegment || ' Jr' ELSE c_mktsegment || ' Surname' END AS name FROM customer)""")
def abbreviated_first(spark, sf_dir):
    """Requests of a team, abbreviated names first."""
    name = F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("J. "), "c_mktsegment")).when(C("c_custkey") % 3 == 1, F.concat("c_mktsegment", F.lit(" Jr"))).otherwise(F.concat("c_mktsegment", F.lit(" Surname")))
    rows = _t(spark, sf_dir, "customer")[0].select("c_custkey", "c_nationkey", name.alias("name")).withColumn("abbreviated", T.is_abbreviated(C("name")))
    return ordered.placed(rows, ["c_nationkey"], [F.desc("abbreviated"), F.asc("c_custkey")], "turn").select("c_custkey", "name", "abbreviated", "turn")


@query("""SELECT o_custkey, 's' || arg_max(o_orderkey, o_orderkey) AS slug FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderkey % 7 <> 0 GROUP BY o_custkey""")
def verified_slugs(spark, sf_dir):
    """The slug of a player's last matched and verified row that has one."""
    rows = _t(spark, sf_dir, "orders")[0].withColumn("slug", F.when(C("o_orderkey") % 7 != 0, F.concat(F.lit("s"), C("o_orderkey").cast("string"))))
    stored = rows.select(C("o_custkey").alias("local_id"), "slug", F.when(C("o_orderstatus") == "F", "matched").alias("status"), (C("o_totalprice") > 1000).alias("verified"), C("o_orderkey").alias("updated"))
    return bridging.verified(stored).withColumnRenamed("local_id", "o_custkey")


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, ''), 'Desconocido') AS name, coalesce(n_name, 'Fuente') AS source FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey""")
def placeholders(spark, sf_dir):
    """Fixed words where a name or a source is missing."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    rows = customer.join(nation.where("n_nationkey % 2 = 0"), C("n_nationkey") == C("c_nationkey"), "left")
    name = F.when(C("c_custkey") % 4 == 0, "").otherwise(C("c_name"))
    return rows.select("c_custkey", F.coalesce(F.nullif(name, F.lit("")), F.lit("Desconocido")).alias("name"), F.coalesce("n_name", F.lit("Fuente")).alias("source"))


@query("""SELECT n_nationkey, count(c_custkey) FILTER (c_acctbal < 0) > 0 OR count(c_custkey) FILTER (c_acctbal > 9000) > 0 AS any_news, CAST(count(c_custkey) FILTER (c_acctbal < 0) AS INTEGER) AS injured
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def any_group(spark, sf_dir):
    """Whether a team has anything in any of its groups; a group without rows counts nothing."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    groups = customer.groupBy("c_nationkey").agg(F.count_if(C("c_acctbal") < 0).alias("injured"), F.count_if(C("c_acctbal") > 9000).alias("praised"))
    rows = nation.join(groups, C("c_nationkey") == C("n_nationkey"), "left")
    n = lambda k: F.coalesce(C(k), F.lit(0))
    return rows.select("n_nationkey", ((n("injured") > 0) | (n("praised") > 0)).alias("any_news"), n("injured").cast("int").alias("injured"))


@query("""SELECT CASE WHEN c_acctbal < 0 THEN 'unmatched' WHEN c_acctbal < 5000 THEN 'review' ELSE 'matched' END AS status, count(*) AS players FROM customer GROUP BY 1""")
def status_counts(spark, sf_dir):
    """Players by a status that is derived from their rows."""
    status = F.when(C("c_acctbal") < 0, "unmatched").when(C("c_acctbal") < 5000, "review").otherwise("matched")
    return _t(spark, sf_dir, "customer")[0].groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("players"))


@query("""SELECT n_name, n, CAST(row_number() OVER (ORDER BY n DESC, n_name) AS INTEGER) AS place FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0 GROUP BY n_name)""")
def unmatched_by_team(spark, sf_dir):
    """Unmatched players per team, the most first (one row per team is ranked)."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    counts = customer.where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(nation), C("c_nationkey") == C("n_nationkey"))
    return counts.select("n_name", "n", F.row_number().over(Window.orderBy(F.desc("n"), "n_name")).alias("place"))


@query("""SELECT count(*) FILTER (a = 'insert') AS inserts, count(*) FILTER (a = 'update') AS updates, count(*) FILTER (a = 'keep') AS kept, count(*) AS total
FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'keep' END AS a FROM customer)""")
def plan_totals(spark, sf_dir):
    """What a plan would do, in all."""
    plan = _t(spark, sf_dir, "customer")[0].select(F.when(C("c_custkey") % 5 == 0, "insert").when(C("c_custkey") % 5 == 1, "update").otherwise("keep").alias("a"))
    return plan.agg(*(F.count_if(C("a") == a).alias(name) for a, name in (("insert", "inserts"), ("update", "updates"), ("keep", "kept"))), F.count(F.lit(1)).alias("total"))


LINES = ["DEL", "MED", "DEF", "POR"]


@query("""SELECT c_nationkey, string_agg(line || ':' || n, ' ' ORDER BY o) AS lines FROM (SELECT c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'DEL' WHEN 'AUTOMOBILE' THEN 'MED' WHEN 'MACHINERY' THEN 'DEF' ELSE 'POR' END AS line,
CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS o, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey""")
def lines_by_position(spark, sf_dir):
    """A squad by line, forwards first; empty lines are left out."""
    line = F.when(C("c_mktsegment") == "BUILDING", "DEL").when(C("c_mktsegment") == "AUTOMOBILE", "MED").when(C("c_mktsegment") == "MACHINERY", "DEF").otherwise("POR")
    counts = _t(spark, sf_dir, "customer")[0].groupBy("c_nationkey", line.alias("line")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, LINES)), C("line")).alias("o"), F.concat_ws(":", "line", C("n").cast("string")).alias("x"))))
    return counts.groupBy("c_nationkey").agg(F.array_join(entries["x"], " ").alias("lines"))


@query("""SELECT year(o_orderdate) AS season, CAST(month(o_orderdate) AS INTEGER) AS round, count(*) AS matches, min(o_orderkey) AS first FROM orders GROUP BY ALL""")
def matches_per_round(spark, sf_dir):
    """The rounds there are, with their matches."""
    return _t(spark, sf_dir, "orders")[0].groupBy(F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").alias("round")).agg(F.count(F.lit(1)).alias("matches"), F.min("o_orderkey").alias("first"))


@query("""SELECT n_name AS team, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_acctbal DESC, c_custkey), '') AS players FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9500) ON c_nationkey = n_nationkey GROUP BY n_name""")
def players_by_team(spark, sf_dir):
    """A list of players per team, the most likely first."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    lists = customer.where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct((-C("c_acctbal")).alias("p"), "c_custkey")))["c_custkey"].alias("x"))
    rows = nation.join(lists, C("c_nationkey") == C("n_nationkey"), "left")
    return rows.select(C("n_name").alias("team"), F.coalesce(F.array_join(C("x").cast("array<string>"), ","), F.lit("")).alias("players"))


@query("SELECT count(*) AS players, CAST(sum(c_custkey % 100) AS BIGINT) AS total FROM customer")
def grand_total(spark, sf_dir):
    return _t(spark, sf_dir, "customer")[0].agg(F.count(F.lit(1)).alias("players"), F.sum(C("c_custkey") % 100).alias("total"))


@query("""SELECT l_suppkey, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_seen FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_suppkey""")
def last_hit_per_slug(spark, sf_dir):
    """Candidates of all searches, one per slug: the one found last."""
    hits = _t(spark, sf_dir, "lineitem")[0].where("l_linenumber <= 3")
    return bridging.last_hits(hits, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", C("l_orderkey").alias("last_seen"))


@query("""WITH d AS (SELECT DISTINCT trim(c_mktsegment || '-' || c_nationkey) AS slug FROM customer WHERE c_custkey % 9 <> 0)
SELECT slug, (row_number() OVER (ORDER BY slug) - 1) // 20 AS batch FROM d""")
def request_batches(spark, sf_dir):
    """Requested slugs trimmed, without blanks and repeats, in batches of 20."""
    padded = F.when(C("c_custkey") % 9 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit("-"), C("c_nationkey").cast("string"), F.lit(" "))).otherwise("  ")
    slugs = _t(spark, sf_dir, "customer")[0].select(F.trim(padded).alias("slug")).where("slug != ''").distinct()
    return ordered.batches(slugs, ["slug"], 20)


@query("""SELECT s_suppkey, CAST(count(l_orderkey) AS INTEGER) AS hits FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def searches_with_hits(spark, sf_dir):
    """Every search with the number of its hits; one that found nothing has none."""
    supplier, lineitem = _t(spark, sf_dir, "supplier", "lineitem")
    hits = lineitem.where("l_quantity > 49").select(C("l_suppkey").alias("s_suppkey"))
    return bridging.answered(supplier, hits, "s_suppkey").select("s_suppkey", C("hits").cast("int").alias("hits"))


@query("""WITH v AS (SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, 1 AS o FROM part UNION ALL SELECT p_partkey, lower(string_split(p_name, ' ')[1]), 2 FROM part UNION ALL SELECT p_partkey, lower(string_split(p_name, ' ')[2]), 3 FROM part),
k AS (SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS slug FROM part WHERE p_partkey % 2 = 0 UNION SELECT DISTINCT lower(string_split(p_name, ' ')[1]) FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, string_agg(slug, ',' ORDER BY o) AS found FROM (SELECT p_partkey, slug, min(o) AS o FROM v WHERE length(slug) >= 3 GROUP BY 1, 2) JOIN k USING (slug) GROUP BY p_partkey""")
def probed_slugs(spark, sf_dir):
    """Slugs generated from names, joined to the answers that exist, back to a list per player in the order of probing."""
    part = _t(spark, sf_dir, "part")[0]
    asked = part.select("p_partkey", F.posexplode(T.slug_variants(C("p_name"))).alias("o", "slug"))
    first = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    answers = part.where("p_partkey % 2 = 0").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug")).unionByName(part.where("p_partkey % 3 = 0").select(first.alias("slug"))).distinct()
    found = asked.join(answers, "slug").groupBy("p_partkey").agg(F.sort_array(F.collect_list(F.struct("o", "slug")))["slug"].alias("x"))
    return found.select("p_partkey", F.array_join("x", ",").alias("found"))


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_acctbal > 9000""")
def club_unresolved(spark, sf_dir):
    """Candidates of the same club for players who aren't resolved yet."""
    customer, supplier, orders = _t(spark, sf_dir, "customer", "supplier", "orders")
    players = customer.where("c_acctbal > 9000").select(C("c_custkey").alias("local_id"), C("c_nationkey").alias("club"))
    resolved = orders.where("o_totalprice > 400000").select(C("o_custkey").alias("local_id"))
    out = bridging.unresolved(players, resolved, supplier.select("s_suppkey", C("s_nationkey").alias("club")))
    return out.select(C("local_id").alias("c_custkey"), "s_suppkey")


@query("""SELECT c_custkey, coalesce(slug, 'p' || c_custkey) AS slug, coalesce(slug, 'p' || c_custkey) AS external FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS slug FROM customer)""")
def backfilled_ids(spark, sf_dir):
    """Rows for players without one (on conflict the row there stays), then an empty external slug from the slug."""
    customer = _t(spark, sf_dir, "customer")[0].select(C("c_custkey").alias("local_id"))
    slug = lambda mark: F.concat(F.lit(mark), C("local_id").cast("string")).alias("slug")
    there = customer.where("local_id % 3 = 0").select("local_id", slug("s"), F.lit(None).cast("string").alias("external"))
    return bridging.backfilled(there, customer.select("local_id", slug("p"))).withColumnRenamed("local_id", "c_custkey")


@query("""SELECT o_orderkey, coalesce(c_name, '') AS name, coalesce(c_mktsegment, '') AS segment, coalesce(n_name, '') AS team FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def enriched_rows(spark, sf_dir):
    """Report rows with the cells of their player, blank where none is known."""
    orders, customer, nation = _t(spark, sf_dir, "orders", "customer", "nation")
    known = customer.where("c_custkey % 2 = 0").join(nation, C("n_nationkey") == C("c_nationkey"), "left").select(C("c_custkey").alias("o_custkey"), C("c_name").alias("name"), C("c_mktsegment").alias("segment"), C("n_name").alias("team"))
    blank = F.lit("")
    rows = orders.select("o_orderkey", "o_custkey", blank.alias("name"), blank.alias("segment"), blank.alias("team"))
    out = bridging.enriched(rows, known, "o_custkey", ["name", "segment", "team"])
    return out.select("o_orderkey", *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "segment", "team")))


@query("""SELECT c_custkey, lower(c_mktsegment) || '-' || c_custkey AS slug FROM customer WHERE c_custkey % 4 = 1""")
def manual_slugs(spark, sf_dir):
    """Slugs that a reviewer wrote: only well-formed ones, and no words for passing over."""
    key = C("c_custkey").cast("string")
    written = F.when(C("c_custkey") % 4 == 0, "skip").when(C("c_custkey") % 4 == 1, F.concat(F.lower("c_mktsegment"), F.lit("-"), key)).when(C("c_custkey") % 4 == 2, F.concat(F.lit("Not A Slug "), key)).otherwise("")
    return bridging.reviewed_slugs(_t(spark, sf_dir, "customer")[0].select("c_custkey", written.alias("slug")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'matched' WHEN c_acctbal < 0 THEN 'not_found' ELSE 'manual_review' END AS status FROM customer""")
def accepted_reviews(spark, sf_dir):
    """Reviews that say accept set the status; all others change nothing."""
    customer = _t(spark, sf_dir, "customer")[0].withColumn("local_id", C("c_custkey"))
    none, slug, yes = F.lit(None).cast("string"), F.concat(F.lit("s-"), C("c_custkey").cast("string")), F.lit("yes")
    stored = customer.select("local_id", none.alias("slug"), none.alias("born"), F.when(C("c_acctbal") < 0, "not_found").otherwise("manual_review").alias("status"))
    says = F.when(C("c_custkey") % 3 == 0, " Accept ").otherwise("reject")
    reviews = customer.where("c_custkey % 2 = 0").select("local_id", slug.alias("slug"), says.alias("decision"), yes.alias("exists"), yes.alias("club"), none.alias("born"))
    return bridging.accepted(stored, reviews).select(C("local_id").alias("c_custkey"), "status")


@query("""SELECT k, CASE WHEN max(p) = 1 THEN 'second' ELSE 'first' END AS origin FROM (SELECT c_custkey AS k, 0 AS p FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY k""")
def later_wins(spark, sf_dir):
    """The union of two keyed tables; of a key in both the later row stays."""
    customer = _t(spark, sf_dir, "customer")[0]
    first = customer.where("c_custkey % 2 = 0").select(C("c_custkey").alias("k"), F.lit(0).alias("p"), F.lit("first").alias("origin"))
    second = customer.where("c_custkey % 3 = 0").select(C("c_custkey").alias("k"), F.lit(1).alias("p"), F.lit("second").alias("origin"))
    return first.unionByName(second).groupBy("k").agg(F.max_by("origin", "p").alias("origin"))


@query("""SELECT n_nationkey, list_sort(list_distinct(coalesce(a, []))) = list_sort(list_distinct(coalesce(b, []))) AS same FROM nation LEFT JOIN (SELECT c_nationkey, list(c_mktsegment) AS a FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, list(c_mktsegment) AS b FROM customer WHERE c_acctbal > 5000 GROUP BY 1) ON k = n_nationkey""")
def same_sets(spark, sf_dir):
    """Whether two lists of a team hold the same things."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    a = customer.groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("a"))
    b = customer.where("c_acctbal > 5000").groupBy(C("c_nationkey").alias("k")).agg(F.sort_array(F.collect_set("c_mktsegment")).alias("b"))
    rows = nation.join(a, C("c_nationkey") == C("n_nationkey"), "left").join(b, C("k") == C("n_nationkey"), "left")
    none = F.array().cast("array<string>")
    return rows.select("n_nationkey", (F.coalesce("a", none) == F.coalesce("b", none)).alias("same"))


@query("""SELECT l_partkey, l_suppkey, CAST(seat AS INTEGER) AS seat FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS seat
FROM (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE seat <= 8""")
def first_eight(spark, sf_dir):
    """The first eight candidates of each player, the best first; tasks keep eight before the exchange."""
    best = _t(spark, sf_dir, "lineitem")[0].groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    seat = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("q"), "l_suppkey"))
    return best.withColumn("seat", seat).where("seat <= 8").select("l_partkey", "l_suppkey", "seat")


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_custkey % 3 END DESC, c_custkey % 2 DESC, name COLLATE NOACCENT, c_custkey) AS INTEGER) AS place
FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'Álvaro' WHEN 1 THEN 'Ángel' ELSE 'Zoé' END AS name FROM customer)""")
def display_order(spark, sf_dir):
    """Players of a team by probability (null: -1), sources (null: 0), and name as Spanish sorts it."""
    rows = _t(spark, sf_dir, "customer")[0].select("c_custkey", "c_nationkey", F.when(C("c_custkey") % 5 != 0, C("c_custkey") % 3).alias("probability"), F.when(C("c_custkey") % 2 == 1, 1).alias("sources"), F.element_at(F.array(F.lit("Álvaro"), F.lit("Ángel"), F.lit("Zoé")), (C("c_custkey") % 3 + 1).cast("int")).alias("name"))
    order = [F.desc(F.coalesce("probability", F.lit(-1))), F.desc(F.coalesce("sources", F.lit(0))), F.asc(F.collate("name", "es")), F.asc("c_custkey")]
    return ordered.placed(rows, ["c_nationkey"], order).select("c_custkey", "place")


@query("""SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS place FROM nation""")
def teams_in_spanish(spark, sf_dir):
    """Teams by name as Spanish sorts it (one row per team)."""
    return _t(spark, sf_dir, "nation")[0].select("n_nationkey", F.row_number().over(Window.orderBy(F.collate("n_name", "es"), "n_nationkey")).alias("place"))


@query("""SELECT n_nationkey, n_name AS team, coalesce(round(avg(c_acctbal), 2), NULL) IS NULL AS unknown, count(c_custkey) AS players FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 4 <> 0) ON c_nationkey = n_nationkey GROUP BY ALL""")
def team_always_written(spark, sf_dir):
    """A row for every team, with nulls where no fresh source covers it."""
    customer, nation = _t(spark, sf_dir, "customer", "nation")
    fresh = customer.where("c_nationkey % 4 != 0").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).alias("n"))
    rows = nation.join(fresh, C("c_nationkey") == C("n_nationkey"), "left")
    return rows.select("n_nationkey", C("n_name").alias("team"), C("mean").isNull().alias("unknown"), F.coalesce("n", F.lit(0).cast("long")).alias("players"))
