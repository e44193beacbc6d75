"""Queries on the external catalogue and on what pages show: identities from evidence, the bridge, caches by groups of columns,
teams and rounds as nested rows. Parts stand for local players, suppliers for candidates, customers for squads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import bridging, caching, identity, ordered, readmodels
from ..operators import consensus as CO
from ..operators import state as S
from ..sinks.shared import written
from ..sources import adapters
from .registry import registry, table

QUERIES, SQL, query = registry()
C = F.col
NOW = "TIMESTAMP '2024-06-01 12:00:00'"
#: Clubs as local rows name them, and as the catalogue does.
LOCAL, REMOTE = ["Alavés", "Athletic Club", "Barcelona", "Betis", "Real Madrid"], ["Deportivo Alavés", "Athletic", "FC Barcelona", "Real Betis", "Real Madrid CF"]


def _now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")


def _name(names, at):
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def _people(spark, sf_dir):
    """local players, and candidates for them: some of the same name, club, birth date or nation."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    born = F.date_add(F.lit("1990-01-01").cast("date"), C("p_partkey").cast("int"))
    local = part.select(C("p_partkey").alias("local_id"), C("p_name").alias("name"), _name(LOCAL, C("p_size") % 5).alias("team"), F.when(C("p_partkey") % 10 != 0, born).cast("string").alias("born"), F.lit("España").alias("nationality"))
    s, words = C("l_suppkey"), F.split("p_name", " ")
    display = F.when(s % 3 == 0, C("p_name")).when(s % 3 == 1, F.concat(words[0], F.lit(" zz"), s.cast("string"))).otherwise(F.concat_ws(" ", words[1], words[0]))
    rows = item.join(part, "p_partkey")
    none = F.lit(None).cast("string")
    found = rows.select(
        C("p_partkey").alias("local_id"), F.concat(F.lit("s"), s.cast("string")).alias("slug"), display.alias("display"), none.alias("first"), none.alias("last"),
        F.when(s % 2 == 0, _name(REMOTE, C("p_size") % 5)).otherwise("Unknown United").alias("club"), none.alias("club_slug"),
        F.concat(F.when(s % 4 == 0, born).otherwise(F.date_add(born, 1)).cast("string"), F.lit("T00:00")).alias("born"), F.when(s % 5 == 0, "espana").otherwise("br").alias("nationality"), s.alias("supp"),
    )
    return local, found


DICE = "2.0::DOUBLE * len(list_intersect(list_distinct({x}), list_distinct({y}))) / (len(list_distinct({x})) + len(list_distinct({y})))"
PREFIX = "2.0::DOUBLE * len(list_filter(list_distinct({x}), lambda s: len(list_filter({y}, lambda t: starts_with(s, t) OR starts_with(t, s))) > 0)) / (len(list_distinct({x})) + len(list_distinct({y})))"
PEOPLE = f"""WITH c AS (SELECT DISTINCT p_partkey AS local_id, l_suppkey AS s, 's' || l_suppkey AS slug, p_name, string_split(p_name, ' ') AS x, p_partkey % 10 = 0 AS no_dob FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, CASE WHEN s % 3 = 0 THEN p_name WHEN s % 3 = 1 THEN x[1] || ' zz' || s ELSE x[2] || ' ' || x[1] END AS display FROM c),
e AS (SELECT *, s % 2 = 0 AS team, s % 4 = 0 AND NOT no_dob AS dob, s % 5 = 0 AS nat, CASE WHEN display = p_name THEN 1.0::DOUBLE ELSE greatest({DICE.format(x="x", y="string_split(display, ' ')")}, {PREFIX.format(x="x", y="string_split(display, ' ')")}) END AS name_score FROM n),
s AS (SELECT *, least(1.0::DOUBLE, 0.55::DOUBLE * least(name_score, 1.0) + 0.25::DOUBLE * team::INT + 0.25::DOUBLE * dob::INT + 0.05::DOUBLE * nat::INT) AS confidence FROM e),
r AS (SELECT *, row_number() OVER w AS rn, lead(confidence) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY local_id ORDER BY confidence DESC, name_score DESC, slug)),
m AS (SELECT *, confidence - coalesce(nxt, 0) AS margin FROM r WHERE rn = 1),
d AS (SELECT *, ((dob AND name_score >= 0.45) OR (team AND name_score >= 1 AND (dob OR no_dob)) OR (team AND name_score >= 0.72 AND margin >= 0.15::DOUBLE)) AND margin >= 0.08::DOUBLE AS fine FROM m),
found AS (SELECT p_partkey AS local_id, d.slug, CAST(floor(confidence * 1000 + 0.5) AS BIGINT) AS confidence, CASE WHEN d.slug IS NULL THEN 'not_found' WHEN fine THEN 'matched' ELSE 'manual_review' END AS status,
CASE WHEN d.slug IS NULL THEN 'none' WHEN NOT fine THEN 'review_required' WHEN dob AND team THEN 'name_club_birth_day' WHEN dob THEN 'name_birth_day' WHEN name_score >= 1 THEN 'exact_name_club' ELSE 'name_club_unique_margin' END AS method,
CASE WHEN d.slug IS NULL THEN 'no_candidates' WHEN fine THEN 'enough_evidence' WHEN NOT team THEN 'club_differs_or_unknown' WHEN margin < 0.08::DOUBLE THEN 'ambiguous_candidates' ELSE 'weak_identity' END AS reason FROM part LEFT JOIN d ON local_id = p_partkey)"""


@query(PEOPLE + " SELECT * FROM found")
def identity_evidence(spark, sf_dir):
    """Decisions on names, clubs, birth dates and nations, with what a match rests on."""
    return identity.decisions(*_people(spark, sf_dir))


@query(PEOPLE + """, held AS (SELECT s_suppkey AS local_id, 's' || s_suppkey AS slug FROM supplier WHERE s_suppkey % 6 = 0),
b AS (SELECT found.*, CASE WHEN status = 'matched' AND (EXISTS (SELECT 1 FROM held h WHERE h.slug = found.slug AND h.local_id <> found.local_id) OR row_number() OVER (PARTITION BY found.slug, status ORDER BY local_id) > 1) THEN 'manual_review' ELSE status END AS after FROM found),
top AS (SELECT local_id, string_agg(slug, ',' ORDER BY confidence DESC, slug) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY local_id ORDER BY confidence DESC, slug) AS place FROM s) WHERE place <= 8 GROUP BY local_id)
SELECT b.local_id, b.slug, CASE WHEN after = 'matched' THEN 'x' || b.slug END AS external_id, after AS status, CASE WHEN status <> after THEN 'review_required' ELSE method END AS method, CASE WHEN status <> after THEN 'slug_ya_asignado_a_otro_jugador' ELSE reason END AS reason,
after = 'matched' AS verified, CASE WHEN after = 'matched' THEN """ + NOW + """ + INTERVAL 7 DAY END AS expires, coalesce(candidates, '') AS candidates FROM b LEFT JOIN top USING (local_id)""")
def bridge_rows(spark, sf_dir):
    """Rows of the bridge from decisions: a slug that is somebody's goes to review; eight candidates are kept."""
    local, found = _people(spark, sf_dir)
    seen = written(identity.evidence(local, found))
    made = identity.decided(seen).withColumns({"external_id": F.concat(F.lit("x"), "slug"), "name": F.lit(None).cast("string")})
    held = table(spark, sf_dir, "supplier").where("s_suppkey % 6 = 0").select(C("s_suppkey").alias("local_id"), F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("slug"))
    out = bridging.bridge_rows(made, seen.select("local_id", "slug", identity.points(seen).alias("confidence")), held, _now())
    return out.select("local_id", "slug", "external_id", "status", "method", "reason", "verified", "expires", F.array_join(F.transform("candidates", lambda c: c["slug"]), ",").alias("candidates"))


@query("""WITH g AS (SELECT DISTINCT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS place FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_partkey % 20 = l_suppkey % 20)
SELECT DISTINCT l_partkey AS local_id, 's' || min(l_suppkey) OVER (PARTITION BY l_partkey) AS slug FROM g WHERE place = 1 AND l_partkey % 3 <> 0""")
def first_guesses(spark, sf_dir):
    """Players dealt to candidates that guess one player each: who is guessed by several goes to the first."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().where("l_partkey % 20 = l_suppkey % 20")
    first = pairs.groupBy("l_suppkey").agg(F.min("l_partkey").alias("local_id"))
    guesses = first.select(F.concat(F.lit("s"), C("l_suppkey").cast("string")).alias("slug"), C("l_suppkey").alias("turn"), "local_id", F.lit(1).alias("place"))
    resolved = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(C("p_partkey").alias("local_id"))
    return bridging.dealt(guesses, resolved).select("local_id", "slug")


@query("""WITH w AS (SELECT c_custkey, lower(c_mktsegment) || '-' || c_custkey AS slug FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey AS local_id, slug FROM w""")
def slugs_by_hand(spark, sf_dir):
    """Slugs set by hand for players named by id or by name."""
    customer = table(spark, sf_dir, "customer")
    players = customer.select(C("c_custkey").alias("local_id"), C("c_custkey").alias("ord"), C("c_name").alias("name"))
    ref = F.when(C("c_custkey") % 2 == 0, C("c_custkey").cast("string")).otherwise(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")))
    wanted = customer.where("c_custkey % 3 = 0").select(C("c_custkey").alias("ord"), ref.alias("ref"), F.concat(F.lower("c_mktsegment"), F.lit("-"), C("c_custkey").cast("string")).alias("slug"))
    blank = wanted.withColumns({"ord": C("ord") + 10_000_000, "slug": F.lit(" ")})
    return bridging.set_by_hand(players, wanted.unionByName(blank))


CACHE = f"""WITH cache AS (SELECT 's' || p_partkey AS slug, p_name AS display_name, p_size AS average_score, p_size * 10 AS classic_price, p_size * 20 AS in_season_price, {NOW} + to_hours(p_size % 3 - 1) AS scores_expires,
CASE WHEN p_size % 11 <> 0 THEN {NOW} + to_hours(p_size % 5 - 2) END AS classic_expires, {NOW} + to_hours(1 - p_size % 4) AS in_season_expires, {NOW} - INTERVAL 1 DAY AS updated FROM part WHERE p_partkey % 3 <> 0),
fetched AS (SELECT 's' || p_partkey AS slug, 'n ' || p_name AS display_name, p_size + 100 AS average_score, p_size * 10 + 1 AS classic_price, CASE WHEN p_size % 2 = 0 THEN p_size * 20 + 1 END AS in_season_price FROM part WHERE p_partkey % 2 = 0),
plan AS (SELECT f.slug, NOT coalesce(c.scores_expires > {NOW}, false) AS scores, NOT coalesce(c.classic_expires > {NOW}, false) AS classic, NOT coalesce(c.in_season_expires > {NOW}, false) AS in_season FROM fetched f LEFT JOIN cache c USING (slug))"""


def _cache(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size, key = C("p_size").cast("long"), C("p_partkey").cast("string")
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    after = lambda hours: _now() + F.make_dt_interval(hours=hours.cast("int"))
    about = [none(c) for c in caching.ABOUT if c != "display_name"]
    cache = part.where("p_partkey % 3 != 0").select(
        F.concat(F.lit("s"), key).alias("slug"), C("p_name").alias("display_name"), *about, F.array(size.cast("double")).alias("scores"), size.alias("average_score"), size.alias("latest_score"),
        (size * 10).alias("classic_price"), none("classic_card"), (size * 20).alias("in_season_price"), none("in_season_card"), *((_now() - F.expr("interval 1 day")).alias(f"{g}_updated") for g in caching.GROUPS),
        after(size % 3 - 1).alias("scores_expires"), F.when(size % 11 != 0, after(size % 5 - 2)).alias("classic_expires"), after(1 - size % 4).alias("in_season_expires"), (_now() - F.expr("interval 1 day")).alias("updated"),
    )
    fetched = part.where("p_partkey % 2 = 0").select(
        F.concat(F.lit("s"), key).alias("slug"), F.concat(F.lit("n "), "p_name").alias("display_name"), *about, F.array((size + 100).cast("double")).alias("scores"), (size + 100).alias("average_score"), (size + 100).alias("latest_score"),
        (size * 10 + 1).alias("classic_price"), none("classic_card"), F.when(size % 2 == 0, size * 20 + 1).alias("in_season_price"), none("in_season_card"),
    )
    return cache, fetched


@query(CACHE + " SELECT * FROM plan")
def cache_plan(spark, sf_dir):
    """Which groups of each wanted slug must be fetched."""
    cache, fetched = _cache(spark, sf_dir)
    return caching.plan(fetched, cache, _now())


SHOWN = ["slug", "display_name", "average_score", "classic_price", "in_season_price", "scores_expires", "classic_expires", "in_season_expires", "updated"]


@query(CACHE + f""" SELECT slug, coalesce(f.display_name, c.display_name) AS display_name, coalesce(f.average_score, c.average_score) AS average_score, CASE WHEN classic THEN f.classic_price ELSE c.classic_price END AS classic_price,
CASE WHEN in_season THEN f.in_season_price ELSE c.in_season_price END AS in_season_price, CASE WHEN scores THEN {NOW} + INTERVAL 24 HOUR ELSE c.scores_expires END AS scores_expires,
CASE WHEN classic THEN {NOW} + INTERVAL 12 HOUR ELSE c.classic_expires END AS classic_expires, CASE WHEN in_season THEN {NOW} + INTERVAL 12 HOUR ELSE c.in_season_expires END AS in_season_expires,
CASE WHEN f.slug IS NOT NULL THEN {NOW} ELSE c.updated END AS updated FROM cache c FULL JOIN fetched f USING (slug) LEFT JOIN plan p USING (slug)""")
def cache_refreshed(spark, sf_dir):
    """The cache after a refresh: scores always, prices and times of a group only where it had expired."""
    cache, fetched = _cache(spark, sf_dir)
    return caching.refreshed(cache, fetched, caching.plan(fetched, cache, _now()), _now()).select(*SHOWN)


@query(CACHE + f""" SELECT slug, coalesce(f.display_name, c.display_name) AS display_name, c.average_score, CASE WHEN f.slug IS NOT NULL THEN f.classic_price ELSE c.classic_price END AS classic_price,
CASE WHEN f.slug IS NOT NULL THEN f.in_season_price ELSE c.in_season_price END AS in_season_price, coalesce(c.scores_expires, {NOW}) AS scores_expires, CASE WHEN f.slug IS NOT NULL THEN {NOW} + INTERVAL 12 HOUR ELSE c.classic_expires END AS classic_expires,
CASE WHEN f.slug IS NOT NULL THEN {NOW} + INTERVAL 12 HOUR ELSE c.in_season_expires END AS in_season_expires, CASE WHEN f.slug IS NOT NULL THEN {NOW} ELSE c.updated END AS updated FROM cache c FULL JOIN fetched f USING (slug)""")
def cache_repriced(spark, sf_dir):
    """The cache after a refresh of prices alone."""
    cache, fetched = _cache(spark, sf_dir)
    return caching.repriced(cache, fetched, _now()).select(*SHOWN)


@query(f"SELECT o_orderkey AS event, CAST(floor(o_totalprice + 0.5) AS BIGINT) + 1 AS odds, {NOW} AS captured FROM orders WHERE o_orderkey % 3 = 0")
def odds_kept(spark, sf_dir):
    """Stored odds after a feed: what it lacks goes, what it has is captured anew."""
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("event"), F.floor(C("o_totalprice") + 0.5).alias("odds"))
    stored = orders.where("event % 2 = 0").withColumn("captured", _now() - F.expr("interval 1 day"))
    return caching.odds_upsert(stored, orders.where("event % 3 = 0").withColumn("odds", C("odds") + 1), _now())


@query("""WITH e AS (SELECT event_id, user_id % 20 AS team, user_id, event_type, ts, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS sev FROM events),
teams AS (SELECT n_nationkey AS team FROM nation), pl AS (SELECT c_nationkey AS team, c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 101 END AS p, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 4 END AS n, c_name FROM customer),
players AS (SELECT team, string_agg(c_custkey, ',' ORDER BY r) AS players FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY coalesce(p, -1) DESC, coalesce(n, 0) DESC, c_name, c_custkey) AS r FROM pl) WHERE r <= 7 GROUP BY team),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts DESC, event_id) AS rn FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 48 HOUR) WHERE rn <= 500),
news AS (SELECT team, string_agg(event_id, ',' ORDER BY sev DESC, ts DESC, event_id) AS news FROM (SELECT *, row_number() OVER (PARTITION BY team, user_id, event_type, sev % 2 ORDER BY ts DESC, event_id) AS k FROM recent) WHERE k = 1 GROUP BY team),
m AS (SELECT event_id, ts, user_id % 20 AS home, (user_id + 7) % 25 AS away FROM events WHERE event_type = 'signup' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY),
sides AS (SELECT event_id, ts, home AS team FROM m UNION ALL SELECT event_id, ts, away FROM m WHERE away <> home),
ahead AS (SELECT team, string_agg(event_id, ',' ORDER BY r) AS upcoming FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts, event_id) AS r FROM sides) WHERE r <= 5 GROUP BY team)
SELECT team, CASE WHEN team % 2 = 0 THEN '4-3-3' END AS formation, coalesce(players, '') AS players, coalesce(news, '') AS news, coalesce(upcoming, '') AS upcoming FROM teams LEFT JOIN players USING (team) LEFT JOIN news USING (team) LEFT JOIN ahead USING (team)""")
def team_pages(spark, sf_dir):
    """A team's page as one nested row (the first seven players are told here)."""
    events, customer, nation = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    newest = events.agg(F.max("ts")).first()[0]
    teams = nation.select(C("n_nationkey").cast("long").alias("team"))
    about = teams.where("team % 2 = 0").select("team", F.lit("4-3-3").alias("formation"))
    some = C("c_custkey") % 9 != 0
    players = customer.select(C("c_custkey").alias("player"), C("c_nationkey").cast("long").alias("team"), C("c_name").alias("name"), F.when(some, C("c_custkey") % 101).alias("probability"), F.when(some, C("c_custkey") % 4).alias("sources_total"))
    kinds = {"error": "out", "purchase": "serious", "click": "moderate", "view": "light"}
    severity = F.coalesce(*(F.when(C("event_type") == k, F.lit(v)) for k, v in kinds.items()), F.lit("none"))
    odd = F.when(C("event_type").isin("purchase", "view"), "b").otherwise("a")
    news = events.select(C("event_id").alias("id"), (C("user_id") % 20).alias("team"), C("user_id").alias("player"), C("event_type").alias("event"), odd.alias("source_name"), severity.alias("severity"), C("ts").alias("recorded_at"))
    matches = events.where("event_type = 'signup'").select(C("event_id").alias("match"), (C("user_id") % 20).alias("home"), ((C("user_id") + 7) % 25).alias("away"), C("ts").alias("stamp"))
    now = F.lit(newest)
    # the news of the last two days, and the matches of the last thirty in place of those to come
    pages = readmodels.team_pages(teams, players, news, about, matches.withColumn("stamp", C("stamp") + F.expr("interval 30 days")), now)
    ids = lambda c, k: F.array_join(F.transform(c, lambda e: e[k].cast("string")), ",")
    return pages.select("team", "formation", ids(F.slice("players", 1, 7), "player").alias("players"), ids(C("news"), "id").alias("news"), ids(C("upcoming"), "match").alias("upcoming"))


@query("""WITH m AS (SELECT event_id, ts, user_id % 20 AS home, CASE WHEN event_id % 11 <> 0 THEN (user_id + 7) % 25 END AS away, CAST(event_id % 4 AS BIGINT) AS round FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0),
u AS (SELECT * FROM m WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY), r AS (SELECT DISTINCT round FROM u ORDER BY round LIMIT 2),
k AS (SELECT c_nationkey AS team, arg_max(c_custkey, (c_custkey % 101, -c_custkey)) AS keeper FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 101 > 0 AND c_custkey % 3 > 0 GROUP BY 1), n AS (SELECT c_nationkey AS team, least(11, count(*)) AS n FROM customer WHERE c_custkey % 101 > 0 AND c_custkey % 3 > 0 GROUP BY 1)
SELECT event_id AS match, round, h.keeper AS home_keeper, CAST(coalesce(nh.n, 0) AS INTEGER) AS home_players, a.keeper AS away_keeper, CAST(coalesce(na.n, 0) AS INTEGER) AS away_players FROM u JOIN r USING (round) LEFT JOIN k h ON h.team = home LEFT JOIN k a ON a.team = away LEFT JOIN n nh ON nh.team = home LEFT JOIN n na ON na.team = away""")
def round_pages(spark, sf_dir):
    """The matches of the rounds shown, with both elevens (their keepers and sizes are told here)."""
    events, customer, nation = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    now = F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("interval 5 days")
    matches = events.where("event_type = 'purchase' and event_id % 3 = 0").select(C("event_id").alias("match"), (C("user_id") % 20).alias("home"), F.when(C("event_id") % 11 != 0, (C("user_id") + 7) % 25).alias("away"), C("ts").alias("stamp"), (C("event_id") % 4).alias("round"))
    kinds = ["POR", "DEF", "MED", "DEL", None]
    position = F.get(F.array(*(F.lit(k).cast("string") for k in kinds)), (C("c_custkey") % 5).cast("int"))
    players = customer.select(C("c_custkey").cast("long").alias("player"), C("c_nationkey").cast("long").alias("team"), position.alias("position"), (C("c_custkey") % 101).cast("int").alias("probability"), (C("c_custkey") % 3).alias("sources_likely"))
    out = readmodels.round_pages(matches, nation.select(C("n_nationkey").cast("long").alias("team"), "n_name"), players, now)
    keeper = lambda xi: F.get(F.filter(xi, lambda e: e["line"] == "POR"), F.lit(0))["player"]
    return out.select("match", "round", *(c for s in ("home", "away") for c in (keeper(C(f"{s}_xi")).alias(f"{s}_keeper"), F.size(f"{s}_xi").alias(f"{s}_players"))))


@query("""WITH s AS (SELECT event_type AS source, CASE event_type WHEN 'click' THEN 'Ñandú' WHEN 'view' THEN 'nube' WHEN 'signup' THEN 'Ojo' WHEN 'error' THEN 'ábaco' ELSE event_type END AS name, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS place FROM (SELECT DISTINCT event_type FROM events)),
a AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY place) AS sources FROM a JOIN s ON s.source = event_type GROUP BY user_id""")
def agreement_by_name(spark, sf_dir):
    """The sources behind each player in the order of their names, as Spanish has it: ábaco, nube, Ñandú, Ojo, purchase."""
    names = {"click": "Ñandú", "view": "nube", "signup": "Ojo", "error": "ábaco"}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    said = rows.groupBy("user_id").agg(F.collect_list(F.struct(C("event_type").alias("source"), N.clamp_probability(C("value")).alias("probability"))).alias("agreement"))  # a row per source
    return said.select("user_id", F.array_join(F.transform(readmodels.by_source_name(C("agreement"), known), lambda a: a["source"]), ",").alias("sources"))


@query("""WITH c AS (SELECT DISTINCT p_partkey AS local_id, l_suppkey AS s, 's' || l_suppkey AS slug, p_name, string_split(p_name, ' ') AS x, p_partkey % 10 = 0 AS no_dob FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, CASE WHEN s % 3 = 0 THEN x WHEN s % 3 = 1 THEN [x[1], 'zz' || s] ELSE [x[2], x[1]] END AS y, s % 2 = 0 AS club, s % 4 = 0 AND NOT no_dob AS dob, s % 5 = 0 AS nat FROM c),
e AS (SELECT *, 2.0::DOUBLE * len(list_intersect(list_distinct(x), list_distinct(y))) / (len(x) + len(y)) AS name_score FROM n), k AS (SELECT *, (dob AND name_score >= 0.5) OR (club AND name_score >= 0.7) OR name_score >= 0.9 AS ok FROM e),
t AS (SELECT *, CASE WHEN ok THEN name_score + 0.3::DOUBLE * dob::INT + 0.15::DOUBLE * club::INT + 0.1::DOUBLE * nat::INT END AS total FROM k),
r AS (SELECT *, row_number() OVER w AS rn, lead(total) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY local_id ORDER BY total DESC NULLS LAST, slug)), d AS (SELECT *, CASE WHEN NOT ok THEN 'weak' WHEN nxt >= total - 0.1::DOUBLE THEN 'ambiguous' ELSE 'verified' END AS kind FROM r WHERE rn = 1)
SELECT local_id, kind, CASE WHEN kind <> 'weak' THEN slug END AS slug, CASE WHEN kind = 'verified' THEN CAST(floor(1000 * round(least(0.99::DOUBLE, 0.7::DOUBLE + 0.2::DOUBLE * dob::INT + 0.05::DOUBLE * club::INT + 0.04::DOUBLE * nat::INT), 2) + 0.5) AS BIGINT) END AS confidence FROM d""")
def research_search(spark, sf_dir):
    """What a search's hits say of each player: names, clubs, dates and nations compared as a search does."""
    found = identity.research(identity.searched(*_people(spark, sf_dir)))
    return found.select("local_id", "kind", "slug", F.floor(1000 * C("confidence") + 0.5).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN length(string_split(p_name, ' ')[1]) <= 3 THEN string_split(p_name, ' ')[2] ELSE p_name END AS words FROM part")
def search_words(spark, sf_dir):
    """What to search for, by name."""
    return table(spark, sf_dir, "part").select("p_partkey", adapters.search_words(C("p_name")).alias("words"))


@query("""WITH d AS (SELECT 's' || s_suppkey AS slug, (row_number() OVER (ORDER BY 's' || s_suppkey) - 1) // 20 AS batch, s_acctbal FROM supplier) SELECT slug, CASE WHEN batch % 4 = 1 THEN 'unknown' WHEN s_acctbal > 0 THEN 'found' ELSE 'missing' END AS status FROM d""")
def audit_batches(spark, sf_dir):
    """Slugs asked for in batches of twenty, every fourth of which failed: found, missing, or not known."""
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("slug"), "s_acctbal")
    asked = ordered.batches(supplier.select("slug"), ["slug"], 20)
    answers = asked.select("batch").distinct().withColumn("error", F.when(C("batch") % 4 == 1, "timeout"))
    return bridging.audited(asked, answers, supplier.where("s_acctbal > 0"))


@query("""SELECT n_nationkey AS team, CASE WHEN n_nationkey % 3 = 0 THEN 'old' ELSE 'new' END AS label, n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AS outside FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 1""")
def catalogue_seed(spark, sf_dir):
    """A catalogue put into a table: rows that are there stay, rows outside the catalogue are told."""
    nation = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("team"))
    base = nation.where("team % 3 = 0").withColumn("label", F.lit("old"))
    rows, outside = S.seeded(base, nation.where("team % 2 = 1").withColumn("label", F.lit("new")), ["team"])
    return rows.join(outside.select("team", F.lit(True).alias("outside")), "team", "left").withColumn("outside", F.coalesce("outside", F.lit(False)))


@query("""WITH runs AS (SELECT event_id, event_type AS source, CASE WHEN value > 300 THEN 'failed' ELSE 'success' END AS status, ts FROM events WHERE event_id % 7 = 0 AND (event_type <> 'error' OR event_id < 100)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT * FROM runs ORDER BY ts DESC, event_id DESC LIMIT 100)) WHERE rn = 1)
SELECT s.source, status, ts AS finished_at FROM (SELECT DISTINCT event_type AS source FROM events) s LEFT JOIN last USING (source)""")
def home_sources(spark, sf_dir):
    """Each source's last run among the newest hundred of all."""
    events = table(spark, sf_dir, "events")
    runs = events.where("event_id % 7 = 0 and (event_type != 'error' or event_id < 100)").select(C("event_id").alias("run"), C("event_type").alias("source"), F.when(C("value") > 300, "failed").otherwise("success").alias("status"), C("ts").alias("finished_at"))
    return readmodels.source_status(events.select(C("event_type").alias("source")).distinct(), runs)


@query("""SELECT n_nationkey AS team, count(c_custkey) AS players, count(c_custkey) FILTER (c_custkey % 4 <> 0) AS covered, count(c_custkey) FILTER (c_custkey % 4 <> 0 AND c_custkey % 101 >= 60) AS likely FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON c_nationkey = n_nationkey GROUP BY 1""")
def home_teams(spark, sf_dir):
    """Teams with how many of their players are covered, and likely."""
    customer, nation = table(spark, sf_dir, "customer").where("c_nationkey != 3"), table(spark, sf_dir, "nation")
    players = customer.select(C("c_nationkey").alias("team"), C("c_custkey").alias("player"))
    known = players.where("player % 4 != 0").select("player", (C("player") % 101).alias("probability"))
    return readmodels.home_teams(nation.select(C("n_nationkey").alias("team")), players, known)


@query("""WITH l AS (SELECT * FROM (SELECT event_id, ts, user_id, event_type, user_id % 20 AS team, CAST(greatest(0, least(100, floor(value + 0.5))) AS INTEGER) AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
f AS (SELECT *, event_id % 4 = 0 AS sure FROM l WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR),
g AS (SELECT a.team, a.user_id, c.event_type AS source, coalesce(f.p, 0) AS p, coalesce(f.sure, false) AS sure, f.ts FROM (SELECT DISTINCT team, user_id FROM f) a JOIN (SELECT DISTINCT team, event_type FROM f) c USING (team) LEFT JOIN f ON f.user_id = a.user_id AND f.event_type = c.event_type)
SELECT user_id AS player, source, p AS probability, CASE WHEN sure THEN 'confirmed' ELSE 'probable' END AS kind, ts AS fetched_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY sure DESC, p DESC, source) - 1 AS INTEGER) AS place FROM g""")
def consensus_agreement(spark, sf_dir):
    """The sources behind a consensus with kind and time: confirmed ones first, then by falling probability."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts")).first()[0]
    last = S.first_per_key(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).where(C("ts") >= F.lit(newest) - F.expr("interval 12 hours"))
    kind = F.when(C("event_id") % 4 == 0, "confirmed").otherwise("probable")
    rows = last.select((C("user_id") % 20).alias("team"), C("user_id").alias("player"), C("event_type").alias("source"), N.clamp_probability(C("value")).alias("probability"), kind.alias("kind"), C("ts").alias("fetched_at"))
    sources = events.select(C("event_type").alias("source")).distinct().withColumn("weight", F.lit(1.0))
    out = CO.consensus_detailed(rows, sources).select("player", F.posexplode("agreement").alias("place", "a"))
    return out.select("player", "a.source", "a.probability", "a.kind", "a.fetched_at", "place")
