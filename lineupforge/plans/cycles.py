"""Queries on whole polling cycles. Every third event is a report, the others are what is stored; event types stand for
sources, users for players; a player is reported by both names or by the last name, every seventh by a name nobody has."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import cascade, jobs
from ..operators import consensus as CO
from ..operators import state as S
from ..sinks.shared import scratch, written
from ..sinks.store import Store
from .feeds import CLAMP, HOURS, WEEK
from .registry import registry, table

QUERIES, SQL, query = registry()
C = F.col
STORED = f"""WITH e AS (SELECT event_id, ts, user_id, event_type, user_id % 20 AS team, {CLAMP.format('value')} AS p FROM events),
stored AS (SELECT user_id, event_type, arg_max(p, (ts, event_id)) AS p, max(ts) AS ts FROM e WHERE event_id % 3 <> 0 GROUP BY ALL),
rep AS (SELECT * FROM e WHERE event_id % 3 = 0 {{0}}), news AS (SELECT user_id, event_type, arg_max(p, event_id) AS p FROM rep WHERE user_id % 7 <> 0 GROUP BY ALL),
said AS (SELECT DISTINCT team, event_type, true AS said FROM rep),
after AS (SELECT user_id, event_type, user_id % 20 AS team, CASE WHEN n.p IS NOT NULL THEN n.p WHEN said THEN 0 ELSE s.p END AS p, n.p IS NULL AND said IS NOT NULL AS absent,
  CASE WHEN n.p IS NOT NULL OR said THEN (SELECT max(ts) FROM events) ELSE s.ts END AS fetched_at
  FROM stored s FULL JOIN news n USING (user_id, event_type) LEFT JOIN said g ON g.team = user_id % 20 AND g.event_type = coalesce(s.event_type, n.event_type))"""
ALL, RUN = STORED.replace("{0}", ""), STORED.replace("{0}", "AND event_type NOT IN ('error', 'signup')")


def _tables(spark, sf_dir):
    """reports, events (none), players, forecasts, and the time of the cycle."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (C("user_id") % 20).alias("team"))
    key = C("user_id").cast("string")
    last = F.concat(F.lit("su"), key)
    raw = F.when(C("user_id") % 7 == 0, F.concat(F.lit("qq"), key, F.lit(" zz"), key)).when(C("user_id") % 2 == 0, last).otherwise(F.concat(F.lit("na"), key, F.lit(" "), last))
    none = F.lit(None).cast("string")
    reports = rows.where("event_id % 3 = 0").select(
        C("event_type").alias("source"), "team", C("event_id").alias("ord"), raw.alias("raw"), C("value").alias("probability"), F.lit(None).cast("boolean").alias("certain"),
        none.alias("kind"), none.alias("note"), none.alias("position"), none.alias("photo"),
    )
    events = reports.where("false").select("source", "team", "raw", none.alias("event"), none.alias("severity"), none.alias("reason"))
    players = rows.select(C("user_id").alias("player"), "team", C("user_id").alias("ord"), F.concat(F.lit("na"), key, F.lit(" "), last).alias("name"), none.alias("position"), none.alias("photo")).distinct()
    old = S.first_per_key(rows.where("event_id % 3 != 0"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    forecasts = old.select(C("user_id").alias("player"), C("event_type").alias("source"), N.clamp_probability(C("value")).alias("probability"), F.lit(False).alias("certain"), F.lit("probable").alias("kind"), none.alias("note"), C("ts").alias("fetched_at"))
    return reports, events, players, forecasts, F.lit(rows.agg(F.max("ts")).first()[0])


@query(ALL + " SELECT user_id AS player, event_type AS source, p AS probability, absent, fetched_at FROM after")
def report_persisted(spark, sf_dir):
    """All stored forecasts after a cycle's reports: new ones, zeros for whom a report leaves out, and old ones."""
    out = jobs.persist(*_tables(spark, sf_dir))["forecasts"]
    return out.select("player", "source", "probability", (C("note").eqNullSafe(jobs.ABSENT)).alias("absent"), "fetched_at")


@query("SELECT event_type AS source, user_id % 20 AS team, 'qq' || user_id || ' zz' || user_id AS raw, count(*) AS n FROM events WHERE event_id % 3 = 0 AND user_id % 7 = 0 GROUP BY ALL")
def report_unmatched(spark, sf_dir):
    """Reported names that no player of the team has."""
    return jobs.persist(*_tables(spark, sf_dir))["unmatched"].groupBy("source", "team", "raw").agg(F.count(F.lit(1)).alias("n"))


def _cycle(spark, sf_dir):
    """error failed, view is partial, signup is disabled."""
    reports, events, players, forecasts, at = _tables(spark, sf_dir)
    asked = reports.select("source").distinct()
    answers = asked.select("source", (C("source") == "view").alias("partial"), F.when(C("source") == "error", "timeout").alias("error"))
    types = table(spark, sf_dir, "events").select(C("event_type").alias("source")).distinct()
    weight = F.when(C("source") == "click", 1.5).when(C("source") == "purchase", 2.0).otherwise(1.0)
    sources = types.select("source", (C("source") != "signup").alias("enabled"), weight.alias("weight"))
    before = spark.createDataFrame([], "team long, player long, probability int, sources_likely long, sources_total long, agreement array<struct<source:string,probability:int>>")
    return jobs.cycle(answers, sources, reports, events, players, forecasts, before, at)


@query("""SELECT event_type AS source, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status,
CAST(CASE WHEN event_type = 'error' THEN 0 ELSE count(*) FILTER (user_id % 7 <> 0) END AS BIGINT) AS items FROM events WHERE event_id % 3 = 0 AND event_type <> 'signup' GROUP BY event_type""")
def cycle_runs(spark, sf_dir):
    """The ledger of a cycle's runs, with the forecasts that each brought."""
    return _cycle(spark, sf_dir)["runs"].select("source", "status", "items")


@query(RUN + f""", fresh AS (SELECT * FROM after WHERE fetched_at >= (SELECT max(ts) FROM events) - INTERVAL {HOURS} HOUR), grid AS (SELECT a.team, a.user_id, c.event_type,
CASE c.event_type WHEN 'click' THEN 1.5::DOUBLE WHEN 'purchase' THEN 2.0 ELSE 1.0 END AS w, coalesce(f.p, 0) AS p FROM (SELECT DISTINCT team, user_id FROM fresh) a JOIN (SELECT DISTINCT team, event_type FROM fresh) c USING (team) LEFT JOIN fresh f ON f.user_id = a.user_id AND f.event_type = c.event_type)
SELECT team, user_id AS player, CAST(floor(sum(w * p) / sum(w) + 0.5) AS INTEGER) AS probability, count(*) AS sources_total FROM grid GROUP BY team, user_id""")
def cycle_consensus(spark, sf_dir):
    """The consensus that a cycle leaves."""
    return _cycle(spark, sf_dir)["consensus"].select("team", "player", "probability", "sources_total")


@query(f"""WITH m AS (SELECT event_id, ts, {WEEK} AS round FROM events WHERE event_type = 'purchase'), u AS (SELECT * FROM m WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY),
r AS (SELECT DISTINCT round FROM u WHERE round IS NOT NULL ORDER BY round LIMIT 2) SELECT event_id AS match, round FROM u WHERE round IN (SELECT round FROM r) OR (round IS NULL AND (SELECT count(*) FROM r) < 2)""")
def rounds_shown(spark, sf_dir):
    """Matches of the current and the next round."""
    rows = table(spark, sf_dir, "events")
    now = F.lit(rows.agg(F.max("ts")).first()[0]) - F.expr("interval 10 days")
    week = N.season_week(C("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-12-31").cast("timestamp_ntz"))
    matches = rows.where("event_type = 'purchase'").select(C("event_id").alias("match"), C("ts").alias("stamp"), week.alias("round"))
    return jobs.shown_rounds(matches, now).select("match", "round")


@query("""SELECT event_type AS source, user_id % 20 AS team, 'qq' || user_id || ' zz' || user_id AS raw, probability, count(*) AS n FROM (
SELECT *, CAST(greatest(0, least(100, floor(value + 0.5))) AS INTEGER) AS probability FROM events WHERE event_id % 3 = 0 AND user_id % 7 = 0
UNION ALL SELECT *, NULL FROM events WHERE event_id % 3 = 0 AND user_id % 7 = 0 AND event_id % 2 = 0) GROUP BY ALL""")
def dead_letters(spark, sf_dir):
    """Dead letters of reports, and of events (every second report is an event as well), which have no probability."""
    reports, _, players, forecasts, at = _tables(spark, sf_dir)
    none = F.lit(None).cast("string")
    events = reports.where("ord % 2 = 0").select("source", "team", "raw", F.lit("injury").alias("event"), none.alias("severity"), none.alias("reason"))
    return jobs.persist(reports, events, players, forecasts, at)["unmatched"].groupBy("source", "team", "raw", "probability").agg(F.count(F.lit(1)).alias("n"))


@query(RUN + f""", fresh AS (SELECT * FROM after WHERE fetched_at >= (SELECT max(ts) FROM events) - INTERVAL {HOURS} HOUR), grid AS (SELECT a.team, a.user_id, c.event_type,
CASE c.event_type WHEN 'click' THEN 1.5::DOUBLE WHEN 'purchase' THEN 2.0 ELSE 1.0 END AS w, coalesce(f.p, 0) AS p FROM (SELECT DISTINCT team, user_id FROM fresh) a JOIN (SELECT DISTINCT team, event_type FROM fresh) c USING (team) LEFT JOIN fresh f ON f.user_id = a.user_id AND f.event_type = c.event_type),
new AS (SELECT team, user_id AS player, CAST(floor(sum(w * p) / sum(w) + 0.5) AS INTEGER) AS probability, count(*) AS sources_total FROM grid GROUP BY team, user_id)
SELECT * FROM new UNION ALL SELECT DISTINCT user_id % 20 AS team, user_id AS player, 77 AS probability, 9 AS sources_total FROM events WHERE user_id NOT IN (SELECT player FROM new)
UNION ALL SELECT 99, -1, 77, 9""")
def cycle_consensus_kept(spark, sf_dir):
    """The consensus that a cycle leaves where one is stored of everybody: rows of whom nothing fresh is known stay."""
    reports, events, players, forecasts, at = _tables(spark, sf_dir)
    asked = reports.select("source").distinct()
    answers = asked.select("source", (C("source") == "view").alias("partial"), F.when(C("source") == "error", "timeout").alias("error"))
    weight = F.when(C("source") == "click", 1.5).when(C("source") == "purchase", 2.0).otherwise(1.0)
    sources = table(spark, sf_dir, "events").select(C("event_type").alias("source")).distinct().select("source", (C("source") != "signup").alias("enabled"), weight.alias("weight"))
    everybody = players.select("team", "player").unionByName(spark.createDataFrame([(99, -1)], "team long, player long"))
    stored = everybody.select("team", "player", F.lit(77).alias("probability"), F.lit(0).cast("long").alias("sources_likely"), F.lit(9).cast("long").alias("sources_total"), F.lit(None).cast("array<struct<source:string,probability:int>>").alias("agreement"))
    return jobs.cycle(answers, sources, reports, events, players, forecasts, stored, at)["consensus"].select("team", "player", "probability", "sources_total")


@query(f"""WITH fresh AS (SELECT *, user_id % 20 AS team FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {HOURS} HOUR), teams AS (SELECT DISTINCT user_id % 20 AS team FROM events UNION ALL SELECT 99),
info AS (SELECT team, arg_max(event_id, (ts, event_type, event_id)) FILTER (event_type = 'click') AS coach, arg_max(event_id, (ts, event_type, event_id)) FILTER (value > 100) AS formation FROM fresh GROUP BY team),
pieces AS (SELECT team, arg_max(event_id, (ts, event_type, event_id)) FILTER (event_type = 'view') AS penalty, arg_max(event_id, (ts, event_type, event_id)) FILTER (event_type = 'purchase') AS corner FROM fresh GROUP BY team)
SELECT team, CAST(formation AS VARCHAR) AS formation, CAST(coach AS VARCHAR) AS coach, CASE WHEN penalty IS NULL AND corner IS NULL THEN NULL ELSE coalesce('p' || penalty, '') || '|' || coalesce('c' || corner, '') || '|' END AS takers
FROM teams LEFT JOIN info USING (team) LEFT JOIN pieces USING (team)""")
def team_consensus(spark, sf_dir):
    """A row for every team, of what fresh sources say last of formation, coach and takers; null where none says anything."""
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts")).first()[0]
    fresh = rows.where(C("ts") >= F.lit(newest) - F.expr(f"interval {HOURS} hours")).withColumn("team", C("user_id") % 20)
    key = F.concat("event_type", F.lpad(C("event_id").cast("string"), 12, "0"))  # sources, told apart by event where times are equal
    said = lambda c: F.when(c, C("event_id").cast("string"))
    info = fresh.select("team", key.alias("source"), said(C("value") > 100).alias("formation"), said(C("event_type") == "click").alias("coach"), C("ts").alias("fetched_at"))
    one = lambda kind, mark: F.when(C("event_type") == kind, F.array(F.concat(F.lit(mark), C("event_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    pieces = fresh.select("team", key.alias("source"), one("view", "p").alias("penalty"), one("purchase", "c").alias("corner"), F.lit(None).cast("array<string>").alias("free_kick"), C("ts").alias("fetched_at"))
    teams = rows.select((C("user_id") % 20).alias("team")).unionByName(spark.createDataFrame([(99,)], "team long"))
    out = CO.team_consensus(teams, info, pieces)
    joined = lambda k: F.array_join(C("set_pieces")[k], ",")
    return out.select("team", "formation", "coach", F.when(C("set_pieces").isNotNull(), F.concat_ws("|", joined("penalty"), joined("corner"), joined("free_kick"))).alias("takers"))


STORE = f"""WITH e AS (SELECT event_id, user_id, event_type, user_id % 20 AS team, {CLAMP.format('value')} AS p FROM events WHERE user_id % 7 <> 0 OR event_id % 3 < 2),
one AS (SELECT team, user_id, event_type, arg_max(p, event_id) AS p FROM e WHERE event_id % 3 = 1 AND user_id % 7 <> 0 GROUP BY ALL),
two AS (SELECT team, user_id, event_type, arg_max(p, event_id) AS p FROM e WHERE event_id % 3 = 0 AND team < 5 AND user_id % 7 <> 0 GROUP BY ALL),
said AS (SELECT DISTINCT user_id % 20 AS team, event_type FROM events WHERE event_id % 3 = 0 AND user_id % 20 < 5),
forecasts AS (SELECT team, user_id, event_type, CASE WHEN two.p IS NOT NULL THEN two.p WHEN said.team IS NOT NULL THEN 0 ELSE one.p END AS p FROM one FULL JOIN two USING (team, user_id, event_type) LEFT JOIN said USING (team, event_type)),
grid AS (SELECT a.team, a.user_id, c.event_type, CASE c.event_type WHEN 'click' THEN 1.5::DOUBLE WHEN 'purchase' THEN 2.0 ELSE 1.0 END AS w, coalesce(f.p, 0) AS p
  FROM (SELECT DISTINCT team, user_id FROM forecasts) a JOIN (SELECT DISTINCT team, event_type FROM forecasts) c USING (team) LEFT JOIN forecasts f ON f.user_id = a.user_id AND f.event_type = c.event_type)"""


def stored_cycles(spark, sf_dir):
    """A store after two cycles: every team is reported, then, six hours later, some teams are."""
    reports, events, players, _, at = _tables(spark, sf_dir)
    every = table(spark, sf_dir, "events").where("event_id % 3 = 1")
    earlier = every.select(C("event_type").alias("source"), (C("user_id") % 20).cast("string").alias("team"), C("event_id").alias("ord"), F.concat(F.lit("na"), C("user_id").cast("string"), F.lit(" su"), C("user_id").cast("string")).alias("raw"), C("value").alias("probability"))
    earlier = earlier.where("cast(substring(raw, 3, instr(raw, ' ') - 3) as bigint) % 7 != 0")
    shaped = earlier.select("*", F.lit(None).cast("boolean").alias("certain"), *(F.lit(None).cast("string").alias(c) for c in ("kind", "note", "position", "photo")))
    reports, events = (df.withColumn("team", C("team").cast("string")) for df in (reports.where("team < 5"), events))
    types = table(spark, sf_dir, "events").select(C("event_type").alias("source")).distinct()
    weight = F.when(C("source") == "click", 1.5).when(C("source") == "purchase", 2.0).otherwise(1.0)
    sources = types.select("source", F.lit(True).alias("enabled"), weight.alias("weight"))
    answers = types.select("source", F.lit(False).alias("partial"), F.lit(None).cast("string").alias("error"))
    info = spark.createDataFrame([], "team string, source string, coach string, formation string, news string")
    pieces = spark.createDataFrame([], "team string, source string, penalty array<string>, corner array<string>, free_kick array<string>")
    store = Store(spark, scratch(spark, "store"))
    jobs.begin(store, players.withColumns({"team": C("team").cast("string"), "closed": F.lit(True)}))
    jobs.run(store, answers, sources, shaped, events, info, pieces, at - F.expr("interval 6 hours"))
    jobs.run(store, answers, sources, reports, events, info, pieces, at)
    return store


@query(STORE + """ SELECT team, user_id AS player, CAST(floor(sum(w * p) / sum(w) + 0.5) AS INTEGER) AS probability, count(*) AS sources_total,
(SELECT max(ts) FROM events) - CASE WHEN team < 5 THEN INTERVAL 0 HOUR ELSE INTERVAL 6 HOUR END AS updated_at FROM grid GROUP BY team, user_id""")
def stored_consensus(spark, sf_dir):
    """The stored consensus after a cycle over everything and one over some teams, which alone it wrote."""
    out = stored_cycles(spark, sf_dir).read("consensus")
    return out.select(C("team").cast("long").alias("team"), "player", "probability", "sources_total", "updated_at")


MERGED = """WITH p AS (SELECT DISTINCT user_id AS player FROM events), lead AS (SELECT player, player - 1 AS leader FROM p WHERE player % 2 = 1 AND player - 1 IN (SELECT player FROM p)),
e AS (SELECT *, coalesce(leader, user_id) AS now, leader IS NULL AS own FROM events LEFT JOIN lead ON player = user_id),
latest AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
ids AS (SELECT now, user_id, own, event_type, min(event_id) AS slug FROM e WHERE event_id % 5 = 0 GROUP BY ALL), sums AS (SELECT now, user_id, own, count(*) AS n FROM e WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT 'players' AS "table", player, '' AS key, NULL::BIGINT AS value FROM p WHERE player NOT IN (SELECT player FROM lead)
UNION ALL SELECT 'forecasts', now, event_type, event_id FROM latest QUALIFY row_number() OVER (PARTITION BY now, event_type ORDER BY ts DESC, own DESC) = 1
UNION ALL SELECT 'events', now, '', event_id FROM e WHERE event_type = 'error'
UNION ALL SELECT 'consensus', now, '', n FROM sums QUALIFY row_number() OVER (PARTITION BY now ORDER BY own DESC) = 1
UNION ALL SELECT 'source_ids', now, event_type, slug FROM ids QUALIFY row_number() OVER (PARTITION BY now, event_type ORDER BY own DESC) = 1
UNION ALL SELECT 'mappings', now, '', user_id FROM (SELECT DISTINCT now, user_id, own FROM e WHERE user_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY now ORDER BY own DESC) = 1
UNION ALL SELECT 'unmatched', now, '', event_id FROM e WHERE event_type = 'signup'"""


@query(MERGED)
def merge_cascade(spark, sf_dir):
    """All tables around players after odd players were merged into the even ones before them."""
    rows = table(spark, sf_dir, "events").select("event_id", C("user_id").alias("player"), C("event_type").alias("source"), "ts")
    players = written(rows.select("player").distinct())
    before = players.select((C("player") + 1).alias("player"))
    leaders = players.where("player % 2 = 1").join(before, "player", "left_semi").select(C("player").alias("follower"), (C("player") - 1).alias("leader"))
    tables = {
        "players": players,
        "forecasts": S.first_per_key(rows, ["player", "source"], [F.desc("ts"), F.desc("event_id")]).select("player", "source", C("event_id").alias("value"), C("ts").alias("fetched_at")),
        "events": rows.where("source = 'error'").select("player", C("event_id").alias("value")),
        "consensus": rows.where("event_id % 3 = 0").groupBy("player").agg(F.count(F.lit(1)).alias("value")),
        "source_ids": rows.where("event_id % 5 = 0").groupBy("player", "source").agg(F.min("event_id").alias("value")),
        "mappings": players.where("player % 3 = 0").withColumn("value", C("player")),
        "unmatched": rows.where("source = 'signup'").select(C("player").alias("resolved"), C("event_id").alias("value")),
    }
    out = cascade.merge(cascade.PLAYERS, tables, "players", "player", leaders)
    told = lambda name, df: df.select(F.lit(name).alias("table"), C("resolved" if name == "unmatched" else "player").alias("player"), (C("source") if "source" in df.columns else F.lit("")).alias("key"), (C("value") if "value" in df.columns else F.lit(None).cast("long")).alias("value"))
    named = [told(name, df) for name, df in out.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), named)
