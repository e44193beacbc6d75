"""Queries over the event feed: event types stand for sources, users for players, user_id % 20 for teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import consensus as C
from ..operators import lineup, ordered
from ..operators import state as S
from .registry import registry, table

QUERIES, SQL, query = registry()
HOURS = 12

CLAMP = "CAST(greatest(0, least(100, floor({0} + 0.5))) AS INTEGER)"
LATEST = f"""
SELECT * FROM (SELECT event_id, ts, user_id, event_type, value, user_id % 20 AS team, {CLAMP.format('value')} AS probability,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
WEIGHTS = "(VALUES ('click', '1.5x'), ('view', '1'), ('purchase', '2'), ('signup', 'abc'), ('login', '0'))"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _latest(spark, sf_dir) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 20).alias("team"), N.clamp_probability(F.col("value")).alias("probability"))
    return S.first_per_key(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


def _newest(spark, sf_dir):
    """The time of the queries: that of the newest row, which one column tells."""
    return F.lit(_events(spark, sf_dir).agg(F.max("ts")).first()[0])


def _as_of(rows: DataFrame, at: Column, hours: int) -> DataFrame:
    """Rows of the last hours before a time, the border included."""
    return rows.where(F.col("ts") >= at - F.expr(f"interval {hours} hours"))


@query(f"SELECT user_id, event_type, event_id, ts, value FROM ({LATEST})")
def latest_forecast(spark, sf_dir):
    """The newest row per player and source."""
    return _latest(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", "value")


@query(f"SELECT event_id, {CLAMP.format('value')} AS probability FROM events")
def clamp_round(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", N.clamp_probability(F.col("value")).alias("probability"))


@query("""SELECT event_id, CASE WHEN w > 0 THEN w ELSE 1.0 END AS weight FROM (
SELECT event_id, TRY_CAST(regexp_extract(replace(props, '{"k": ', ''), '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE) AS w FROM events)""")
def parse_weight(spark, sf_dir):
    text = F.replace("props", F.lit('{"k": '), F.lit(""))
    return _events(spark, sf_dir).select("event_id", N.parse_weight(text).alias("weight"))


def _consensus(spark, sf_dir) -> DataFrame:
    fresh = _as_of(_latest(spark, sf_dir), _newest(spark, sf_dir), HOURS).select("team", F.col("user_id").alias("player"), F.col("event_type").alias("source"), "probability")
    kinds = [("click", "1.5x"), ("view", "1"), ("purchase", "2"), ("signup", "abc"), ("login", "0")]
    named = spark.createDataFrame(kinds, "source string, text string").select("source", N.parse_weight(F.col("text")).alias("weight"))
    types = _events(spark, sf_dir).select(F.col("event_type").alias("source")).distinct().join(named, "source", "left").fillna(1.0, ["weight"])
    return C.consensus(fresh, types)


CONSENSUS = f"""
WITH latest AS ({LATEST}), fresh AS (SELECT * FROM latest WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {HOURS} HOUR),
weights AS (SELECT source, CASE source WHEN 'click' THEN 1.5 WHEN 'purchase' THEN 2.0 ELSE 1.0 END AS weight FROM (SELECT DISTINCT event_type AS source FROM events)),
covering AS (SELECT DISTINCT team, event_type AS source FROM fresh),
players AS (SELECT DISTINCT team, user_id AS player FROM fresh),
grid AS (SELECT p.team, p.player, c.source, w.weight, coalesce(f.probability, 0) AS probability FROM players p JOIN covering c USING (team)
  JOIN weights w USING (source) LEFT JOIN fresh f ON f.user_id = p.player AND f.event_type = c.source)"""


@query(CONSENSUS + """SELECT player, team, CAST(floor(sum(CAST(weight AS DOUBLE) * probability) / sum(CAST(weight AS DOUBLE)) + 0.5) AS INTEGER) AS probability,
count(*) FILTER (probability >= 60) AS sources_likely, count(*) AS sources_total FROM grid GROUP BY player, team""")
def consensus_by_player(spark, sf_dir):
    """Flagship: the weighted consensus of fresh sources, silence counting as zero."""
    return _consensus(spark, sf_dir).select("player", "team", "probability", "sources_likely", "sources_total")


@query(CONSENSUS + "SELECT player, source, probability, CAST(row_number() OVER (PARTITION BY player, team ORDER BY probability DESC, source) - 1 AS INTEGER) AS place FROM grid")
def consensus_detail(spark, sf_dir):
    """The sources behind a consensus, by falling probability."""
    return _consensus(spark, sf_dir).select("player", F.posexplode("agreement").alias("place", "a")).select("player", "a.source", "a.probability", "place")


@query("""SELECT user_id % 20 AS team, arg_max(CASE WHEN value > 100 THEN event_type ELSE ' ' END, (ts, event_id)) FILTER (value > 100) AS formation FROM events GROUP BY 1""")
def team_latest_value(spark, sf_dir):
    rows = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("team"), F.when(F.col("value") > 100, F.col("event_type")).otherwise(" ").alias("formation"), "ts", "event_id")
    return C.latest_value(rows, "team", "formation", ["ts", "event_id"])


@query("""SELECT source, array_to_string(arg_max(w, doc_id) FILTER (len(w) > 0), '|') AS takers FROM (
SELECT source, doc_id, CASE WHEN n_chars % 3 = 0 THEN [lang, source] ELSE [] END AS w FROM documents) GROUP BY source""")
def team_latest_array(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("n_chars") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("takers"))
    return C.latest_array(rows, "source", "takers", ["doc_id"]).select("source", F.array_join("takers", "|").alias("takers"))


@query(f"""WITH latest AS ({LATEST}), reported AS (SELECT * FROM latest WHERE event_id % 3 = 0)
SELECT l.user_id, l.event_type, 0 AS probability FROM latest l WHERE EXISTS (SELECT 1 FROM reported r WHERE r.team = l.team AND r.event_type = l.event_type)
AND NOT EXISTS (SELECT 1 FROM reported r WHERE r.user_id = l.user_id AND r.event_type = l.event_type)""")
def zero_fill_missing(spark, sf_dir):
    """Players whom a non-empty report of their team and source leaves out get 0."""
    latest = _latest(spark, sf_dir).select("user_id", "event_type", "team", "event_id", "probability")
    reported = latest.where("event_id % 3 = 0")
    return S.zero_fill(latest, reported, "user_id", ["team", "event_type"], "probability").select("user_id", "event_type", "probability")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)) WHERE rn = 1""")
def latest_run_in_top100(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return S.latest_within_newest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 100)


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
FROM (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR ORDER BY ts DESC, event_id DESC LIMIT 500)) WHERE rn = 1""")
def latest_event_top500(spark, sf_dir):
    rows = _as_of(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts"), _newest(spark, sf_dir), 48)
    return S.latest_within_newest(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 500).select("user_id", "event_type", "event_id")


@query(f"""WITH latest AS ({LATEST}), moved AS (SELECT *, CASE WHEN user_id % 2 = 1 THEN user_id - 1 ELSE user_id END AS leader FROM latest)
SELECT leader AS user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY leader, event_type ORDER BY ts DESC, (user_id = leader) DESC, user_id) AS r FROM moved) WHERE r = 1""")
def merge_conflict_newest(spark, sf_dir):
    """Odd players are followers of the even one before; the newest row per source stays."""
    latest = _latest(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    leaders = latest.select("user_id").distinct().where("user_id % 2 = 1").withColumn("leader", F.col("user_id") - 1)
    return S.merge_followers(latest, leaders, "user_id", ["event_type"], "ts").select("user_id", "event_type", "event_id")


@query("""SELECT event_id, user_id, CAST(1 + sum(CASE WHEN gap > INTERVAL 3 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS round
FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)""")
def session_rounds(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return S.gap_rounds(rows, "ts", ["event_id"], 3 * 86_400, ["user_id"]).select("event_id", "user_id", "round")


WEEK = """CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-12-31' THEN CAST(greatest(1, least(38,
datediff('day', CAST(date_trunc('week', DATE '2024-01-10') AS DATE), CAST(date_trunc('week', ts) AS DATE)) // 7 + 1)) AS INTEGER) END"""


@query(f"SELECT event_id, {WEEK} AS week FROM events")
def season_week(spark, sf_dir):
    week = N.season_week(F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-12-31").cast("timestamp_ntz"))
    return _events(spark, sf_dir).select("event_id", week.alias("week"))


@query("""SELECT event_id, value > 400 OR event_id % 7 = 0 OR NOT (ts + INTERVAL 12 HOUR > (SELECT max(ts) FROM events)) AS refresh FROM events""")
def ttl_plan(spark, sf_dir):
    rows = _events(spark, sf_dir)
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    expires = F.when(F.col("event_id") % 7 != 0, F.col("ts") + F.expr("interval 12 hours"))
    return rows.select("event_id", N.refresh_plan(expires, now, F.col("value") > 400).alias("refresh"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN value >= 80 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS tone
FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL""")
def json_detail_normalize(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.from_json("props", "k int")["k"].alias("k"), N.tone(F.col("value")).alias("tone"))
    return rows.where("k is not null")


@query(CONSENSUS + """SELECT team, count(*) AS players, count(*) FILTER (p >= 60) AS likely, CAST(sum(p) AS BIGINT) AS total FROM (SELECT team, player,
CAST(floor(sum(CAST(weight AS DOUBLE) * probability) / sum(CAST(weight AS DOUBLE)) + 0.5) AS INTEGER) AS p FROM grid GROUP BY team, player) GROUP BY team""")
def home_summary(spark, sf_dir):
    """Coverage per team."""
    c = _consensus(spark, sf_dir)
    return c.groupBy("team").agg(F.count(F.lit(1)).alias("players"), F.count_if(F.col("probability") >= 60).alias("likely"), F.sum("probability").alias("total"))


def _squads(spark, sf_dir) -> DataFrame:
    kinds = F.array(*map(F.lit, ["POR", "DEF", "MED", "DEL"]), F.lit(None).cast("string"))
    return _consensus(spark, sf_dir).select("team", "player", F.get(kinds, (F.col("player") % 5).cast("int")).alias("position"), "probability", "sources_likely")


@query()
def best_xi(spark, sf_dir):
    """The most probable eleven per team; greedy choices are no SQL, tests compare with hand-worked squads."""
    return lineup.best_eleven(_squads(spark, sf_dir))


@query(CONSENSUS + """SELECT team, concat_ws('-', count(*) FILTER (player % 5 = 1), count(*) FILTER (player % 5 = 2), count(*) FILTER (player % 5 = 3)) AS formation
FROM (SELECT DISTINCT team, player FROM grid) GROUP BY team""")
def formation(spark, sf_dir):
    count = lambda x: F.count_if(F.coalesce(F.col("position") == x, F.lit(False))).cast("string")
    return _squads(spark, sf_dir).groupBy("team").agg(F.concat_ws("-", *map(count, lineup.LINES)).alias("formation"))


@query(CONSENSUS + """, c AS (SELECT team, player, CAST(floor(sum(CAST(weight AS DOUBLE) * probability) / sum(CAST(weight AS DOUBLE)) + 0.5) AS INTEGER) AS p, count(*) AS n FROM grid GROUP BY team, player)
SELECT u.team, u.player, c.p AS probability, CAST(row_number() OVER (PARTITION BY u.team ORDER BY coalesce(c.p, -1) DESC, coalesce(c.n, 0) DESC, u.player) AS INTEGER) AS place
FROM (SELECT DISTINCT user_id % 20 AS team, user_id AS player FROM events) u LEFT JOIN c USING (team, player)""")
def team_page(spark, sf_dir):
    """All players of a team in the page's order: by probability, sources, name; those without a consensus come last."""
    players = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("team"), F.col("user_id").alias("player")).distinct()
    rows = players.join(_consensus(spark, sf_dir), ["team", "player"], "left")
    order = [F.desc(F.coalesce("probability", F.lit(-1))), F.desc(F.coalesce("sources_total", F.lit(0))), F.asc("player")]
    return ordered.placed(rows.select("team", "player", "probability", "sources_total"), ["team"], order).select("team", "player", "probability", "place")
