"""Queries over ranked search results: parts stand for players, their suppliers for the candidates found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from .registry import registry, table

QUERIES, SQL, query = registry()


def _candidates(spark, sf_dir):
    c = F.col
    words = F.split("p_name", " ")
    last = F.get(words, F.lit(1))
    player = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("local_id"),
        F.when(c("p_partkey") % 5 == 0, F.concat(F.lit("fede "), last)).when(c("p_partkey") % 5 == 1, F.get(words, F.lit(0))).otherwise(c("p_name")).alias("name"),
        F.element_at(F.array(*map(F.lit, ("Real Azul", "Rojo FC", "de la", "Verde Rojo"))), (c("p_partkey") % 4 + 1).cast("int")).alias("team"),
        "p_name",
        last.alias("last"),
    )
    found = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("local_id"), "l_suppkey").distinct().join(player, "local_id")
    said = F.when(c("l_suppkey") % 4 == 0, c("p_name")).when(c("l_suppkey") % 4 == 1, F.concat(F.lit("Federico "), "last")).when(c("l_suppkey") % 4 == 2, F.concat("p_name", F.lit("s júnior"))).otherwise(F.concat("last", F.lit(" x")))
    club = F.when(c("l_suppkey") % 3 == 0, "Azul CF").when(c("l_suppkey") % 3 == 1, "Rojo")
    slug = F.when(c("l_suppkey") % 2 == 0, "verde-club")
    return found.select("local_id", "name", "team", F.format_string("s-%06d", "l_suppkey").alias("slug"), said.alias("display_name"), club.alias("club"), slug.alias("club_slug"))


SCORED = """WITH p AS (SELECT p_partkey AS id, p_name, string_split(p_name, ' ') AS w, p_partkey % 4 AS t FROM part),
x AS (SELECT id, p_name, w[2] AS last, t, CASE id % 5 WHEN 0 THEN ['fede', w[2]] WHEN 1 THEN [w[1]] ELSE w END AS x FROM p),
f AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS s FROM lineitem),
y AS (SELECT id, s, t, x, last, CASE s % 4 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN ['federico', last] WHEN 2 THEN string_split(p_name || 's junior', ' ') ELSE [last] END AS y FROM f JOIN x USING (id)),
d AS (SELECT *, list_filter(y, lambda v: list_contains(x, v) OR (v = 'federico' AND x[1] = 'fede') OR len(list_filter(x, lambda u: 1 - levenshtein(u, v)::DOUBLE / greatest(length(u), length(v)) >= 0.8)) > 0) AS m FROM y),
n AS (SELECT *, CASE WHEN x = y AND s % 4 <> 3 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2.0::DOUBLE * len(m) / (len(x) + len(y)) + CASE WHEN x[-1] = y[-1] THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN len(x) = 1 AND y[1] = x[1] THEN 0.2::DOUBLE ELSE 0 END) END AS name_score,
CASE t WHEN 0 THEN s % 3 = 0 WHEN 1 THEN s % 3 = 1 WHEN 2 THEN false ELSE s % 3 = 1 AND s % 2 = 0 END AS team_match FROM d),
r AS (SELECT id AS local_id, printf('s-%06d', s) AS slug, name_score, team_match, name_score + CASE WHEN team_match THEN 0.2::DOUBLE ELSE 0 END AS score FROM n)"""


@query(f"""{SCORED} SELECT local_id, slug, CAST(floor(1000 * name_score + 0.5) AS BIGINT) AS name_score, team_match, CAST(floor(1000 * score + 0.5) AS BIGINT) AS score FROM r""")
def ranked_candidates(spark, sf_dir):
    """Scores (per mille) of all candidates."""
    mille = lambda name: F.floor(1000 * F.col(name) + 0.5).alias(name)
    return ranking.scored(_candidates(spark, sf_dir)).select("local_id", "slug", mille("name_score"), "team_match", mille("score"))


@query(f"""{SCORED}, k AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM r WINDOW w AS (PARTITION BY local_id ORDER BY score DESC, name_score DESC, slug))
SELECT local_id, slug, team_match, team_match AND ((name_score = 1 AND next IS NULL) OR (name_score >= 0.68 AND score - coalesce(next, 0) >= 0.08)) AS safe FROM k WHERE place = 1""")
def safe_suggestions(spark, sf_dir):
    """The best candidate of each player, and whether it may be taken unseen."""
    return ranking.suggestions(_candidates(spark, sf_dir)).select("local_id", "slug", "team_match", "safe")
