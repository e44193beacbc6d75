"""Queries over names: parts stand for players (p_name, p_brand as team), documents for free text, pages for sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identity, matching, similar
from ..sources import html, pages
from .registry import registry, table

QUERIES, SQL, query = registry()

NORMALIZED = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TOKENS = "list_filter(string_split({0}, ' '), lambda x: length(x) >= 2)"
PAIRS = """SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, a.p_name AS a_name, b.p_name AS b_name, string_split(lower(a.p_name), ' ') AS x, string_split(lower(b.p_name), ' ') AS y
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"""


def _pairs(spark, sf_dir, more=None, **made):
    return similar.name_pairs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", "p_name", more, **made)


@query(f"SELECT doc_id, {NORMALIZED.format('text')} AS name FROM documents")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_name(F.col("text")).alias("name"))


@query(f"SELECT doc_id, CAST(len({TOKENS.format(NORMALIZED.format('text'))}) AS INTEGER) AS n, list_extract({TOKENS.format(NORMALIZED.format('text'))}, 1) AS first FROM documents")
def significant_tokens(spark, sf_dir):
    t = T.significant_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.get(t, 0).alias("first"))


@query(f"""SELECT a_id, b_id, CAST(floor(1000 * 2.0 * len(list_intersect(list_distinct(x), list_distinct(y))) / (len(list_distinct(x)) + len(list_distinct(y))) + 0.5) AS BIGINT) AS dice,
CAST(floor(1000 * 2.0 * len(list_filter(list_distinct(x), lambda s: len(list_filter(y, lambda t: starts_with(s, t) OR starts_with(t, s))) > 0)) / (len(list_distinct(x)) + len(list_distinct(y))) + 0.5) AS BIGINT) AS prefix,
CAST(floor(1000 * CASE WHEN a_name = b_name THEN 1.0 ELSE 1.0 - CAST(levenshtein(a_name, b_name) AS DOUBLE) / greatest(length(a_name), length(b_name)) END + 0.5) AS BIGINT) AS edit,
concat_ws('/', len(list_intersect(list_distinct(x), list_distinct(y))), greatest(len(list_distinct(x)), len(list_distinct(y)))) AS overlap FROM ({PAIRS})""")
def name_similarity(spark, sf_dir):
    """Dice, prefix Dice, edit similarity (per mille) and overlap of names within brand and size."""
    mille = lambda c: F.floor(1000 * c + 0.5)
    a, b = F.col("a_name"), F.col("b_name")
    x, y = T.all_tokens(a), T.all_tokens(b)
    rows = _pairs(spark, sf_dir, dice=mille(T.token_dice(x, y)), prefix=mille(T.prefix_dice(x, y)), edit=mille(T.edit_similarity(a, b)), overlap=T.overlap_label(x, y))
    return rows.select(F.col("a_p_partkey").alias("a_id"), F.col("b_p_partkey").alias("b_id"), "dice", "prefix", "edit", "overlap")


@query("""SELECT p_partkey, upper(left(string_split(p_name, ' ')[1], 1) || coalesce(left(string_split(p_name, ' ')[2], 1), '')) AS initials,
'match-' || replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_brand), '#', '-') AS anchor FROM part""")
def labels_of_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.initials(F.col("p_name")).alias("initials"), T.anchor_id(F.col("p_name"), F.col("p_brand")).alias("anchor"))


@query("""SELECT p_partkey, variant FROM (SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS variant FROM part UNION SELECT p_partkey, lower(string_split(p_name, ' ')[1]) FROM part
UNION SELECT p_partkey, lower(string_split(p_name, ' ')[2]) FROM part) WHERE length(variant) >= 3""")
def slug_variants(spark, sf_dir):
    """Slugs to probe per name, one row each (names here have two tokens)."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.slug_variants(F.col("p_name"))).alias("variant"))


def _cases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    roster = p.where("p_partkey % 3 != 0").select(F.col("p_brand").alias("team"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("player"), F.col("p_name").alias("name"))
    last = F.element_at(F.split("p_name", " "), -1)
    raw = F.when(F.col("p_partkey") % 2 == 0, last).otherwise(F.col("p_name"))
    return p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("team"), F.col("p_partkey").alias("case_id"), raw.alias("raw")), roster


MATCH = """WITH cases AS (SELECT p_brand AS team, p_partkey AS case_id, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[2] ELSE p_name END AS raw, p_partkey % 2 = 0 AS lone FROM part WHERE p_partkey % 3 = 0),
roster AS (SELECT p_brand AS team, p_partkey AS ord, p_name AS name, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[2] AS l FROM part WHERE p_partkey % 3 <> 0),
lone AS (SELECT c.team, c.case_id, count(r.ord) AS hits, min(r.ord) AS player FROM cases c LEFT JOIN roster r ON r.team = c.team AND r.l = c.raw WHERE c.lone GROUP BY 1, 2),
single AS (SELECT c.team, c.case_id, min(CASE WHEN r.f = c.raw THEN r.ord END) AS player FROM cases c JOIN roster r ON r.team = c.team JOIN lone o ON o.case_id = c.case_id AND o.hits = 0 WHERE c.lone GROUP BY 1, 2),
full_ AS (SELECT c.team, c.case_id, min(CASE WHEN r.name = c.raw THEN r.ord END) AS player FROM cases c JOIN roster r ON r.team = c.team WHERE NOT c.lone GROUP BY 1, 2),
found AS (SELECT team, case_id, player, 'last-name-unique' AS rule, 850 AS confidence FROM lone WHERE hits = 1 UNION ALL SELECT team, case_id, player, 'subset-inverse', 800 FROM single WHERE player IS NOT NULL
UNION ALL SELECT team, case_id, player, 'exact', 1000 FROM full_ WHERE player IS NOT NULL) """


@query(MATCH + "SELECT case_id, player, rule, CAST(confidence AS BIGINT) AS confidence FROM found")
def roster_match(spark, sf_dir):
    """Names of every third part against the others of its brand."""
    cases, roster = _cases(spark, sf_dir)
    return matching.match_roster(cases, roster).select("case_id", "player", "rule", F.floor(F.col("confidence") * 1000 + 0.5).alias("confidence"))


@query(MATCH + "SELECT case_id, raw FROM cases WHERE case_id NOT IN (SELECT case_id FROM found)")
def unmatched_names(spark, sf_dir):
    cases, roster = _cases(spark, sf_dir)
    return matching.unmatched(cases, matching.match_roster(cases, roster)).select("case_id", "raw")


def _clubs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("team"), F.col("p_partkey").alias("ord"), "p_name")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND lower(a.p_name) = lower(b.p_name) AND a.p_partkey < b.p_partkey")
def duplicate_pairs(spark, sf_dir):
    return matching.duplicate_pairs(_clubs(spark, sf_dir), T.normalize_name(F.col("p_name"))).select("a", "b")


@query("""SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_size, lower(p_name)) AS leader FROM part
QUALIFY count(*) OVER (PARTITION BY p_brand, p_size, lower(p_name)) > 1""")
def duplicate_clusters(spark, sf_dir):
    """Connected components of duplicates with their leader; equal names need a link each, not all their pairs."""
    return matching.clusters(matching.duplicate_links(_clubs(spark, sf_dir), T.normalize_name(F.col("p_name")))).select("node", "leader")


@query("""WITH c AS (SELECT l_partkey AS local_id, 's' || l_suppkey AS slug, max(l_quantity) / 50.0 AS name_score, max(l_linenumber) % 2 = 0 AS team, max(l_suppkey) % 3 = 0 AS dob, max(l_suppkey) % 5 = 0 AS nat FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, least(1.0, 0.55::DOUBLE * least(name_score, 1.0) + 0.25::DOUBLE * team::INT + 0.25::DOUBLE * dob::INT + 0.05::DOUBLE * nat::INT) AS confidence FROM c),
r AS (SELECT *, row_number() OVER w AS rn, lead(confidence) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY local_id ORDER BY confidence DESC, name_score DESC, slug))
SELECT local_id, slug, CAST(floor(confidence * 1000 + 0.5) AS BIGINT) AS confidence, CASE WHEN ((dob AND name_score >= 0.45) OR (team AND name_score >= 1 AND dob) OR (team AND name_score >= 0.72 AND confidence - coalesce(nxt, 0) >= 0.15::DOUBLE)) AND confidence - coalesce(nxt, 0) >= 0.08::DOUBLE
THEN 'matched' ELSE 'manual_review' END AS status FROM r WHERE rn = 1""")
def identity_decision(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("local_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("slug")).agg(
        (F.max("l_quantity") / 50.0).alias("name_score"), (F.max("l_linenumber") % 2 == 0).alias("team"), (F.max("l_suppkey") % 3 == 0).alias("dob"), (F.max("l_suppkey") % 5 == 0).alias("nat")
    )
    return identity.decide(rows).drop("reason")


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def page_title_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    count = F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long")
    return pages.select("page_id", count.alias("links"), html.title(F.col("html")).alias("title"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.clean_text(F.col("html")).alias("text"))


@query(MATCH + """SELECT c.case_id, r.ord AS player, CASE WHEN c.lone THEN 'last-name-unique' ELSE 'exact' END AS rule, CAST(CASE WHEN c.lone THEN 850 ELSE 1000 END AS BIGINT) AS confidence
FROM cases c JOIN roster r ON r.team = c.team AND CASE WHEN c.lone THEN r.l = c.raw ELSE r.name = c.raw END""")
def near_misses(spark, sf_dir):
    """All roster rows that a name comes near to, whether or not one is chosen."""
    cases, roster = _cases(spark, sf_dir)
    return matching.near_misses(cases, roster).select("case_id", "player", "rule", F.floor(F.col("confidence") * 1000 + 0.5).alias("confidence"))


@query(MATCH + "SELECT c.case_id, r.ord AS player FROM cases c JOIN roster r ON r.team = c.team AND r.l = c.raw WHERE c.lone")
def near_miss_band(spark, sf_dir):
    """Near misses of 0.55 to 0.85, for review."""
    cases, roster = _cases(spark, sf_dir)
    return matching.near_misses(cases, roster, 0.55, 0.85).select("case_id", "player")


@query(f"""SELECT a_id, b_id, kind, same FROM (SELECT a_id, b_id, CASE WHEN a.p_type = b.p_type THEN 'same_slug' WHEN a_name = b_name THEN 'same_name' END AS kind, a_name = b_name AS same
FROM ({PAIRS}) JOIN part a ON a.p_partkey = a_id JOIN part b ON b.p_partkey = b_id)""")
def duplicate_kinds(spark, sf_dir):
    """What makes two names of a team one player, if anything (the type stands for the slug)."""
    a, b, none = F.col("a_name"), F.col("b_name"), F.lit("")
    rows = _pairs(spark, sf_dir, "p_type", by_name=identity.duplicate_kind(a, b, none, none), same=matching.same_player(a, b))
    one = (F.col("a_p_type") != "") & (F.col("a_p_type") == F.col("b_p_type"))
    return rows.select(F.col("a_p_partkey").alias("a_id"), F.col("b_p_partkey").alias("b_id"), F.when(one, "same_slug").otherwise(F.col("by_name")).alias("kind"), "same")


EVIDENCE = """SELECT l_partkey AS local_id, 's' || l_suppkey AS slug, max(l_quantity) / 50.0::DOUBLE AS name_score, max(l_linenumber) % 2 = 0 AS club, max(l_suppkey) % 3 = 0 AS dob, max(l_suppkey) % 5 = 0 AS nat,
max(l_suppkey) % 4 = 0 AS exact, max(l_suppkey) AS ord FROM lineitem GROUP BY 1, 2"""


def _evidence(spark, sf_dir):
    of = F.max("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("local_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("slug")).agg(
        (F.max("l_quantity") / 50.0).alias("name_score"), (F.max("l_linenumber") % 2 == 0).alias("club"), (of % 3 == 0).alias("dob"), (of % 5 == 0).alias("nat"), (of % 4 == 0).alias("exact"), of.alias("ord"))


PROBE = f"""SELECT local_id, slug, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS confidence, CASE WHEN (exact AND name_score >= 0.4) OR name_score >= 0.7 THEN 'matched' ELSE 'manual_review' END AS status,
CASE WHEN exact AND name_score >= 0.4 THEN 'exact' WHEN name_score >= 0.7 THEN 'name' ELSE 'weak' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY local_id ORDER BY score DESC, ord, slug) AS rn
FROM (SELECT *, CASE WHEN exact THEN 0.6::DOUBLE + 0.4::DOUBLE * name_score ELSE 0.5::DOUBLE * name_score END AS score FROM ({EVIDENCE}))) WHERE rn = 1"""


@query(PROBE)
def slug_probe(spark, sf_dir):
    """The best candidate behind generated slugs."""
    return identity.probe(_evidence(spark, sf_dir))


@query(f"""WITH d AS ({PROBE}), held AS (SELECT 's' || s_suppkey AS slug, s_suppkey AS local_id FROM supplier WHERE s_acctbal > 5000)
SELECT local_id, d.slug, CASE WHEN status = 'matched' AND (EXISTS (SELECT 1 FROM held h WHERE h.slug = d.slug AND h.local_id <> d.local_id) OR row_number() OVER (PARTITION BY d.slug, status ORDER BY local_id) > 1) THEN 'manual_review' ELSE status END AS status FROM d""")
def bridge_upsert(spark, sf_dir):
    """Decisions as they may be written: a slug has one holder."""
    held = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_suppkey").alias("local_id"))
    return identity.bridge(slug_probe(spark, sf_dir).select("local_id", "slug", "status"), held)


@query(f"""SELECT local_id, kind, CASE WHEN kind <> 'weak' THEN slug END AS slug, CASE WHEN kind = 'verified' THEN round(least(0.99::DOUBLE, 0.7::DOUBLE + 0.2::DOUBLE * dob::INT + 0.05::DOUBLE * club::INT + 0.04::DOUBLE * nat::INT), 2) END AS confidence FROM (
SELECT *, CASE WHEN NOT ok THEN 'weak' WHEN nxt >= total - 0.1::DOUBLE THEN 'ambiguous' ELSE 'verified' END AS kind FROM (SELECT *, row_number() OVER w AS rn, lead(total) OVER w AS nxt FROM (
SELECT *, CASE WHEN ok THEN name_score + 0.3::DOUBLE * dob::INT + 0.15::DOUBLE * club::INT + 0.1::DOUBLE * nat::INT END AS total FROM (SELECT *, (dob AND name_score >= 0.5) OR (club AND name_score >= 0.7) OR name_score >= 0.9 AS ok FROM ({EVIDENCE})))
WINDOW w AS (PARTITION BY local_id ORDER BY total DESC NULLS LAST, slug)) WHERE rn = 1)""")
def research_kinds(spark, sf_dir):
    """Verified, ambiguous or weak, from all candidates of a search."""
    return identity.research(_evidence(spark, sf_dir))


@query(f"SELECT local_id, min(slug) AS slug FROM ({EVIDENCE}) WHERE name_score >= 1 AND club GROUP BY local_id HAVING count(DISTINCT slug) = 1")
def unique_candidates(spark, sf_dir):
    """Names with exactly one candidate of the full name and club."""
    return identity.unique_candidate(_evidence(spark, sf_dir).withColumnRenamed("club", "team"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'no_decision' WHEN s_suppkey IS NULL THEN 'slug_not_found' WHEN s_acctbal < 0 THEN 'club_mismatch' ELSE 'verified' END AS status
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def mapping_audit(spark, sf_dir):
    """What an audit says of each mapping."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    slug, club = F.when(F.col("p_size") % 4 == 0, " ").otherwise("s"), F.when(F.col("s_acctbal") < 0, False)
    return part.join(supplier, F.col("s_suppkey") == F.col("p_partkey"), "left").select("p_partkey", identity.audit_status(slug, F.col("s_suppkey").isNotNull(), club).alias("status"))


@query("""SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS at, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)""")
def page_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"))


@query("""SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS ord, unnest(x) AS href, nullif(trim(unnest(y)), '') AS name FROM (
SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)', 1) AS x, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)', 2) AS y FROM pages)""")
def page_menu(spark, sf_dir):
    """A page cut at its list items: each one's link and name."""
    link, p = r"<a\b[^<>]*>", F.col("piece")
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(pages.pieces(F.col("html"), r"<li>")).alias("ord", "piece"))
    return rows.select("page_id", "ord", pages.attribute(p, link, "href").alias("href"), pages.short(p, link).alias("name"))
