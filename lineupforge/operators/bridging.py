"""The bridge between local players and an external catalogue: rows written from decisions, by hand, from reviews; answers
of searches and what is left of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..sinks.shared import written
from .caching import IDENTITY_HOURS
from .identity import bridge
from .state import first_per_key, upsert

TAKEN = "slug_ya_asignado_a_otro_jugador"
#: Candidates that a row of the bridge keeps.
CANDIDATES = 8
# The shape of a slug that a reviewer writes, and words for passing over.
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)+$"
PASSED = ["skip", "none", "omitir", "-"]


def bridge_rows(decisions: DataFrame, ranked: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """Rows of the bridge from decisions (local_id, slug, external_id, name, confidence, status, method, reason).

    A match to a slug that another row holds goes to review. External id, the verified flag, verification and expiry are
    set only for what stays matched; candidates are the first eight of ranked (local_id, slug, confidence) by falling
    confidence, then slug. held: local_id, slug of the matched so far."""
    rows = bridge(decisions.withColumn("_was", F.col("status")), held)
    lost = (F.col("_was") == "matched") & (F.col("status") != "matched")
    sure = F.col("status") == "matched"
    best = first_candidates(ranked)
    out = rows.join(best, "local_id", "left")
    return out.select(
        "local_id", "slug", F.when(sure, F.col("external_id")).alias("external_id"), "name", "confidence", "status",
        F.when(lost, "review_required").otherwise(F.col("method")).alias("method"), F.when(lost, TAKEN).otherwise(F.col("reason")).alias("reason"), F.coalesce(sure, F.lit(False)).alias("verified"),
        F.when(sure, now).alias("verified_at"), F.when(sure, now + F.expr(f"interval {IDENTITY_HOURS} hours")).alias("expires"),
        F.coalesce("candidates", F.array().cast("array<struct<slug:string,confidence:double>>")).alias("candidates"),
    )


def first_candidates(ranked: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """local_id, candidates: the first of each, best first; Spark keeps so many of a key in each task."""
    place = F.row_number().over(Window.partitionBy("local_id").orderBy(F.desc("confidence"), "slug"))
    first = ranked.where("slug is not null").withColumn("_place", place).where(F.col("_place") <= most)
    listed = F.sort_array(F.collect_list(F.struct("_place", "slug", F.col("confidence").cast("double").alias("confidence"))))
    return first.groupBy("local_id").agg(F.transform(listed, lambda c: F.struct(c["slug"].alias("slug"), c["confidence"].alias("confidence"))).alias("candidates"))


def reviewed_slugs(rows: DataFrame) -> DataFrame:
    """rows whose slug a reviewer wrote as one: trimmed, two words or more of small letters and digits, no word for passing
    over."""
    slug = F.trim("slug")
    return rows.withColumn("slug", slug).where(F.col("slug").rlike(SLUG) & ~F.lower("slug").isin(*PASSED))


def set_by_hand(players: DataFrame, wanted: DataFrame) -> DataFrame:
    """local_id, slug of slugs set by hand (wanted: ord, ref, slug): ref is a player's id or a name that is equal once
    normalised; the first player by ord of a name gets it, and of several slugs for a player the last counts. players:
    local_id, ord, name."""
    ref = F.trim("ref")
    asked = wanted.where((ref != "") & (F.trim("slug") != "")).select("ord", ref.alias("ref"), F.trim("slug").alias("slug"))
    ids = players.select(F.col("local_id").cast("string").alias("ref"), "local_id", F.col("ord").alias("_o"))
    names = players.select(normalize_name(F.col("name")).alias("_name"), "local_id", F.col("ord").alias("_o"))
    by_id = asked.join(ids, "ref")
    by_name = asked.withColumn("_name", normalize_name(F.col("ref"))).join(names, "_name").drop("_name")
    meant = first_per_key(by_id.unionByName(by_name), ["ord"], [F.col("_o")])
    return first_per_key(meant, ["local_id"], [F.desc("ord")]).select("local_id", "slug")


def accepted(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """stored rows (local_id, slug, born, status) after reviews (local_id, slug, decision, exists, club, born): a review
    counts if it says accept, the slug exists, the club fits and the slug is one; its row then has that slug and birth
    date and is matched. Reviews of players who aren't stored change nothing; of several of a player the last slug counts."""
    says = lambda c, word: F.lower(F.trim(c)) == word
    fine = reviews.where(says("decision", "accept") & says("exists", "yes") & says("club", "yes"))
    new = first_per_key(reviewed_slugs(fine), ["local_id"], [F.desc("slug")]).join(stored.select("local_id"), "local_id", "left_semi")
    rows = new.select("local_id", "slug", F.nullif("born", F.lit("")).alias("born"), F.lit("matched").alias("status"))
    return upsert(stored, rows, ["local_id"])


def enriched(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with empty cells of some columns filled from known by key; a cell that says something stays."""
    there = known.select(key, *(F.col(c).alias(f"_k_{c}") for c in columns))
    joined = rows.join(there, key, "left")
    fill = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_k_{c}")).alias(c)
    return joined.select(*(fill(c) if c in columns else F.col(c) for c in rows.columns))


def backfilled(stored: DataFrame, source: DataFrame) -> DataFrame:
    """stored bridge rows (local_id, slug, external) with rows for players of source (local_id, slug) that have none; a row
    that is there stays, but an empty external is filled from its slug."""
    fresh = source.join(stored.select("local_id"), "local_id", "left_anti").select("local_id", "slug", F.lit(None).cast("string").alias("external"))
    rows = stored.select("local_id", "slug", "external").unionByName(fresh)
    return rows.withColumn("external", F.coalesce(F.when(F.col("external") != "", F.col("external")), F.col("slug")))


def last_hits(hits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last hit of each key by order: what a search that finds a thing several times leaves."""
    return first_per_key(hits, key, [F.desc(c) for c in order])


def answered(requests: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """requests with hits, the number of answers that each had: 0 for those that found nothing. Counted, not collected."""
    counts = hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    return requests.join(counts, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def audited(requests: DataFrame, answers: DataFrame, hits: DataFrame) -> DataFrame:
    """slug, status: found or missing where its batch was answered, unknown where the batch failed or never was asked.
    requests: slug, batch; answers: batch, error (null: none); hits: slug."""
    told = requests.join(answers.where("error is null").select("batch").distinct().withColumn("_told", F.lit(True)), "batch", "left")
    seen = told.join(hits.select("slug").distinct().withColumn("_hit", F.lit(True)), "slug", "left")
    return seen.select("slug", F.when(F.col("_told").isNull(), "unknown").when(F.col("_hit"), "found").otherwise("missing").alias("status"))


def unresolved(players: DataFrame, resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """players who aren't resolved, with the candidates of their club. players: local_id, club; resolved: local_id;
    candidates: slug, club."""
    open_ = players.join(resolved.select("local_id"), "local_id", "left_anti")
    return open_.join(candidates, "club")


def dealt(guesses: DataFrame, resolved: DataFrame) -> DataFrame:
    """local_id, slug: players dealt to candidates whose guessed players they are. guesses: slug, turn (order of the
    candidates), local_id, place (order of a candidate's guesses), already of one club.

    One after another, by turn, each candidate takes its first guessed player who isn't resolved or taken. That is
    done for all at once: every candidate without a player asks its first one left, a player who is asked by several
    goes to the earliest, and those he turns down, an earlier choice among them, ask on, until nobody is turned down."""
    left = written(guesses.join(resolved.select("local_id"), "local_id", "left_anti").select("slug", "turn", "local_id", "place").distinct())
    while True:
        asked = first_per_key(left, ["slug"], [F.col("place"), F.col("local_id")])
        held = written(first_per_key(asked, ["local_id"], [F.col("turn"), F.col("slug")]))
        refused = asked.select("slug", "local_id").join(held.select("slug", "local_id"), ["slug", "local_id"], "left_anti")
        rest = written(left.join(refused, ["slug", "local_id"], "left_anti"))
        if rest.count() == left.count():
            return held.select("local_id", "slug")
        left = rest


def verified(rows: DataFrame) -> DataFrame:
    """local_id, slug of matched and verified rows with a slug; of several of a player the last by updated, then slug."""
    fine = rows.where("status = 'matched' and verified and slug is not null")
    return first_per_key(fine, ["local_id"], [F.desc("updated"), F.desc("slug")]).select("local_id", "slug")
