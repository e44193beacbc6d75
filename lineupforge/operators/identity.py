"""Linking local players to an external catalogue: weighted evidence, margins, and an explainable decision."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_tokens, bare_name_tokens, compared_tokens, edit_similarity, list_dice, normalize_name, plain_tokens, prefix_dice, strip_marks, token_dice
from ..sinks.shared import looked_up, written
from .state import first_per_key


def decide(candidates: DataFrame) -> DataFrame:
    """local_id, slug, confidence (per mille, rounded only here), status, reason from rows of local_id, slug, name_score, team, dob, nat
    (booleans; null is false) and, if there, no_dob: the local row has no birth date.

    The best candidate is matched if identity is high (birth date with half a name, club with a full name and no other
    birth date, or club with a good name and a clear margin) and it leads the runner-up by 0.08; otherwise it goes to
    manual review. Rows without a slug stand for a search without candidates: not_found."""
    return _decide(candidates)


def points(candidates: DataFrame) -> Column:
    """The confidence of a candidate, 0 to 1."""
    holds = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("double")
    sum_ = 0.55 * F.least(F.col("name_score"), F.lit(1.0)) + 0.25 * holds("team") + 0.25 * holds("dob") + 0.05 * holds("nat")
    return F.least(F.lit(1.0), F.coalesce(sum_, F.lit(0.0)))


def _decide(candidates: DataFrame, *more: str) -> DataFrame:
    c = F.col
    holds = lambda name: F.coalesce(c(name), F.lit(False))
    free = holds("no_dob") if "no_dob" in candidates.columns else F.lit(False)
    scored = candidates.withColumn("confidence", F.when(c("slug").isNotNull(), points(candidates)))
    w = Window.partitionBy("local_id").orderBy(F.desc("confidence"), F.desc("name_score"), "slug")
    ranked = scored.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("confidence").over(w)).where("rn = 1")
    margin = F.when(c("next").isNull(), c("confidence")).otherwise(c("confidence") - c("next"))
    high = (holds("dob") & (c("name_score") >= 0.45)) | (holds("team") & (c("name_score") >= 1) & (holds("dob") | free)) | (holds("team") & (c("name_score") >= 0.72) & (margin >= 0.15))
    matched = F.coalesce(high & (margin >= 0.08), F.lit(False))
    status = F.when(c("slug").isNull(), "not_found").when(matched, "matched").otherwise("manual_review")
    reason = F.when(c("slug").isNull(), "no_candidates").when(matched, "enough_evidence").when(~holds("team"), "club_differs_or_unknown").when(margin < 0.08, "ambiguous_candidates").otherwise("weak_identity")
    return ranked.select("local_id", "slug", F.floor(c("confidence") * 1000 + 0.5).alias("confidence"), status.alias("status"), reason.alias("reason"), *more)


def decisions(local: DataFrame, candidates: DataFrame) -> DataFrame:
    """decide() on the evidence of local rows and candidates (see evidence), with method: what a match rests on, none where
    nothing was found, review_required otherwise."""
    return decided(evidence(local, candidates))


# What a match may rest on, in the order asked for.
METHODS = ["name_club_birth_day", "name_birth_day", "exact_name_club", "name_club_unique_margin"]


def decided(found: DataFrame) -> DataFrame:
    """decisions() from evidence that is there. What a match rests on comes along with its row, in one exchange by local row,
    as a number, since both sorts hold it for every row."""
    each = Window.partitionBy("local_id", "slug")
    holds = lambda name: F.coalesce(name, F.lit(False))
    rests = F.when(holds("dob"), F.when(holds("team"), 0).otherwise(1)).when(F.col("name_score") >= 1, 2).otherwise(3)
    rows = _decide(found.repartition("local_id").withColumn("_kept", F.max_by(rests, "name_score").over(each)), "_kept")
    by = F.coalesce(F.get(F.array(*map(F.lit, METHODS)), F.col("_kept")), F.lit(METHODS[-1]))
    method = F.when(F.col("status") == "not_found", "none").when(F.col("status") == "matched", by).otherwise("review_required")
    return rows.select("local_id", "slug", "confidence", "status", method.alias("method"), "reason")


def probed(local: DataFrame, candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """probe() on candidates found under generated slugs: local_id, slug, confidence, status, method; a local row without
    candidates is not_found. variants: local_id, slug as generated; candidates as in evidence, with ord if they have an order."""
    order = F.col("ord") if "ord" in candidates.columns else F.lit(0)
    made = variants.select("local_id", "slug", F.lit(True).alias("exact")).distinct()
    scored = local.select("local_id", "name").join(candidates.select("local_id", "slug", "display", F.trim(F.concat_ws(" ", "first", "last")).alias("full"), order.alias("ord")), "local_id")
    rows = scored.join(made, ["local_id", "slug"], "left").select("local_id", "slug", "ord", "exact", name_score(F.col("name"), F.col("display"), F.col("full")).alias("name_score"))
    best = probe(rows)
    out = local.select("local_id").distinct().join(best, "local_id", "left")
    return out.select("local_id", "slug", "confidence", F.coalesce("status", F.lit("not_found")).alias("status"), F.coalesce("method", F.lit("none")).alias("method"))


# Clubs by the names under which they go, asked in this order.
CLUBS = {
    "alaves": ["alaves", "deportivo alaves"], "athletic-bilbao": ["athletic bilbao", "athletic club", "athletic"],
    "atletico-madrid": ["atletico madrid", "atletico de madrid"], "barcelona": ["barcelona", "fc barcelona"],
    "betis": ["real betis", "betis"], "celta-vigo": ["celta vigo", "real club celta"],
    "deportivo": ["deportivo coruna", "deportivo la coruna"], "espanyol": ["espanyol", "rcd espanyol"], "getafe": ["getafe"],
    "girona": ["girona"], "las-palmas": ["las palmas", "union deportiva las palmas"], "levante": ["levante"],
    "mallorca": ["mallorca", "real mallorca"], "osasuna": ["osasuna"], "rayo-vallecano": ["rayo vallecano"],
    "real-madrid": ["real madrid"], "real-sociedad": ["real sociedad"], "sevilla": ["sevilla"], "valencia": ["valencia"],
    "villarreal": ["villarreal"],
}


def club_key(name: Column) -> Column:
    """The club that a name speaks of, or null."""
    # bound once: as a plain expression the name would be normalised anew for each of the names it is compared with
    said = lambda bare: F.coalesce(*(F.when(reduce(or_, (bare.contains(n) for n in names)), F.lit(key)) for key, names in CLUBS.items()))
    return F.get(F.transform(F.array(normalize_name(F.coalesce(name, F.lit("")))), said), 0)


def _club(name: Column) -> Column:
    """What same_club compares of a name: its key and its words."""
    return F.struct(club_key(name).alias("key"), F.array_distinct(plain_tokens(name)).alias("words"))


def _one_club(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x["words"], y["words"]))
    return F.coalesce(x["key"] == y["key"], (shared > 0) & (shared >= F.least(F.lit(2), F.size(x["words"]))))


def same_club(local: Column, remote: Column) -> Column:
    """Whether two club names mean one club: by their keys where both have one, else by two common words (or the only one)."""
    return _one_club(_club(local), _club(remote))


# Words that don't tell clubs apart in a search.
CLUB_NOISE = ["cf", "ud", "rc", "cd", "fc", "ca", "ac", "ad", "club", "de", "la", "el", "il", "al", "sd"]


def bare_club(name: Column) -> Column:
    """Lower case without marks and without the words that clubs share."""
    words = F.filter(F.split(strip_marks(F.lower(F.coalesce(name, F.lit("")))), r"\s+"), lambda w: (w != "") & ~w.isin(CLUB_NOISE))
    return F.array_join(words, " ")


def clubs_alike(a: Column, b: Column) -> Column:
    """Whether one bare club name holds the other; false where either is empty."""
    x, y = bare_club(a), bare_club(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def searched(local: DataFrame, hits: DataFrame) -> DataFrame:
    """What research() asks for. local: local_id, name, team, born, nationality; hits: local_id, slug, display, club, born,
    nationality. Names are compared with list_dice, clubs with clubs_alike; nations by their letters."""
    c = F.col
    letters = lambda x: F.nullif(F.regexp_replace(strip_marks(F.upper(F.coalesce(x, F.lit("")))), "[^A-Z]", ""), F.lit(""))
    day = lambda x: F.substring(x.cast("string"), 1, 10)
    theirs = hits.select("local_id", "slug", "display", c("club").alias("_club"), c("born").alias("_born"), c("nationality").alias("_nation"))
    both = written(local.join(theirs, "local_id").select("local_id", "slug", "name", "display", c("team").alias("_team"), "_club", (day(c("born")) == day(c("_born"))).alias("dob"), "nationality", "_nation"))
    # as in evidence: once per two clubs, nations or names
    clubs = looked_up(both, ["_team", "_club"], both, club=clubs_alike(c("_team"), c("_club")))
    nations = looked_up(clubs, ["nationality", "_nation"], both, nat=letters(c("nationality")) == letters(c("_nation")))
    named = looked_up(nations, ["name", "display"], both, name_score=list_dice(compared_tokens(c("name")), compared_tokens(c("display"))))
    return named.select("local_id", "slug", "name_score", "club", "dob", "nat")


def _bare(name: Column) -> Column:
    return normalize_name(F.coalesce(name, F.lit("")))


def _name(bare: Column) -> Column:
    """What name_score compares of a normalised name: the name and its tokens."""
    return F.struct(bare.alias("whole"), bare_name_tokens(bare).alias("tokens"))


def _score(own: Column, display: Column, full: Column) -> Column:
    same = lambda c: (own["whole"] != "") & (own["whole"] == c["whole"])
    near = [f(own["tokens"], c["tokens"]) for f in (token_dice, prefix_dice) for c in (display, full)]
    return F.when(same(display) | same(full), 1.0).otherwise(F.greatest(*near))


def name_score(local: Column, display: Column, full: Column, read: bool = False) -> Column:
    """1 if a name is the display name or the full name, else the best of Dice and prefix Dice with either. read: these are
    columns of what _name makes of the names."""
    return _score(local, display, full) if read else _score(*(_name(_bare(n)) for n in (local, display, full)))


def with_name_score(rows: DataFrame, local: Column, display: Column, full: Column) -> DataFrame:
    """rows with name_score, made once for every three distinct names."""
    own = written(rows.withColumns({"_local": local, "_display": display, "_full": full}))
    made = name_score(F.col("_local"), F.col("_display"), F.col("_full"))
    return looked_up(own, ["_local", "_display", "_full"], name_score=made).drop("_local", "_display", "_full")


def evidence(local: DataFrame, candidates: DataFrame) -> DataFrame:
    """What decide() asks for. local: local_id, name, team, born, nationality; candidates: local_id, slug, display, first,
    last, club, club_slug, born, nationality. A local row without candidates has one row without a slug."""
    c = F.col
    day = lambda x: F.substring(x.cast("string"), 1, 10)
    nation = lambda x: F.nullif(normalize_name(x), F.lit(""))
    ours = local.select("local_id", _bare(c("name")).alias("name"), c("team").alias("our_team"), day(c("born")).alias("our_day"), c("nationality").alias("our_nation"), (F.coalesce(c("born").cast("string"), F.lit("")) == "").alias("no_dob"))
    full = F.trim(F.concat_ws(" ", "first", "last"))
    theirs = candidates.select("local_id", "slug", _bare(c("display")).alias("display"), _bare(full).alias("full"), F.concat_ws(" ", "club", "club_slug").alias("club"), day(c("born")).alias("their_day"), c("nationality").alias("their_nation"))
    met = ours.join(theirs.withColumn("there", F.lit(True)), "local_id", "left")
    # names are normalised on their own side and compared where the rows meet: looked up, all rows would be shuffled by their names
    score = F.when(c("there"), name_score(c("name"), c("display"), c("full"), read=True))
    met = met.withColumns({n: _name(c(n)) for n in ("name", "display", "full")})
    both = written(met.select("local_id", "slug", "there", score.alias("name_score"), (c("our_day") == c("their_day")).alias("dob"), "no_dob", "our_team", "club", "our_nation", "their_nation"))
    # two clubs or nations are compared once, however many rows bring them together
    clubs = looked_up(both, ["there", "our_team", "club"], both, same_club=F.when(c("there"), same_club(c("our_team"), c("club"))))
    nations = looked_up(clubs, ["our_nation", "their_nation"], both, nat=nation(c("our_nation")) == nation(c("their_nation")))
    return nations.select("local_id", "slug", "name_score", c("same_club").alias("team"), "dob", "nat", "no_dob")


def probe(candidates: DataFrame) -> DataFrame:
    """local_id, slug, confidence (per mille), status, method from rows of local_id, slug, ord, exact, name_score.

    A slug that was generated from the local name counts 0.6 plus 0.4 of the name, another half the name; the first of
    the highest wins, and is matched if its slug is exact and the name at least 0.4, or the name at least 0.7."""
    exact, name = F.coalesce(F.col("exact"), F.lit(False)), F.coalesce(F.col("name_score"), F.lit(0.0))
    scored = candidates.where("slug is not null").select("local_id", "slug", "ord", exact.alias("exact"), name.alias("name_score"), F.when(exact, 0.6 + 0.4 * name).otherwise(0.5 * name).alias("score"))
    best = first_per_key(scored, ["local_id"], [F.desc("score"), F.col("ord"), F.col("slug")])
    method = F.when(F.col("exact") & (F.col("name_score") >= 0.4), "exact").when(F.col("name_score") >= 0.7, "name").otherwise("weak")
    return best.select("local_id", "slug", F.floor(F.col("score") * 1000 + 0.5).alias("confidence"), F.when(method == "weak", "manual_review").otherwise("matched").alias("status"), method.alias("method"))


def research(candidates: DataFrame) -> DataFrame:
    """local_id, kind (verified, ambiguous, weak), slug, confidence (only if verified) from rows of local_id, slug,
    name_score, club, dob, nat. Plausible are birth date with half a name, club with 0.7 of it, or 0.9 of it alone; two
    plausible ones within 0.1 are ambiguous. Verified without a slug stays unresolved."""
    holds = lambda name: F.coalesce(F.col(name), F.lit(False))
    name = F.coalesce(F.col("name_score"), F.lit(0.0))
    plausible = (holds("dob") & (name >= 0.5)) | (holds("club") & (name >= 0.7)) | (name >= 0.9)
    total = name + F.when(holds("dob"), 0.3).otherwise(0.0) + F.when(holds("club"), 0.15).otherwise(0.0) + F.when(holds("nat"), 0.1).otherwise(0.0)
    rows = candidates.withColumns({"_ok": plausible, "_total": F.when(plausible, total)})
    w = Window.partitionBy("local_id").orderBy(F.desc_nulls_last("_total"), "slug")
    top = rows.withColumns({"_rn": F.row_number().over(w), "_next": F.lead("_total").over(w)}).where("_rn = 1")
    kind = F.when(~F.col("_ok"), "weak").when(F.col("_next") >= F.col("_total") - 0.1, "ambiguous").otherwise("verified")
    sure = F.least(F.lit(0.99), 0.7 + F.when(holds("dob"), 0.2).otherwise(0.0) + F.when(holds("club"), 0.05).otherwise(0.0) + F.when(holds("nat"), 0.04).otherwise(0.0))
    return top.select("local_id", kind.alias("kind"), F.when(kind != "weak", F.col("slug")).alias("slug"), F.when((kind == "verified") & F.col("slug").isNotNull(), F.round(sure, 2)).alias("confidence"))


def bridge(decisions: DataFrame, held: DataFrame) -> DataFrame:
    """decisions (local_id, slug, status, ...) in which a match to a slug that another row holds goes to manual review.
    held: local_id, slug of the matched so far. Within decisions, the smallest local_id keeps a slug."""
    taken = held.groupBy("slug").agg(F.min("local_id").alias("_low"), F.max("local_id").alias("_high"))
    rows = decisions.join(taken, "slug", "left")
    other = F.coalesce((F.col("_low") != F.col("local_id")) | (F.col("_high") != F.col("local_id")), F.lit(False))
    first = F.row_number().over(Window.partitionBy("slug", "status").orderBy("local_id"))
    clash = (F.col("status") == "matched") & (other | (first > 1))
    return rows.withColumn("status", F.when(clash, "manual_review").otherwise(F.col("status"))).select(*decisions.columns)


def unique_candidate(candidates: DataFrame) -> DataFrame:
    """local_id, slug where exactly one distinct candidate has the full name and the club."""
    exact = candidates.where("name_score >= 1 and team")
    return exact.groupBy("local_id").agg(F.min("slug").alias("slug"), F.countDistinct("slug").alias("_n")).where("_n = 1").drop("_n")


def audit_status(slug: Column, found: Column, club: Column) -> Column:
    """What an audit says of a mapping: club is true, false, or null where it isn't known."""
    blank = F.coalesce(F.trim(slug) == "", F.lit(True))
    return F.when(blank, "no_decision").when(~F.coalesce(found, F.lit(False)), "slug_not_found").when(F.coalesce(~club, F.lit(False)), "club_mismatch").otherwise("verified")


def duplicate_kind(a: Column, b: Column, slug_a: Column, slug_b: Column) -> Column:
    """How likely two names (of one team) are one player, or null: the same slug, the same tokens but for initials, an
    initial with the same last name, or a near last name after the same beginning."""
    x, y = all_tokens(a), all_tokens(b)
    long = lambda t: F.array_join(F.filter(t, lambda w: F.length(w) > 1), " ")
    last = lambda t: F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))
    first_two = F.size(F.filter(F.slice(x, 1, 2), lambda w: F.array_contains(F.slice(y, 1, 2), w)))
    initial = (F.coalesce(F.length(F.get(x, 0)), F.lit(0)) == 1) | (F.coalesce(F.length(F.get(y, 0)), F.lit(0)) == 1)
    return (
        F.when((slug_a != "") & (slug_a == slug_b), "same_slug")
        .when(long(x) == long(y), "same_name")
        .when((last(x) == last(y)) & initial, "initial")
        .when((first_two >= 2) & (edit_similarity(last(x), last(y)) >= 0.75), "typo_or_compound")
    )
