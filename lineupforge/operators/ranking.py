"""Search results ranked by name and club, without birth dates, and the suggestion that is safe to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, edit_similarity, fold_name
from ..sinks.shared import looked_up, written

# First names by the short forms under which players go.
SHORT_FORMS = {
    "fede": "federico", "koke": "sergio", "cuti": "cristian", "tunde": "babatunde",
    "pepelu": "jose luis", "abde": "abdessamad", "chupi": "carlos", "chupe": "carlos",
}


def _tokens(c: Column) -> Column:
    return F.filter(F.split(fold_name(F.coalesce(c, F.lit(""))), " "), lambda t: F.length(t) > 1)


def _long_form(token: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in SHORT_FORMS.items() for v in pair)), token)


def name_score(name: Column, found: Column) -> Column:
    """0 to 1: 1 for names equal once folded; else twice the tokens of found that name has too (as they are, as short or
    long form of a first name, or by an edit similarity of 0.8) over the tokens of both, 0.08 more for the same last token,
    0.2 more where name is one token and found begins with it. Null counts as blank."""
    x, y = _tokens(name), _tokens(found)
    first, last = F.get(x, F.lit(0)), F.try_element_at(x, F.lit(-1))
    known = lambda t: F.array_contains(x, t) | (t == F.coalesce(_long_form(first), first)) | F.array_contains(x, _long_form(t))
    met = F.size(F.filter(y, lambda t: F.coalesce(known(t), F.lit(False)) | F.exists(x, lambda s: edit_similarity(s, t) >= 0.8)))
    dice = F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * met / (F.size(x) + F.size(y)))
    more = lambda fits, by: F.when(fits, by).otherwise(0.0)
    parts = dice + more(F.try_element_at(y, F.lit(-1)) == last, 0.08) + more((F.size(x) == 1) & (F.get(y, F.lit(0)) == first), 0.2)
    same = fold_name(F.coalesce(name, F.lit(""))) == fold_name(F.coalesce(found, F.lit("")))
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), parts))


def plays_for(team: Column, club: Column, slug: Column) -> Column:
    """Whether every telling token of a team (there must be one) stands in a club's name or slug; false for unknown clubs."""
    ours = F.filter(_tokens(team), lambda t: ~t.isin(STOP_WORDS))
    theirs = _tokens(F.concat_ws(" ", club, F.translate(slug, "-", " ")))
    return (F.size(ours) > 0) & (F.size(F.array_except(ours, theirs)) == 0)


def scored(candidates: DataFrame) -> DataFrame:
    """candidates (local_id, name, team, slug, display_name, club, club_slug) with name_score, team_match and score."""
    c = F.col
    # two names or clubs are compared once, however many candidates bring them together
    rows = written(candidates)
    clubs = looked_up(rows, ["team", "club", "club_slug"], rows, team_match=plays_for(c("team"), c("club"), c("club_slug")))
    named = looked_up(clubs, ["name", "display_name"], rows, name_score=name_score(c("name"), c("display_name")))
    return named.select(*candidates.columns, "name_score", "team_match", (c("name_score") + F.when(c("team_match"), 0.2).otherwise(0.0)).alias("score"))


def suggestions(candidates: DataFrame) -> DataFrame:
    """local_id, slug, name_score, team_match, score, safe: each player's best candidate, ties to the smaller slug.

    safe: the club fits, and the name is equal and there is no other candidate, or the name scores 0.68 and the score leads
    the next one by 0.08. Tasks keep two candidates of a player before the exchange."""
    c = F.col
    place = F.row_number().over(Window.partitionBy("local_id").orderBy(F.desc("score"), F.desc("name_score"), "slug"))
    two = scored(candidates).select("local_id", "slug", "name_score", "team_match", "score", place.alias("place")).where("place <= 2")
    one = lambda k: F.max(F.when(c("place") == k, F.struct("slug", "name_score", "team_match", "score")))
    best = two.groupBy("local_id").agg(one(1).alias("b"), one(2).alias("n"))
    alone = c("n").isNull()
    lead = c("b.score") - F.coalesce(c("n.score"), F.lit(0.0))
    safe = c("b.team_match") & (((c("b.name_score") == 1) & alone) | ((c("b.name_score") >= 0.68) & (lead >= 0.08)))
    return best.select("local_id", "b.*", safe.alias("safe"))
