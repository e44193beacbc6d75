"""Caches whose groups of columns expire one by one: what to fetch anew, and how what was fetched goes over what was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import refresh_plan
from .state import _both

# Hours that an identity, scores and prices stay fresh.
IDENTITY_HOURS, SCORES_HOURS, PRICES_HOURS = 7 * 24, 24, 12
GROUPS = ("scores", "classic", "in_season")
ABOUT = ["display_name", "first_name", "last_name", "birth_day", "nationality", "club", "club_slug"]
SCORES = ["scores", "average_score", "latest_score"]


def plan(wanted: DataFrame, cache: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """slug and a boolean per group: whether it must be fetched. cache: slug, <group>_expires; a slug that the cache lacks, and
    a time that is missing or not later than now, need fetching."""
    rows = wanted.select("slug").distinct().join(cache.select("slug", *(f"{g}_expires" for g in GROUPS)), "slug", "left")
    return rows.select("slug", *(refresh_plan(F.col(f"{g}_expires"), now, F.lit(force)).alias(g) for g in GROUPS))


def _hours(now: Column, hours: int) -> Column:
    return now + F.expr(f"interval {hours} hours")


def refreshed(cache: DataFrame, fetched: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    """cache after fetched rows. What is said of the player and the scores are always the new ones; prices are new only in
    the groups that the plan names. Times of a group, updated and expires, move only if the plan names it (for a slug that
    was not there, to now). A fetched row without a plan renews everything.

    cache: slug, the ABOUT and SCORES columns, <edition>_price and <edition>_card, <group>_updated and <group>_expires,
    updated; fetched: slug, ABOUT, SCORES, prices and cards."""
    named = fetched.join(plan.select("slug", *(F.col(g).alias(f"_p_{g}") for g in GROUPS)), "slug", "left")
    empty = [c for c in cache.columns if c not in named.columns]
    delta = named.select("*", *(F.lit(None).cast(cache.schema[c].dataType).alias(c) for c in empty))
    rows = _both(cache, delta.select(*cache.columns), ["slug"]).join(named.select("slug", *(f"_p_{g}" for g in GROUPS)), "slug", "left")
    new = F.coalesce(F.col("_new"), F.lit(False))
    asked = {g: new & F.coalesce(f"_p_{g}", F.lit(True)) for g in GROUPS}
    out = {}
    for c in ABOUT + SCORES:
        out[c] = F.when(new, F.col(f"_n_{c}")).otherwise(F.col(c))
    for g in ("classic", "in_season"):
        for c in (f"{g}_price", f"{g}_card"):
            out[c] = F.when(asked[g], F.col(f"_n_{c}")).otherwise(F.col(c))
    for g, hours in zip(GROUPS, (SCORES_HOURS, PRICES_HOURS, PRICES_HOURS)):
        first = F.when(new, now)  # a row that was not there begins now
        out[f"{g}_updated"] = F.when(asked[g], now).otherwise(F.coalesce(f"{g}_updated", first))
        out[f"{g}_expires"] = F.when(asked[g], _hours(now, hours)).otherwise(F.coalesce(f"{g}_expires", first))
    out["updated"] = F.when(new, now).otherwise(F.col("updated"))
    return rows.select("slug", *(out[c].alias(c) for c in cache.columns if c != "slug"))


def repriced(cache: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """cache after a refresh of prices alone: scores and their times stay as they are; a new slug has none."""
    only = fetched.select("slug").withColumns({"scores": F.lit(False), "classic": F.lit(True), "in_season": F.lit(True)})
    old = cache.select("slug", *(F.col(c).alias(c) for c in SCORES))
    kept = fetched.drop(*SCORES).join(old, "slug", "left").withColumn("scores", F.coalesce("scores", F.array().cast(cache.schema["scores"].dataType)))
    return refreshed(cache, kept, only, now)


def odds_upsert(stored: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """stored odds after a feed: rows of events that the feed no longer has go, if it has any; the feed's rows are new or
    replace those there, captured now either way. stored: event, ..., captured; feed: the same without captured."""
    some = F.broadcast(feed.limit(1).select(F.lit(True).alias("_any")))  # a row, or none for an empty feed
    silent = stored.withColumn("_any", F.lit(True)).join(some, "_any", "left_anti").drop("_any")
    return silent.unionByName(feed.withColumn("captured", now).select(*stored.columns))
