"""Match odds of many bookmakers to one set of percentages per match, and fixtures to rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bound, devig, fair_odds, season_week
from ..functions.text import strip_accents
from .state import gap_rounds

GAP_SECONDS = 3 * 86_400


def club_key(name: Column) -> Column:
    """Lower case without accents and the words cf and fc."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(name)), r"\b(?:cf|fc)\b", ""), r"\s+", " "))


def three_way(home: Column, away: Column, bookmakers: Column, preferred: list[str]) -> Column:
    """A struct of home, draw, away (percentages that sum to 100) and bookmaker, from the first bookmaker by preference,
    then by place, whose first h2h market has three valid prices; null if there is none.

    bookmakers: array of struct<key, title, markets: array of struct<key, outcomes: array of struct<name, price>>>. The
    arrays are a match's own, so nothing is exploded or shuffled."""
    rank = lambda key: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), key), F.lit(0)), F.lit(100))

    def priced(b, i):
        outcomes = F.get(F.filter(b["markets"], lambda m: m["key"] == "h2h"), 0)["outcomes"]
        price = lambda v, test: F.get(F.filter(v, test), 0)["price"].cast("double")
        prices = lambda v: (price(v, lambda o: o["name"] == home).alias("home"), price(v, lambda o: F.lower(o["name"]) == "draw").alias("draw"), price(v, lambda o: o["name"] == away).alias("away"))
        return bound(outcomes, lambda v: F.struct(rank(b["key"]).alias("rank"), i.alias("at"), b["title"].alias("bookmaker"), *prices(v)))

    def shown(best):
        shares = lambda p: F.struct(p["home"].alias("home"), p["draw"].alias("draw"), p["away"].alias("away"), best["bookmaker"].alias("bookmaker"))
        return F.when(best.isNotNull(), bound(devig(best["home"], best["draw"], best["away"]), shares))

    return bound(F.array_min(F.filter(F.transform(bookmakers, priced), lambda x: fair_odds(x["home"], x["draw"], x["away"]))), shown)


def best_lines(lines: DataFrame, by: list[str], preferred: list[str]) -> DataFrame:
    """by, home, draw, away, bookmaker: three_way for feeds with a row per match and bookmaker. Lines with invalid prices
    are dropped where they are, a match keeps its first line by preference, then place, and only that one's percentages
    are computed; matches without one are left out. lines: by, place, key, title, home, draw, away (prices)."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("key")), F.lit(0)), F.lit(100))
    odds = [F.col(c).cast("double") for c in ("home", "draw", "away")]
    rows = lines.where(fair_odds(*odds)).withColumn("_rank", rank)
    best = rows.groupBy(*by).agg(F.min(F.struct("_rank", "place", "title", "home", "draw", "away")).alias("_best"))
    best = best.withColumn("_p", devig(F.col("_best.home"), F.col("_best.draw"), F.col("_best.away")))
    return best.select(*by, "_p.home", "_p.draw", "_p.away", F.col("_best.title").alias("bookmaker"))


def normalized(events: DataFrame, teams: DataFrame, aliases: DataFrame, preferred: list[str], season: tuple[Column, Column], lines: DataFrame | None = None) -> DataFrame:
    """event_id, competition, commence, home_id, away_id, matchday, home, draw, away, bookmaker.

    events: event_id, competition, commence, home_team, away_team, and bookmakers (as three_way has them) unless lines
    (event_id and what best_lines takes) has the odds; teams: slug, team_id; aliases: key, slug. The matchday is the
    season's week, off season the round within the competition by gaps above three days; unknown clubs have a null id.
    Odds and ids are made where an event is, so that only they go on to its competition."""
    ids = aliases.join(teams, "slug").select("key", "team_id")
    rows = events.select("event_id", "competition", "commence", "home_team", "away_team", *([] if lines is not None else ["bookmakers"]))
    if lines is not None:
        rows = rows.join(best_lines(lines, ["event_id"], preferred), "event_id", "left")
    else:
        odds = three_way(F.col("home_team"), F.col("away_team"), F.col("bookmakers"), preferred)
        rows = rows.withColumn("o", odds).select("*", "o.home", "o.draw", "o.away", "o.bookmaker").drop("o", "bookmakers")
    for side in ("home", "away"):
        rows = rows.withColumn("_k", club_key(F.col(f"{side}_team"))).join(ids.select(F.col("key").alias("_k"), F.col("team_id").alias(f"{side}_id")), "_k", "left").drop("_k")
    rows = gap_rounds(rows.drop("home_team", "away_team"), "commence", ["event_id"], GAP_SECONDS, ["competition"])
    matchday = F.coalesce(season_week(F.col("commence"), *season).cast("long"), "round")
    return rows.select("event_id", "competition", "commence", "home_id", "away_id", matchday.alias("matchday"), "home", "draw", "away", "bookmaker")


def first_answer(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Of landed answers (keys, attempt, rows: array, error) the first attempt with rows, else the last error's."""
    full = F.size("rows") > 0
    best = payloads.groupBy(*keys).agg(F.min_by(F.struct("attempt", "rows"), F.when(full, F.col("attempt"))).alias("a"), F.max_by("error", "attempt").alias("last_error"))
    return best.select(*keys, "a.attempt", "a.rows", F.when(F.col("a").isNull(), F.col("last_error")).alias("error"))
