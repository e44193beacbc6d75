"""What pages show, as one nested row: a team with its players, news and matches; the rounds shown with both elevens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import severity_rank
from .documents import Part, top_lists
from .jobs import shown_rounds
from .lineup import best_eleven
from .state import first_per_key, latest_within_newest

NEWS_HOURS, NEWS_ROWS, NEXT = 48, 500, 5
#: More players than any squad has; the list of a team is bounded by it.
SQUAD = 1000


def home_teams(teams: DataFrame, players: DataFrame, consensus: DataFrame, likely: int = 60) -> DataFrame:
    """teams with players, covered (those with a consensus) and likely; 0 where a team has none."""
    rows = players.select("team", "player").join(consensus.select("player", "probability"), "player", "left")
    counts = rows.groupBy("team").agg(F.count(F.lit(1)).alias("players"), F.count("probability").alias("covered"), F.count_if(F.col("probability") >= likely).alias("likely"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return teams.join(counts, "team", "left").withColumns({c: zero(c) for c in ("players", "covered", "likely")})


def source_status(sources: DataFrame, runs: DataFrame, newest: int = 100) -> DataFrame:
    """sources with status and finished_at of their last run among the newest runs of all sources; null where a source has
    none among these, for then it has been silent for long."""
    last = latest_within_newest(runs, ["source"], [F.desc("finished_at"), F.desc("run")], newest)
    return sources.join(last.select("source", "status", "finished_at"), "source", "left")


def by_source_name(agreement: Column, names: Column, locale: str = "es") -> Column:
    """An array of structs with source in the order of the sources' names, as the locale has it; names: a map."""
    keyed = F.transform(agreement, lambda a: F.struct(F.collate(F.coalesce(F.try_element_at(names, a["source"]), a["source"]), locale).alias("name"), a["source"].alias("source"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda k: k["a"])


def carded(players: DataFrame, verified: DataFrame, cache: DataFrame) -> DataFrame:
    """players with slug and card: what the cache has of the verified slug, null without one. verified: player, slug; cache:
    slug and more; scores that aren't finite numbers are left out."""
    card = F.struct(*(c if c != "scores" else F.filter("scores", lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))).alias("scores") for c in cache.columns)).alias("card")
    cards = cache.select("slug", card)
    return players.join(verified.select("player", F.trim("slug").alias("slug")), "player", "left").join(cards, "slug", "left")


def recent_news(events: DataFrame, now: Column, hours: int = NEWS_HOURS, rows: int = NEWS_ROWS) -> DataFrame:
    """Of each team's newest rows of the last hours the last per player, kind and source name. events: id, team, player,
    event, source_name, recorded_at, and more. The limit comes first, as it does where one team is asked for."""
    recent = events.where(F.col("recorded_at") >= now - F.expr(f"interval {hours} hours"))
    newest = Window.partitionBy("team").orderBy(F.desc("recorded_at"), "id")
    first = recent.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= rows).drop("_rn")
    return first_per_key(first, ["team", "player", "event", "source_name"], [F.desc("recorded_at"), F.col("id")])


def team_pages(teams: DataFrame, players: DataFrame, events: DataFrame, about: DataFrame, matches: DataFrame, now: Column, locale: str = "es") -> DataFrame:
    """A row per team: its columns, formation and coach and set_pieces (about), players (by falling probability, then
    sources, then name; those without a consensus last), news (worst first, then newest) and upcoming (the next five).

    teams: team, ...; players: player, team, name, position, probability, sources_total (null without a consensus), card;
    events: see recent_news, with severity; about: team, formation, coach, set_pieces; matches: match, home, away, stamp."""
    rank = (F.coalesce("probability", F.lit(-1)).desc(), F.coalesce("sources_total", F.lit(0)).desc(), F.collate(F.col("name"), locale), F.col("player"))
    sides = matches.select(F.col("home").alias("team"), *matches.columns).unionByName(matches.select(F.col("away").alias("team"), *matches.columns).where("away != home or home is null"))
    fields = lambda df, *without: tuple(c for c in df.columns if c not in without)
    news = recent_news(events, now)
    parts = {
        "players": Part(players, rank, SQUAD, fields(players, "team")),
        "news": Part(news, (severity_rank(F.col("severity")).desc(), F.col("recorded_at").desc(), F.col("id")), NEWS_ROWS, fields(news, "team")),
        "upcoming": Part(sides.where(F.col("stamp") >= now), (F.col("stamp"), F.col("match")), NEXT, fields(sides, "team")),
    }
    return top_lists(teams.join(about, "team", "left"), "team", parts)


def round_pages(matches: DataFrame, teams: DataFrame, players: DataFrame, now: Column) -> DataFrame:
    """A row per match of the current and the next round, with home and away teams and their elevens (seat, line, player and
    the players' columns, by seat). A side that no team is known of has an empty eleven.

    matches: match, home, away, stamp, round and more; teams: team, ...; players: player, team, position, probability,
    sources_likely and more, such as card. Only teams that play are asked for an eleven."""
    shown = matches.join(shown_rounds(matches.select("match", "stamp", "round"), now).select("match"), "match", "left_semi")
    playing = shown.select(F.col("home").alias("team")).unionByName(shown.select(F.col("away").alias("team"))).where("team is not null").distinct()
    squads = players.join(playing, "team", "left_semi")
    elevens = best_eleven(squads).join(squads, ["team", "player"])
    element = F.struct("seat", "line", "player", *(c for c in players.columns if c not in ("team", "player")))
    lists = elevens.groupBy("team").agg(F.sort_array(F.collect_list(element)).alias("xi"))  # eleven rows at most
    out = shown
    for side in ("home", "away"):
        known = teams.select(F.col("team").alias(side), F.struct(*teams.columns).alias(f"{side}_team"))
        xi = lists.select(F.col("team").alias(side), F.col("xi").alias(f"{side}_xi"))
        out = out.join(known, side, "left").join(xi, side, "left").withColumn(f"{side}_xi", F.coalesce(f"{side}_xi", F.array().cast(xi.schema[f"{side}_xi"].dataType)))
    return out
