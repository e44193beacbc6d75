"""The weighted consensus over sources, in which silence of a source that covers a team counts as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus(forecasts: DataFrame, sources: DataFrame, likely: int = 60) -> DataFrame:
    """player, team, probability, sources_likely, sources_total, agreement.

    forecasts: fresh rows of player, team, source, probability (one per player and source); sources: source, weight.
    All sources with a row for the team are in the denominator; players without any row get none."""
    covering = forecasts.select("team", "source").distinct().join(sources, "source")
    players = forecasts.select("team", "player").distinct()
    grid = players.join(covering, "team").join(forecasts, ["team", "player", "source"], "left")
    p = F.coalesce("probability", F.lit(0))
    detail = F.struct((-p).alias("_p"), F.col("source"), p.alias("probability"))
    out = grid.groupBy("team", "player").agg(
        F.floor(F.sum(F.col("weight") * p) / F.sum("weight") + 0.5).cast("int").alias("probability"),
        F.sum((p >= likely).cast("long")).alias("sources_likely"),
        F.count(F.lit(1)).alias("sources_total"),
        F.transform(F.sort_array(F.collect_list(detail)), lambda d: F.struct(d["source"], d["probability"])).alias("agreement"),
    )
    return out


def latest_value(df: DataFrame, key: str, value: str, stamp: list[str]) -> DataFrame:
    """The newest non-blank value per key, null if there is none."""
    order = F.when(F.trim(value) != "", F.struct(*stamp))
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def latest_array(df: DataFrame, key: str, value: str, stamp: list[str]) -> DataFrame:
    """The newest non-empty array per key, null if there is none."""
    order = F.when(F.size(value) > 0, F.struct(*stamp))
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def consensus_detailed(forecasts: DataFrame, sources: DataFrame, likely: int = 60) -> DataFrame:
    """consensus(), whose agreement also has fetched_at and kind of what each source said (null and probable where it is
    silent), confirmed ones first, then by falling probability, then by source.

    forecasts also has fetched_at and kind."""
    covering = forecasts.select("team", "source").distinct().join(sources, "source")
    players = forecasts.select("team", "player").distinct()
    grid = players.join(covering, "team").join(forecasts.select("team", "player", "source", "probability", "fetched_at", "kind"), ["team", "player", "source"], "left")
    p, kind = F.coalesce("probability", F.lit(0)), F.coalesce("kind", F.lit("probable"))
    detail = F.struct((kind != "confirmed").alias("_c"), (-p).alias("_p"), "source", p.alias("probability"), "fetched_at", kind.alias("kind"))
    return grid.groupBy("team", "player").agg(
        F.coalesce(F.floor(F.sum(F.col("weight") * p) / F.nullif(F.sum("weight"), F.lit(0.0)) + 0.5), F.lit(0)).cast("int").alias("probability"),
        F.sum((p >= likely).cast("long")).alias("sources_likely"),
        F.count(F.lit(1)).alias("sources_total"),
        F.transform(F.sort_array(F.collect_list(detail)), lambda d: F.struct(d["source"].alias("source"), d["probability"].alias("probability"), d["fetched_at"].alias("fetched_at"), d["kind"].alias("kind"))).alias("agreement"),
    )


def team_consensus(teams: DataFrame, info: DataFrame, pieces: DataFrame) -> DataFrame:
    """team, formation, coach, set_pieces: a row for every team, always. The newest value that any source has, null if none
    has one; set_pieces (penalty, corner, free_kick, each the newest non-empty, else empty) is null if all three are empty.

    info: team, source, formation, coach, fetched_at; pieces: team, source, penalty, corner, free_kick, fetched_at; ties
    in time go to the greater source."""
    stamp = F.struct("fetched_at", "source")
    said = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c)
    sent = lambda c: F.coalesce(F.max_by(c, F.when(F.size(c) > 0, stamp)), F.array().cast("array<string>")).alias(c)
    told = info.groupBy("team").agg(said("formation"), said("coach"))
    kinds = ["penalty", "corner", "free_kick"]
    takers = pieces.groupBy("team").agg(*map(sent, kinds)).select("team", F.when(F.size("penalty") + F.size("corner") + F.size("free_kick") > 0, F.struct(*kinds)).alias("set_pieces"))
    return teams.select("team").distinct().join(told, "team", "left").join(takers, "team", "left").select("team", "formation", "coach", "set_pieces")
