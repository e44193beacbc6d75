"""Keeping a roster in step with a feed: plans are DataFrames to look at first, applying them is a separate step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_name, normalize_name, significant_tokens
from . import matching
from .state import first_per_key, merge_followers


def sync_plan(players: DataFrame, feed: DataFrame) -> DataFrame:
    """team, action (insert, reactivate, deactivate), player (null for inserts), name, position.

    players: team, player, name, canonical (nullable), active; feed: team, name, position. A feed row means the player
    whose canonical name it is, else the one whose name it is (the last by player, if several). Teams that the feed
    lacks are left alone: a failed download deactivates nobody. Two equality joins stand in for the either-or."""
    named = first_per_key(feed.where("name is not null"), ["team", "name"], [F.col("position").asc_nulls_last()]).select("team", "name", "position")

    def index(key: str, prefix: str) -> DataFrame:
        rows = first_per_key(players.where(F.coalesce(F.col(key), F.lit("")) != ""), ["team", key], [F.desc("player")])
        return rows.select("team", F.col(key).alias("name"), F.struct("player", "active").alias(prefix))

    both = named.join(index("canonical", "c"), ["team", "name"], "left").join(index("name", "n"), ["team", "name"], "left")
    found = F.coalesce("c", "n")
    known = both.select("team", F.when(found.isNull(), "insert").when(~F.coalesce(found["active"], F.lit(False)), "reactivate").alias("action"), found["player"].alias("player"), "name", "position")
    gone = players.where("active and canonical != ''").join(named.select("team").distinct(), "team", "left_semi")
    gone = gone.join(named.select("team", F.col("name").alias("canonical")), ["team", "canonical"], "left_anti")
    return known.where("action is not null").unionByName(gone.select("team", F.lit("deactivate").alias("action"), "player", F.col("canonical").alias("name"), F.lit(None).cast("string").alias("position")))


def apply_plan(players: DataFrame, plan: DataFrame, new_key: Column) -> DataFrame:
    """players after a plan: flags set, canonical names of reactivated rows set, inserts added under new_key (a Column
    over team and name)."""
    change = plan.where("action != 'insert'").select("team", "player", F.col("action"), F.col("name").alias("_name"))
    kept = players.join(change, ["team", "player"], "left")
    on = F.col("action") == "reactivate"
    kept = kept.withColumns({"active": F.when(on, True).when(F.col("action") == "deactivate", False).otherwise(F.col("active")), "canonical": F.when(on, F.col("_name")).otherwise(F.col("canonical"))}).select(*players.columns)
    added = plan.where("action = 'insert'").select("team", "name", F.col("name").alias("canonical"), F.lit(True).alias("active")).withColumn("player", new_key.cast(players.schema["player"].dataType))
    return kept.unionByName(added.select(*(c if c in added.columns else F.lit(None).cast(players.schema[c].dataType).alias(c) for c in players.columns)))


def choose_leaders(members: DataFrame, rows: Column | None = None) -> DataFrame:
    """player, leader for all but the leaders of clusters. members: cluster, player, name, ord. The leader has the most
    rows (if given), then the most tokens, then the longest normalised name, then comes first."""
    order = ([F.desc(F.coalesce(rows, F.lit(0)))] if rows is not None else []) + [F.desc(F.size(significant_tokens(F.col("name")))), F.desc(F.length(normalize_name(F.col("name")))), F.col("ord")]
    top = first_per_key(members, ["cluster"], order).select("cluster", F.col("player").alias("leader"))
    return members.join(top, "cluster").where("player != leader").select("player", "leader")


def reconcile_plan(players: DataFrame) -> DataFrame:
    """follower, leader: players of one team who go by one full name, equal once normalised or known under it. The name
    with the most tokens leads, then the longest, then the first by ord. players: player, team, ord, name."""
    key = F.nullif(normalize_name(canonical_name(F.col("name"))), F.lit(""))
    members = players.select(F.when(key.isNotNull(), F.struct("team", key.alias("key"))).alias("cluster"), "player", "name", "ord").where("cluster is not null")
    several = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return choose_leaders(members.join(several, "cluster", "left_semi")).withColumnRenamed("player", "follower")


def backfill_plan(players: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """player, leader, confidence, rule: rows outside the closed roster matched to a roster row of their team. players:
    team, player, ord, name, active."""
    cases = players.where("not active").select("team", F.col("player").alias("case_id"), F.col("name").alias("raw"))
    found = matching.match_roster(cases, players.where("active").select("team", "ord", "player", "name"), min_confidence)
    return found.select(F.col("case_id").alias("player"), F.col("player").alias("leader"), "confidence", "rule")


def reviewed_plan(reviews: DataFrame, players: DataFrame) -> DataFrame:
    """player, leader of reviewed pairs (first, second, decision) judged confirmed or likely; pairs with an unknown
    player are left out. The longer raw name leads, the first at a tie."""
    name = lambda which: players.select(F.col("player").alias(which), F.length("name").alias(f"{which}_len"))
    rows = reviews.where(F.lower(F.trim("decision")).isin("confirmed", "likely")).join(name("first"), "first").join(name("second"), "second")
    leads = F.col("first_len") >= F.col("second_len")
    return rows.select(F.when(leads, F.col("second")).otherwise(F.col("first")).alias("player"), F.when(leads, F.col("first")).otherwise(F.col("second")).alias("leader")).distinct()


def merge_players(players: DataFrame, leaders: DataFrame, tables: dict[str, tuple[DataFrame, list[str], str]]) -> dict[str, DataFrame]:
    """players without followers, and each table (rows, keys beside the player, stamp) re-pointed to the leaders, the
    newest of colliding rows kept. Leaving a table out leaves its rows to the followers, which the caller then drops."""
    out = {name: merge_followers(rows, leaders, "player", keys, stamp) for name, (rows, keys, stamp) in tables.items()}
    return out | {"players": players.join(leaders.select("player"), "player", "left_anti")}


def broken_references(rows: DataFrame, key: str, players: DataFrame, parent: str = "player") -> DataFrame:
    """Rows whose key no player has; empty when a merge is whole."""
    return rows.where(F.col(key).isNotNull()).join(players.select(F.col(parent).alias(key)), key, "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys with more than one row among those where a condition holds: the violations of a (partial) unique index."""
    return (rows.where(where) if where is not None else rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
