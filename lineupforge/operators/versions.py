"""Versions of a thing by time, and what was known of it at another time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import within


def validity(versions: DataFrame, by: list[str], stamp: str, days: float) -> DataFrame:
    """The distinct versions (by and stamp) with valid_to: the last microsecond before the next version, or before so many
    days have gone by. One window over the versions of a key: a row per version, not per row that a version has."""
    known = versions.select(*by, stamp).where(F.col(stamp).isNotNull()).distinct()
    following = F.lead(stamp).over(Window.partitionBy(*by).orderBy(stamp))
    expiry = F.col(stamp) + F.make_dt_interval(secs=F.lit(days * 86_400.0).cast("decimal(18,6)"))
    return known.withColumn("valid_to", F.least(following, expiry) - F.expr("interval 1 microsecond"))


def as_of(requests: DataFrame, at: Column, versions: DataFrame, by: list[str], stamp: str, days: float = 30) -> DataFrame:
    """requests with stamp: of their key (by) the newest version that was there at the time, null if there was none yet or
    it had expired. Requests and versions meet by key and bucket of time, so a hot key's requests need not sit in one task."""
    spans = validity(versions, by, stamp, days)
    buckets = max(1, min(64, round(days)))
    return within(requests, at, spans, stamp, "valid_to", by, buckets).drop("valid_to")


def rosters_as_of(requests: DataFrame, at: Column, rosters: DataFrame, days: float = 30) -> DataFrame:
    """requests (with team) with fetched_at and, a row each, name and position of the roster of the team at the time; one
    row with nulls where no roster was there. rosters: team, fetched_at, name, position; a missing position is MED."""
    found = as_of(requests, at, rosters, ["team"], "fetched_at", days)
    squad = rosters.select("team", "fetched_at", "name", F.coalesce("position", F.lit("MED")).alias("position"))
    return found.join(squad, ["team", "fetched_at"], "left")
