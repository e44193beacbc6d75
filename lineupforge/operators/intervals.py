"""Points and intervals: equal buckets to join on, the bounds as a further condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import season_week

DAY = 86_400


def _bucket(stamp: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(stamp.cast("timestamp")) / (days * DAY))


def within(points: DataFrame, stamp: Column, intervals: DataFrame, start: str, end: str, by: list[str] | None = None, days: int = 64) -> DataFrame:
    """points with the columns of every interval that holds them, start and end included; null where none does.

    An interval stands once for each bucket of days that it touches, so points and intervals meet by an equality, and no
    point is held against intervals of another time. by: columns that must be equal too. Intervals without a start or an
    end, or that end before they start, hold nothing; a point without a stamp is in none. Buckets should be about as long
    as the intervals: shorter ones copy intervals, longer ones bring more together."""
    by = by or []
    touched = F.sequence(_bucket(F.col(start), days), _bucket(F.col(end), days))
    known = intervals.where(F.col(start) <= F.col(end))
    spread = known.select(*(F.col(c).alias(f"_i_{c}") for c in intervals.columns), F.explode(touched).alias("_bucket"))
    rows = points.withColumns({"_stamp": stamp, "_at": _bucket(stamp, days)})
    holds = (F.col("_at") == F.col("_bucket")) & F.col("_stamp").between(F.col(f"_i_{start}"), F.col(f"_i_{end}"))
    for c in by:
        holds = holds & (F.col(c) == F.col(f"_i_{c}"))
    kept = [c for c in intervals.columns if c not in by]
    return rows.join(spread, holds, "left").select(*points.columns, *(F.col(f"_i_{c}").alias(c) for c in kept))


def weeks_of_seasons(points: DataFrame, stamp: str, seasons: DataFrame) -> DataFrame:
    """points with season and week: Monday weeks from that of the season's first day, 1 to 38; null off season. seasons:
    season, first, last (dates or timestamps), the last day counting whole; a point in two seasons has a row for each."""
    day = lambda c: F.col(c).cast("date").cast("timestamp_ntz")
    days = seasons.select("season", day("first").alias("first"), day("last").alias("last"))
    found = within(points, F.col(stamp).cast("date").cast("timestamp_ntz"), days, "first", "last", days=256)
    return found.withColumn("week", season_week(F.col(stamp), F.col("first"), F.col("last"))).drop("first", "last")
