"""Latest values and upserts: each takes DataFrames and returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key. Spark limits each task to a row per key before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_within_newest(df: DataFrame, keys: list, order: list[Column], newest: int) -> DataFrame:
    """The first row of each key among the first newest rows overall: the limit comes first."""
    return first_per_key(df.orderBy(*order).limit(newest), keys, order)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins; base rows without a new one stay."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*base.columns))


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(delta.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def seeded(base: DataFrame, catalogue: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(base with the catalogue's rows that it lacks, rows of base that the catalogue lacks): what is outside is told, not
    deleted."""
    return insert_ignore(base, catalogue, keys), base.join(catalogue.select(*keys), keys, "left_anti")


def _both(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    new = delta.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in base.columns if c not in keys))
    return base.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")


def coalescing_upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: the new value if there is one, else the old."""
    return _both(base, delta, keys).select(*keys, *(F.coalesce(f"_n_{c}", c).alias(c) for c in base.columns if c not in keys))


def array_upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: the new array if it has elements, else the old; other fields as coalescing_upsert has them."""
    arrays = {f.name for f in base.schema.fields if isinstance(f.dataType, ArrayType)}
    pick = lambda c: F.when(F.size(f"_n_{c}") > 0, F.col(f"_n_{c}")).otherwise(F.coalesce(c, f"_n_{c}")) if c in arrays else F.coalesce(f"_n_{c}", c)
    return _both(base, delta, keys).select(*keys, *(pick(c).alias(c) for c in base.columns if c not in keys))


def guarded_upsert(base: DataFrame, delta: DataFrame, keys: list[str], free: Column) -> DataFrame:
    """New rows, and new values for old rows where free (on the old row) holds."""
    take = F.col("_new") & (F.col("_old").isNull() | free)
    return _both(base, delta, keys).select(*keys, *(F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c not in keys))


def group_upsert(base: DataFrame, delta: DataFrame, keys: list[str], groups: dict[str, list[str]], plan: dict[str, Column]) -> DataFrame:
    """New values only for the groups of columns whose plan says so; new rows whole."""
    of = {c: g for g, cols in groups.items() for c in cols}
    new = F.col("_new") & F.col("_old").isNull()
    pick = lambda c: F.when(new | (F.col("_new") & F.coalesce(plan[of[c]], F.lit(False))), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return _both(base, delta, keys).select(*keys, *(pick(c) for c in base.columns if c not in keys))


def delete_missing(base: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows that the feed has; all of them if the feed is empty."""
    return base if feed.isEmpty() else base.join(feed.select(*keys).distinct(), keys, "left_semi")


def zero_fill(previous: DataFrame, reported: DataFrame, entity: str, group: list[str], value: str) -> DataFrame:
    """Rows of previous that a report of the same group leaves out, with value 0. A group without a report stays."""
    silent = previous.join(reported.select(*group).distinct(), group, "left_semi").join(reported.select(entity, *group), [entity, *group], "left_anti")
    return silent.withColumn(value, F.lit(0).cast(previous.schema[value].dataType))


def merge_followers(rows: DataFrame, leaders: DataFrame, entity: str, keys: list[str], stamp: str) -> DataFrame:
    """Rows re-pointed from followers to leaders (entity, leader); of rows that then collide the newest stays, the
    leader's own at a tie, then the smallest follower."""
    moved = rows.join(leaders.select(F.col(entity), F.col("leader")), entity, "left").withColumn("_own", F.col(entity)).withColumn(entity, F.coalesce("leader", entity))
    order = [F.desc(stamp), F.desc(F.col("_own") == F.col(entity)), F.col("_own")]
    return first_per_key(moved, [entity, *keys], order).drop("leader", "_own")


def gap_rounds(df: DataFrame, stamp: str, tie: list[str], gap_seconds: int, by: list[str]) -> DataFrame:
    """round: 1 and up per by; a new one starts after a gap strictly above gap_seconds."""
    w = Window.partitionBy(*by).orderBy(stamp, *tie)
    gap = F.unix_micros(F.col(stamp).cast("timestamp")) - F.unix_micros(F.lag(stamp).over(w).cast("timestamp"))
    return df.withColumn("round", (F.sum(F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long"))
