"""Whole-table orders without a single task: range partitions, a summary row for each, and what the earlier ones carry over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import written

PART = "range_part"


def range_parts(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with range_part: rows dealt by ranges of the order columns, nulls first, every row of a part before those of the
    next. Written once, so that the bounds, which Spark samples, stay. order should tell all rows apart: equal rows
    can't be dealt to different parts. parts: as many as the session shuffles to."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *(F.asc_nulls_first(c) for c in order)).withColumn(PART, F.spark_partition_id()))


def _carried(dealt: DataFrame, summaries: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """dealt with what the earlier parts carry over. The summary has a row per part, so one task orders it and it is
    broadcast: it grows with the number of parts, not of rows."""
    summary = dealt.groupBy(PART).agg(*(c.alias(name) for name, c in summaries.items()))
    told = summary.select(PART, *(c.alias(name) for name, c in carries.items()))
    return dealt.join(F.broadcast(told), PART)


def numbered(df: DataFrame, order: list[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """df with the place of each row in the whole order, from 0."""
    dealt = range_parts(df, order, parts)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(PART).orderBy(*(F.asc_nulls_first(c) for c in order))
    carried = _carried(dealt, {"_rows": F.count(F.lit(1))}, {"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0))})
    return carried.withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_before", PART)


def placed(df: DataFrame, by: list[str], order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """df with the place of each row among those of its key (by) in an order, from 1. A key with most of the rows lies in
    many parts, each numbered by itself; a part's first key alone can go on from the part before, so what is carried over
    is a row per part at most. order should tell the rows of a key apart."""
    wanted = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = [F.asc_nulls_first(c) for c in by]
    dealt = written(df.repartitionByRange(wanted, *keyed, *order).withColumn(PART, F.spark_partition_id()))
    counts = dealt.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.sum("_rows").over(earlier)).where("_before is not null")
    carried = carried.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col(PART).alias("_part"), "_before")
    same = F.col(PART) == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(PART, *by).orderBy(*order)
    rows = dealt.join(F.broadcast(carried), same, "left").withColumn(name, (F.coalesce("_before", F.lit(0)) + F.row_number().over(inside)).cast("int"))
    return rows.select(*df.columns, name)


def batches(df: DataFrame, order: list[str], size: int, name: str = "batch", parts: int | None = None) -> DataFrame:
    """df with the number of the batch of size rows that a row falls into, from 0."""
    return numbered(df, order, name, parts).withColumn(name, F.floor(F.col(name) / size))


def gap_rounds(df: DataFrame, stamp: str, tie: list[str], gap_seconds: int, name: str = "round", parts: int | None = None) -> DataFrame:
    """df with the round of each row over the whole table, from 1: a new one starts after a gap strictly above gap_seconds.
    Rows without a stamp come first and start nothing."""
    order = [stamp, *tie]
    dealt = range_parts(df, order, parts)
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))
    inside = Window.partitionBy(PART).orderBy(*(F.asc_nulls_first(c) for c in order))
    dealt = dealt.withColumn("_at", micros)
    dealt = dealt.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(inside) > gap_seconds * 1_000_000).cast("long"), F.lit(0)))
    over = Window.orderBy(PART)
    # the first row of a part follows the last stamp of the parts before
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    jump = F.coalesce((F.col("_first") - F.last("_last", ignorenulls=True).over(before) > gap_seconds * 1_000_000).cast("long"), F.lit(0))
    summary = dealt.groupBy(PART).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_new").alias("_breaks")).withColumn("_jump", jump)
    told = summary.select(PART, (1 + F.col("_jump") + F.coalesce(F.sum(F.col("_breaks") + F.col("_jump")).over(before), F.lit(0))).alias("_start"), "_jump")
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # rows without a stamp come before the first stamp: the jump to it is not theirs
    start = F.when(F.col("_at").isNull(), F.col("_start") - F.col("_jump")).otherwise(F.col("_start"))
    return dealt.join(F.broadcast(told), PART).withColumn(name, (start + running).cast("long")).drop("_at", "_new", "_start", "_jump", PART)
