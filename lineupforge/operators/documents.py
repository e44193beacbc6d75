"""Nested documents: a row per parent with the first few of several lists, of which no group is collected whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A list of a document: rows (with the parents' key), their order, how many at most, and the fields of an element."""

    rows: DataFrame
    order: tuple[Column, ...]
    most: int
    fields: tuple[str, ...]


def top_lists(parents: DataFrame, key: str, parts: dict[str, Part]) -> DataFrame:
    """parents with an array per part: the first rows of each key, in order; empty where a key has none.

    Every task keeps the first rows of a key that it sees before the exchange, so what reaches a key's task is bounded by
    tasks times most, and what is collected by most. Orders should end in something unique."""
    out = parents
    for name, part in parts.items():
        w = Window.partitionBy(key).orderBy(*part.order)
        first = part.rows.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= part.most)
        element = F.struct(*part.fields)
        lists = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_place", element.alias("e")))).alias("_l"))
        lists = lists.select(key, F.transform("_l", lambda x: x["e"]).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def counted_lists(parents: DataFrame, key: str, parts: dict[str, Part]) -> DataFrame:
    """top_lists() with the number of all rows of each list beside it (name_total)."""
    out = top_lists(parents, key, parts)
    for name, part in parts.items():
        total = part.rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_total"))
        out = out.join(total, key, "left").withColumn(f"{name}_total", F.coalesce(f"{name}_total", F.lit(0).cast("long")))
    return out

