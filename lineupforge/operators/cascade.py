"""Merging entities through a declared graph of foreign keys.

A schema says which columns of which tables refer to which table, what makes a row unique, and what becomes of rows that
collide once their references point to the leader. Merging walks the tables in the order of their references, parents
last, and moves every reference of every table; a table that is not declared, or a declared one that is missing, is an
error, so no reference can be forgotten."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import first_per_key

#: What becomes of rows that collide: the newest stays (by stamp), or the leader's own; or nothing can collide.
NEWEST, OWN, APPEND = "newest", "own", "append"


@dataclass(frozen=True)
class Table:
    """refers: column -> table it refers to; key: what is unique (with the references in it); clash: NEWEST, OWN or APPEND;
    stamp: the column that NEWEST looks at; drop: rows of followers go instead of moving."""

    refers: dict[str, str] = field(default_factory=dict)
    key: tuple[str, ...] = ()
    clash: str = APPEND
    stamp: str | None = None
    drop: bool = False


def order_of(schema: dict[str, Table], entity: str) -> list[str]:
    """The tables that refer to entity, directly or through others, each before those it refers to; entity comes last."""
    for name, t in schema.items():
        for column, to in t.refers.items():
            if to not in schema:
                raise ValueError(f"{name}.{column} refers to {to}, which is not declared")
    if entity not in schema:
        raise ValueError(f"{entity} is not declared")
    involved = {entity}
    while grown := {n for n, t in schema.items() if n not in involved and involved & set(t.refers.values())}:
        involved |= grown
    done: list[str] = []
    while len(done) < len(involved):
        free = sorted(n for n in involved - set(done) if all(n not in schema[m].refers.values() for m in involved - set(done)))
        if not free:
            raise ValueError(f"references go in a circle among {sorted(involved - set(done))}")
        done += free
    return done


def moved(rows: DataFrame, table: Table, column: str, leaders: DataFrame) -> DataFrame:
    """rows whose column points to leaders instead of followers (leaders: follower, leader); collisions are settled."""
    led = leaders.select(F.col("follower").alias(column), F.col("leader").alias("_leader"))
    if table.drop:
        return rows.join(led.select(column), column, "left_anti").select(*rows.columns)
    pointed = rows.join(led, column, "left")
    if not table.key or table.clash == APPEND or column not in table.key:
        return pointed.withColumn(column, F.coalesce("_leader", column)).select(*rows.columns)
    own, was = F.col("_leader").isNull(), F.col(column)
    pointed = pointed.withColumns({"_own": own, "_was": was}).withColumn(column, F.coalesce("_leader", column))
    first = [F.desc_nulls_last(table.stamp)] if table.clash == NEWEST else []
    # rows that collided before the merge are no business of it, and rows without the key can't collide
    whole = F.lit(True)
    for k in table.key:
        whole = whole & F.col(k).isNotNull()
    touched = pointed.groupBy(*table.key).agg(F.count_if(~F.col("_own")).alias("_moved")).where("_moved > 0").drop("_moved")
    settled = first_per_key(pointed.where(whole).join(touched, list(table.key), "left_semi"), list(table.key), [*first, F.desc("_own"), F.col("_was")])
    rest = pointed.where(whole).join(touched, list(table.key), "left_anti").unionByName(pointed.where(~whole))
    return settled.unionByName(rest.select(*settled.columns)).select(*rows.columns)


def merge(schema: dict[str, Table], tables: dict[str, DataFrame], entity: str, identity: str, leaders: DataFrame) -> dict[str, DataFrame]:
    """All tables after followers became their leaders: references moved, collisions settled, followers' rows gone.

    leaders: follower, leader; a leader may not be a follower. Tables that do not refer to entity come back as they are."""
    order = order_of(schema, entity)
    if unknown := sorted(set(tables) - set(schema)):
        raise ValueError(f"not declared: {unknown}")
    if missing := sorted(set(order) - set(tables)):
        raise ValueError(f"declared, but not given: {missing}")
    out = dict(tables)
    for name in order:
        table = schema[name]
        for column, to in table.refers.items():
            if to == entity:
                out[name] = moved(out[name], table, column, leaders)
        if name == entity:
            out[name] = out[name].join(leaders.select(F.col("follower").alias(identity)), identity, "left_anti").select(*tables[name].columns)
    return out


def dangling(schema: dict[str, Table], tables: dict[str, DataFrame], identities: dict[str, str]) -> DataFrame:
    """table, column, n: references that lead nowhere, for each declared reference that has any."""
    found = None
    for name, t in schema.items():
        for column, to in t.refers.items():
            if name in tables and to in tables:
                there = tables[to].select(F.col(identities[to]).alias(column)).distinct()
                lost = tables[name].where(F.col(column).isNotNull()).join(there, column, "left_anti").agg(F.count(F.lit(1)).alias("n"))
                row = lost.select(F.lit(name).alias("table"), F.lit(column).alias("column"), "n")
                found = row if found is None else found.unionByName(row)
    if found is None:
        raise ValueError("the schema declares no references between the tables given")
    return found.where("n > 0")


# The tables of a line-up store around its players. The names and keys of the stored tables.
PLAYERS = {
    "players": Table(),
    "forecasts": Table({"player": "players"}, ("player", "source"), NEWEST, "fetched_at"),
    "events": Table({"player": "players"}),
    "consensus": Table({"player": "players"}, ("player",), OWN),
    "source_ids": Table({"player": "players"}, ("player", "source"), OWN),
    "mappings": Table({"player": "players"}, ("player",), OWN),
    "unmatched": Table({"resolved": "players"}),
}
