"""Conversation structure repair: faults are marked row by row, and an error-correcting Earley parser finds the cheapest
edits that give each conversation the order of roles that the grammar asks for.

The grammar, (s?(ua)+)?, and the costs are in earley.ROLES. A blank row and a repeated one (role and text seen earlier)
have to go; a truncated row (its last character that isn't blank is none of . ! ?) may stay, at a cost.

Edge cases: null role and text are read as one space, so such a text is blank and such a role no terminal; an empty role
has no initial; null turns come first and don't count for gaps; rows of one turn are ordered by role, then text; repeated
rows are repeats; rows with a null conv_id are one conversation; a conversation of which no row is left has zeros and
empty results; an empty table gives an empty result; only conv_id, turn, role and text are read, so further columns can't
clash. A conversation, like a text, is one record and is repaired in one piece, in time that grows with its rows."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .earley import ROLES, Grammar, Row, parse

LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
IN_ORDER = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row of (role, text), or ''."""
    seen, out = set(), []
    for row in rows:
        last = LAST.search(row[1])
        out.append("blank" if last is None else "duplicate" if row in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add(row)
    return out


@functools.lru_cache(maxsize=4096)
def _remembered(rows: tuple[Row, ...], grammar: Grammar) -> tuple[int, list]:
    return parse(rows, grammar)


def repaired(rows: list[tuple[str, str]], found: list[str], grammar: Grammar = ROLES) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, audit, repaired rows) of rows of (role, text) with their faults. Parses of short conversations that look alike
    to the parser are remembered."""
    seen = tuple(Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for (role, _), fault in zip(rows, found))
    cost, edits = _remembered(seen, grammar) if len(seen) <= 32 else parse(seen, grammar)
    out, at = [], 0
    for edit, kind in edits:
        if edit == "I":
            out.append((grammar.kinds[kind], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit != "D":
            out.append((grammar.kinds[kind] if edit == "R" else role, text))
    return cost, "".join(e for e, _ in edits), out


def gathered(conversations: DataFrame, times: Column | None = None) -> DataFrame:
    """conv_id, turns: the conversation's rows (turn, role, text, times) in order; rows of times 0 are left out, but the
    conversation stays."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    times = F.lit(1) if times is None else times
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), times.cast("int").alias("times"))
    row = F.when(F.col("times") > 0, F.struct("turn", "role", "text", "times"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def repair(conversations: DataFrame, times: Column | None = None, grammar: Grammar = ROLES) -> DataFrame:
    """A row per conversation: conv_id, gaps (turn numbers missing between the first and the last), rows with each fault,
    illegal (neighbours in no order the grammar has), cost, audit (initials of Keep, Rerole, Delete, Insert), and the
    repaired rows. times: how often each row stands there (once)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for conv, turns in zip(part["conv_id"], part["turns"]):
                rows = [(t["role"], t["text"]) for t in turns for _ in range(t["times"])]
                numbers = {int(t["turn"]) for t in turns if t["turn"] is not None and not pd.isna(t["turn"])}
                found = faults(rows)
                illegal = sum(a[0][:1] + b[0][:1] not in IN_ORDER for a, b in zip(rows, rows[1:]))
                gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
                cost, audit, fixed = repaired(rows, found, grammar)
                out.append((None if pd.isna(conv) else int(conv), gaps, *(found.count(f) for f in FAULTS), illegal, cost, audit, [{"role": r, "text": t} for r, t in fixed]))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = ["Int64", *["int64"] * 6, object, object]
            yield pd.DataFrame({n: pd.Series([o[i] for o in out], dtype=k) for i, (n, k) in enumerate(zip(names, kinds))})

    return gathered(conversations, times).mapInPandas(run, SCHEMA)


def digest(repaired_rows: Column) -> Column:
    """SHA-256 of `role:text` of the repaired rows, joined by newlines."""
    return F.sha2(F.concat_ws("\n", F.transform(repaired_rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"]))), 256)


def damaged(conversations: DataFrame, parts: int = 20) -> DataFrame:
    """Conversations with planted damage, by crc32 of `conv_id:turn` modulo parts: 0 drops a row (times 0), 1 empties its
    text, 2 takes its . ! ? away, 3 repeats it (times 2), 4 makes its role user. Nulls are read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % parts
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
