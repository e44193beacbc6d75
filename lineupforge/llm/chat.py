"""Chat formatting: a finite-state machine over roles checks the order of turns and emits text segments with a loss
flag each, after a declarative template.

A text may hold the template's own control strings. Each control string is broken inside texts by putting the escape
character after its first character, and the escape character itself is doubled; unescape() undoes both, so every text
reads back unchanged.

Edge cases: a null text is empty; a null role is the role ''; turns of one number are ordered by role, then text;
repeated rows are turns of their own; a conversation that breaks the order is formatted as well, with valid false and
the first bad turn in broken_at; rows with a null conv_id are conversations of one turn each, for nothing says that they
belong together; an empty table gives an empty result; very long texts are formatted whole; only conv_id, turn, role and
text are read, so further columns can't clash. A conversation, like a text, is one record and is formatted in one piece."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn by role, roles under the loss, and the order: states by state and role."""

    before: dict = field(default_factory=lambda: {"system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": "<s>[OUT] "})
    other: str = "<s>[ROLE] {role} [/ROLE] "
    after: dict = field(default_factory=lambda: {"system": " [/SYS]</s>", "user": " [/INST]</s>", "assistant": " [/OUT]</s>"})
    end: str = " [/TEXT]</s>"
    loss: tuple = ("assistant",)
    order: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    control: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[/OUT]", "[ROLE]", "[/ROLE]", "[/TEXT]")
    escape: str = "\\"

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, self.escape * 2)
        return re.sub("|".join(map(re.escape, self.control)), lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + re.escape(self.escape) + ")?", lambda m: m[1] or "", text)


def format_turns(turns: list[tuple[str, str]], t: Template) -> tuple[str, list[tuple[int, int, str, bool]], int]:
    """(formatted, segments, broken_at). Segments are (start, end, kind, loss) in code points and cover all of it;
    kind is 'mark' or a turn's role. broken_at: the first turn that the order doesn't allow, else -1."""
    state, out, segments, at, broken = "start", [], [], 0, -1

    def emit(text: str, kind: str, loss: bool) -> None:
        nonlocal at
        out.append(text)
        segments.append((at, at + len(text), kind, loss))
        at += len(text)

    for i, (role, text) in enumerate(turns):
        state = t.order.get((state, role), "broken")
        if state == "broken" and broken < 0:
            broken = i
        emit(t.before.get(role) or t.other.format(role=t.escaped(role)), "mark", False)
        emit(t.escaped(text), role, role in t.loss)
        emit(t.after.get(role) or t.end, "mark", False)
    return "".join(out), segments, broken


def read_back(formatted: str, t: Template) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, from its marks alone."""
    heads = {re.escape(b): role for role, b in t.before.items()}
    other = re.escape(t.other).replace(re.escape("{role}"), "(?P<role>.*?)")
    tails = "|".join(re.escape(a) for a in [*t.after.values(), t.end])
    turns = []
    for m in re.finditer(f"(?:(?P<head>{'|'.join(heads)})|{other})(?P<text>.*?)(?:{tails})", formatted, re.S):
        role = next((r for b, r in heads.items() if m["head"] and re.fullmatch(b, m["head"])), None)
        turns.append((role if role is not None else t.unescaped(m["role"]), t.unescaped(m["text"])))
    return turns


SCHEMA = "conv_id long, n_turns long, formatted string, segments array<struct<start:long,end:long,kind:string,loss:boolean>>, valid boolean, broken_at long"


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, segments (start, end, kind, loss), valid, broken_at."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = rows.groupBy("conv_id", alone.alias("_alone")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for conv, turns in zip(part["conv_id"], part["turns"]):
                formatted, segments, broken = format_turns([(x["role"], x["text"]) for x in turns], template)
                out.append((None if pd.isna(conv) else int(conv), len(turns), formatted, [dict(zip(("start", "end", "kind", "loss"), s)) for s in segments], broken < 0, None if broken < 0 else broken))
            yield pd.DataFrame({k: pd.Series([o[i] for o in out], dtype=kind) for i, (k, kind) in enumerate([("conv_id", "Int64"), ("n_turns", "int64"), ("formatted", object), ("segments", object), ("valid", bool), ("broken_at", "Int64")])})

    return turns.select("conv_id", "turns").mapInPandas(run, SCHEMA)
