"""Error-correcting Earley parsing with a weighted grammar.

A grammar has plain productions over symbols, and error productions on its terminals: a row may be kept as the terminal it
is, reroled to another, or deleted, and a terminal may be inserted where no row stands. Each has a cost. Chart items retain
the least (cost, audit), audits being the initials of the edits in order, ties ASCII-least; the least completed item of
the start symbol yields the repair.

The chart runs over the rows from last to first, and over the mirrored right-hand sides. What is found later then stands
before what is found earlier, so an audit grows at its head and shares its tail with others: a cell (initial, place, tail).
Two audits of one item and one cost can't be prefixes of each other (they cover the same rows, so the longer would have
more inserts and cost more), and they differ within a few cells, so comparing them takes no copies. With a right-recursive
grammar, which mirrored is left-recursive, a column holds a bounded number of items: time and memory grow with the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True, eq=False)
class Grammar:
    """Productions by symbol; terminals are the symbols without productions. kinds: the roles that rerole and insert may
    give, by terminal."""

    start: str
    rules: dict
    kinds: dict = field(default_factory=dict)
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    def mirrored(self) -> list[tuple[str, tuple]]:
        return [(left, tuple(reversed(right))) for left, rights in self.rules.items() for right in rights]


#: An optional system turn, then pairs of a user's and an assistant's turn, or nothing: (s?(ua)+)?
ROLES = Grammar("talk", {"talk": [(), ("pairs",), ("s", "pairs")], "pairs": [("u", "a"), ("u", "a", "pairs")]}, {"u": "user", "a": "assistant"})


@dataclass(frozen=True)
class Row:
    """What the parser sees of a row: its terminal, whether it must go, whether it is truncated."""

    kind: str
    must_go: bool = False
    truncated: bool = False


def _before(a, b) -> bool:
    """Whether audit a comes before audit b; both of one cost and over the same rows."""
    while a is not b:
        if a is None or b is None:
            return a is None
        if a[0] != b[0]:
            return a[0] < b[0]
        a, b = a[2], b[2]
    return False


def _joined(head, tail):
    """The audit head followed by tail."""
    if tail is None:
        return head
    cells = []
    while head is not None:
        cells.append(head)
        head = head[2]
    for c in reversed(cells):
        tail = (c[0], c[1], tail)
    return tail


class _Column:
    """Items by (rule, dot, origin) with their least (cost, audit), and which of them wait for a symbol."""

    def __init__(self):
        self.items: dict = {}
        self.waiting: dict = {}
        self.todo: list = []

    def put(self, key: tuple, cost: int, audit) -> None:
        old = self.items.get(key)
        if old is None or cost < old[0] or cost == old[0] and _before(audit, old[1]):
            self.items[key] = (cost, audit)
            self.todo.append(key)


def parse(rows: Sequence[Row], grammar: Grammar = ROLES) -> tuple[int, list[tuple[str, str | None]]]:
    """(cost, edits): the cheapest edits, in order, as (initial, terminal): K and D with None, R and I with the terminal
    that is put there."""
    rules = grammar.mirrored()
    plain, ends = set(grammar.rules), len(rows)
    columns = [_Column() for _ in range(ends + 1)]
    for r, (left, _) in enumerate(rules):
        if left == grammar.start:
            columns[0].put((r, 0, 0), 0, None)
    for at in range(ends + 1):
        column = columns[at]
        while column.todo:  # an item that gets better is done again; costs only fall and each insert costs, so this ends
            key = column.todo.pop()
            r, dot, origin = key
            cost, audit = column.items[key]
            left, right = rules[r]
            if dot == len(right):
                for other in list(columns[origin].waiting.get(left, ())):
                    base, tail = columns[origin].items[other]
                    column.put((other[0], other[1] + 1, other[2]), base + cost, _joined(audit, tail))
            elif right[dot] in plain:
                column.waiting.setdefault(right[dot], set()).add(key)
                for q, (name, _) in enumerate(rules):
                    if name == right[dot]:
                        column.put((q, 0, at), 0, None)
                for q, (name, body) in enumerate(rules):  # what was completed here before this item waited for it
                    if name == right[dot] and (q, len(body), at) in column.items:
                        c, head = column.items[q, len(body), at]
                        column.put((r, dot + 1, origin), cost + c, _joined(head, audit))
            elif right[dot] in grammar.kinds:
                column.put((r, dot + 1, origin), cost + grammar.insert, ("I", right[dot], audit))
        if at == ends:
            break
        row, further = rows[ends - 1 - at], columns[at + 1]
        for (r, dot, origin), (cost, audit) in column.items.items():
            left, right = rules[r]
            wanted = right[dot] if dot < len(right) else None
            if wanted in plain or wanted is None and left != grammar.start:
                continue
            further.put((r, dot, origin), cost + grammar.delete, ("D", None, audit))
            if wanted is not None and not row.must_go:
                extra = grammar.truncated if row.truncated else 0
                if row.kind == wanted:
                    further.put((r, dot + 1, origin), cost + extra, ("K", None, audit))
                if wanted in grammar.kinds:
                    further.put((r, dot + 1, origin), cost + extra + grammar.rerole, ("R", wanted, audit))
        if at:  # items that later columns may ask for are those that wait at their origin
            column.items = {k: v for k, v in column.items.items() if any(k in w for w in column.waiting.values())}
    best = None
    for (r, dot, origin), found in columns[ends].items.items():
        if rules[r][0] == grammar.start and dot == len(rules[r][1]) and origin == 0 and (best is None or found[0] < best[0] or found[0] == best[0] and _before(found[1], best[1])):
            best = found
    if best is None:
        raise ValueError("the grammar has no sentence that these edits can reach")
    edits, cell = [], best[1]
    while cell is not None:
        edits.append((cell[0], cell[1]))
        cell = cell[2]
    return best[0], edits
