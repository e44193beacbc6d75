"""The most probable eleven per team. Choosing is greedy over at most a squad's rows, so a grouped map does it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Defenders, midfielders, forwards of each formation in order of preference; the cost of a misfit.
FORMATIONS = [(4, 3, 3), (4, 4, 2), (3, 4, 3), (4, 5, 1), (3, 5, 2), (5, 3, 2), (5, 4, 1)]
MISFIT = 25
LINES = ("DEF", "MED", "DEL")


def pick(squad: list[tuple[int, str | None, int]]) -> list[tuple[int, str]]:
    """(player, line) of a squad of (player, position, probability), by falling probability, then player."""
    squad = sorted((p for p in squad if p[2] > 0), key=lambda p: (-p[2], p[0]))
    keeper = next((p for p in squad if p[1] == "POR"), None)
    pool = [p for p in squad if p is not keeper]
    best, best_score = None, None
    for formation in FORMATIONS:
        free, eleven, score = list(pool), [], 0
        for line, size in zip(LINES, formation):
            ranks = [(p for p in free if p[1] == line), (p for p in free if p[1] is None), iter(free)]
            chosen: list = []
            for rank in ranks:
                chosen += [p for p in rank if p not in chosen][: size - len(chosen)]
            free = [p for p in free if p not in chosen]
            eleven += [(p[0], line) for p in chosen]
            score += sum(p[2] - MISFIT * (p[1] is not None and p[1] != line) for p in chosen)
        if len(eleven) == 10 and (best is None or score > best_score):
            best, best_score = eleven, score
    if best is None:
        best = [(p[0], p[1] or "MED") for p in pool[:10]]
    return ([(keeper[0], "POR")] if keeper else []) + best


def best_eleven(players: DataFrame) -> DataFrame:
    """team, player, line, seat. players: team, player, position (nullable), probability, sources_likely.

    Only players count whom a source takes as likely. Of a position no more than eleven are ever chosen, so Spark keeps the
    first eleven of each, and a group has 55 rows at most for each team."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        squad = [(int(p), x if isinstance(x, str) else None, int(q)) for p, x, q in zip(group["player"], group["position"], group["probability"])]
        chosen = pick(squad)
        return pd.DataFrame({"team": group["team"].iloc[0], "player": [p for p, _ in chosen], "line": [x for _, x in chosen], "seat": range(1, len(chosen) + 1)})

    able = players.where("probability > 0 and sources_likely > 0").select("team", "player", "position", "probability")
    seat = F.row_number().over(Window.partitionBy("team", "position").orderBy(F.desc("probability"), "player"))
    able = able.withColumn("_seat", seat).where("_seat <= 11").drop("_seat")
    return able.groupBy("team").applyInPandas(run, f"team {players.schema['team'].dataType.simpleString()}, player long, line string, seat int")
