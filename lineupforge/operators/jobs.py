"""A polling cycle over landed reports: into the stored tables, the ledger of runs, duplicates merged, the consensus.

persist and cycle take and return DataFrames, so a cycle can be repeated: the same reports and time give the same tables.
run does a cycle on a store: it reads and writes only the parts whose teams have news or have something that went stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp_probability
from ..sinks.shared import written
from ..sinks.store import Change, Store
from . import cascade, matching, roster
from . import state as S
from .consensus import consensus, consensus_detailed, team_consensus

# Notes and messages as they are stored, positions that count.
ABSENT = "No aparece en la alineación probable de la fuente"
EMPTY = "Resultado vacío: no se persiste nada para no sobrescribir datos válidos."
IN_PART = "Completado con fallos aislados (se conservaron datos anteriores)."
POSITIONS = ["POR", "DEF", "MED", "DEL"]
HOURS = 12


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def dead_letters(told: DataFrame, at: Column) -> DataFrame:
    """team, source, raw, normalized (the raw name, trimmed), probability (null for events), certain, kind, note, fetched_at
    of rows whose player is null. Blank names leave no letter."""
    name = F.trim("raw")
    return told.where(F.col("player").isNull() & (name != "")).select(
        "team", "source", name.alias("raw"), name.alias("normalized"), F.when(F.col("probability").isNotNull(), clamp_probability(F.col("probability").cast("double"))).alias("probability"),
        F.coalesce("certain", F.lit(False)).alias("certain"), F.coalesce("kind", F.lit("probable")).alias("kind"), "note", at.alias("fetched_at"),
    )


def persist(reports: DataFrame, events: DataFrame, players: DataFrame, forecasts: DataFrame, at: Column) -> dict[str, DataFrame]:
    """players, forecasts, events (new rows for the log), unmatched (dead letters of reports and of events) and processed
    (rows per source) after the reports.

    reports: source, team, ord (order of reading), raw, probability, certain, kind, note, position, photo; events: source,
    team, raw, event, severity, reason and, if there, expected_return and note; players: player, team, ord, name, position,
    photo and, if there, closed (whether a name may mean the row; all may if it isn't there); forecasts: player, source,
    probability, certain, kind, note, fetched_at. Rows of teams without players are left out. Of several rows on one
    player the last counts. Whom a source had and now leaves out gets 0, if its report has anybody of that team. Whom each name
    means is written once, for all results."""
    known = players.select("team").distinct()
    reports, events = reports.join(known, "team", "left_semi"), events.join(known, "team", "left_semi")
    names = reports.select("team", "raw").unionByName(events.select("team", "raw")).distinct()
    cases = names.select("team", F.col("raw").alias("case_id"), "raw")
    open_to = players.where("closed") if "closed" in players.columns else players
    matched = written(matching.match_roster(cases, open_to).select("team", F.col("case_id").alias("raw"), "player"))
    told = reports.join(matched, ["team", "raw"], "left")
    heard = events.withColumns({"expected_return": _optional(events, "expected_return"), "note": _optional(events, "note")}).join(matched, ["team", "raw"], "left")
    of = told.where("player is not null")
    newest = S.first_per_key(of, ["player", "source"], [F.desc("ord")])
    fresh = newest.select(
        "player", "source", clamp_probability(F.col("probability").cast("double")).alias("probability"), F.coalesce("certain", F.lit(False)).alias("certain"),
        F.coalesce("kind", F.lit("probable")).alias("kind"), "note", at.alias("fetched_at"),
    )
    before = forecasts.join(players.select("player", "team"), "player")
    silent = S.zero_fill(before, told, "player", ["team", "source"], "probability").select(
        "player", "source", "probability", F.lit(False).alias("certain"), F.lit("probable").alias("kind"), F.lit(ABSENT).alias("note"), at.alias("fetched_at")
    )
    valid = F.col("position").isin(POSITIONS)
    seen = of.groupBy("player").agg(F.max_by("position", F.when(valid, F.col("ord"))).alias("_position"), F.max_by("photo", F.when(F.col("photo") != "", F.col("ord"))).alias("_photo"))
    patched = players.join(seen, "player", "left").withColumns({"position": F.coalesce("_position", "position"), "photo": F.coalesce("_photo", "photo")})
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    as_report = heard.select("team", "source", "raw", "player", none("probability", "double"), none("certain", "boolean"), none("kind", "string"), none("note", "string"))
    of_event = heard.where("player is not null")
    return {
        "players": patched.select(*players.columns),
        "forecasts": S.upsert(forecasts, fresh.unionByName(silent), ["player", "source"]),
        "events": of_event.select("player", "source", "event", F.coalesce("severity", F.lit("none")).alias("severity"), "reason", "expected_return", "note", at.alias("recorded_at")),
        "unmatched": dead_letters(told.select(*as_report.columns), at).unionByName(dead_letters(as_report, at)),
        "processed": of.groupBy("source").agg(F.count(F.lit(1)).alias("items")),
    }


def persist_teams(info: DataFrame, pieces: DataFrame, teams: DataFrame, stored_info: DataFrame, stored_pieces: DataFrame, at: Column) -> dict[str, DataFrame]:
    """info and pieces (by team and source) after what sources say of teams: coach, formation and news field by field, a
    value that is missing keeps the old one; takers only where a source sends any. Teams that are not known are left out.

    info: team, source, coach, formation, news - a row for every team that a source reports, its values null if it says
    nothing; pieces: team, source, penalty, corner, free_kick (arrays) - a row only where the source has the block."""
    known = lambda df: df.join(teams.select("team").distinct(), "team", "left_semi").withColumn("fetched_at", at)
    keys = ["team", "source"]
    return {"info": S.coalescing_upsert(stored_info, known(info), keys), "pieces": S.array_upsert(stored_pieces, known(pieces), keys)}


def ledger(answers: DataFrame, sources: DataFrame, reports: DataFrame, at: Column) -> DataFrame:
    """source, status, message, finished_at: a run for each enabled source that was asked. An error or a report without
    rows fails it. answers: source, partial, error (null: none); sources: source, enabled."""
    asked = answers.join(sources.where("enabled").select("source"), "source", "left_semi")
    rows = asked.join(reports.select("source").distinct().withColumn("_any", F.lit(True)), "source", "left")
    message = F.coalesce("error", F.when(F.col("_any").isNull(), EMPTY), F.when(F.col("partial"), IN_PART))
    failed = F.col("error").isNotNull() | F.col("_any").isNull()
    status = F.when(failed, "failed").when(F.col("partial"), "partial").otherwise("success")
    return rows.select("source", status.alias("status"), message.alias("message"), at.alias("finished_at"))


def cycle(answers: DataFrame, sources: DataFrame, reports: DataFrame, events: DataFrame, players: DataFrame, forecasts: DataFrame, before: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What persist returns, with runs (ledger and items) and consensus. A failed or disabled source changes nothing; the
    consensus is built anew if any source succeeded and put over the stored one (before), whose other rows stay: players of
    whom nothing fresh is known keep what was known. sources also has weight."""
    runs = ledger(answers, sources, reports, at)
    good = runs.where("status != 'failed'").select("source")
    kept = lambda df: df.join(good, "source", "left_semi")
    out = persist(kept(reports), kept(events), players, forecasts, at)
    out["forecasts"] = written(out["forecasts"])
    out["runs"] = runs.join(out["processed"], "source", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    new = consensus(fresh_forecasts(out["forecasts"], out["players"], at), sources.select("source", "weight"))
    some = F.broadcast(good.limit(1).select(F.lit(True).alias("_any")))  # a row, or none if every source failed
    new = new.withColumn("_any", F.lit(True)).join(some, "_any", "left_semi")
    out["consensus"] = S.upsert(before, new, ["team", "player"])
    return out


#: The stored tables by team, and the logs, which are appended to.
TABLES = {
    "players": "team string, player long, ord long, name string, position string, photo string, closed boolean",
    "forecasts": "team string, player long, source string, probability int, certain boolean, kind string, note string, fetched_at timestamp_ntz",
    "info": "team string, source string, coach string, formation string, news string, fetched_at timestamp_ntz",
    "pieces": "team string, source string, penalty array<string>, corner array<string>, free_kick array<string>, fetched_at timestamp_ntz",
    "consensus": "team string, player long, probability int, sources_likely long, sources_total long, agreement array<struct<source:string,probability:int,fetched_at:timestamp_ntz,kind:string>>, updated_at timestamp_ntz",
    "team_consensus": "team string, formation string, coach string, set_pieces struct<penalty:array<string>,corner:array<string>,free_kick:array<string>>, updated_at timestamp_ntz",
    "due": "team string, due timestamp_ntz",
}
LOGS = {
    "events": "team string, player long, source string, event string, severity string, reason string, expected_return string, note string, recorded_at timestamp_ntz",
    "unmatched": "team string, source string, raw string, normalized string, probability int, certain boolean, kind string, note string, fetched_at timestamp_ntz, resolved long",
}
RUNS = "source string, status string, message string, finished_at timestamp_ntz, items long"
#: How the stored tables hang together, for merging duplicate players.
SCHEMA = {k: cascade.PLAYERS[k] for k in ("players", "forecasts", "events", "consensus", "unmatched")}


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns and types of a schema, null where df has none."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*(_optional(df, f.name, f.dataType).cast(f.dataType).alias(f.name) for f in fields))


def begin(store: Store, players: DataFrame) -> int:
    """The first version of a store: the closed rosters, everything else empty."""
    empty = lambda schema: store.spark.createDataFrame([], schema)
    changes = {name: Change(shaped(players, schema) if name == "players" else empty(schema), ("team",)) for name, schema in (TABLES | LOGS).items()}
    return store.publish(changes | {"runs": Change(empty(RUNS), ("source",))})


def due_teams(players: DataFrame, due: DataFrame, at: Column) -> DataFrame:
    """Teams whose consensus is out of date by itself: a forecast or a team's data that counted went stale, or there never
    was a consensus. due: team, due - when the oldest of what counted stops being fresh."""
    fresh = due.where(F.col("due").isNull() | (F.col("due") >= at)).select("team")
    return players.select("team").distinct().join(fresh, "team", "left_anti")


def run(store: Store, answers: DataFrame, sources: DataFrame, reports: DataFrame, events: DataFrame, info: DataFrame, pieces: DataFrame, at: Column, hours: int = HOURS, everything: bool = False) -> tuple[int, tuple[int, ...]]:
    """A cycle on a store, published as one version: (version, parts of teams it touched).

    Touched are the teams that a source which did not fail reports, and those of due_teams. Only their parts are read and
    written; all other rows stay where they are. For the touched teams the outcome is that of a cycle over everything
    (everything=True does that). Duplicate players of the touched teams are merged first. If every source failed, only
    the ledger is published."""
    reports, events, info, pieces = (df.withColumn("team", F.col("team").cast("string")) for df in (reports, events, info, pieces))
    runs = ledger(answers, sources, reports, at)
    good = runs.where("status != 'failed'").select("source")
    kept = lambda df: df.join(F.broadcast(good), "source", "left_semi")  # a row per source
    reports, events, info, pieces = map(kept, (reports, events, info, pieces))
    if good.isEmpty():
        rows = shaped(runs.withColumn("items", F.lit(0)), RUNS)
        return store.publish({"runs": Change(rows, ("source",), append=True)}), ()
    names = [df.select("team") for df in (reports, events, info, pieces)]
    told = names[0].unionByName(names[1]).unionByName(names[2]).unionByName(names[3]).distinct()
    known = store.read("players").select("team").distinct()
    stale = known if everything else due_teams(known, store.read("due"), at)
    teams = written(told.join(known, "team", "left_semi").unionByName(stale).distinct())
    parts = store.parts_of(teams)
    old = {name: store.read(name, parts) for name in TABLES}
    news = persist(reports, events, old["players"], old["forecasts"].drop("team"), at)
    team_news = persist_teams(info, pieces, old["players"], old["info"], old["pieces"], at)
    of_team = old["players"].select("player", "team")
    tables = {"players": written(news["players"]), "forecasts": written(news["forecasts"].join(of_team, "player")), "events": news["events"].join(of_team, "player"), "unmatched": news["unmatched"], "consensus": old["consensus"]}
    pairs = written(roster.reconcile_plan(tables["players"].join(teams, "team", "left_semi")))
    merging = not pairs.isEmpty()
    if merging:  # the logs' earlier rows of these parts move as well
        tables |= {name: store.read(name, parts).unionByName(shaped(tables[name], LOGS[name])) for name in LOGS}
        tables = cascade.merge(SCHEMA, tables, "players", "player", pairs)
    recent = F.col("fetched_at") >= at - F.expr(f"interval {hours} hours")
    of = lambda df: df.join(teams, "team", "left_semi")
    fresh, fresh_info, fresh_pieces = (of(df).where(recent) for df in (tables["forecasts"], team_news["info"], team_news["pieces"]))
    new = consensus_detailed(fresh, sources.select("source", "weight")).withColumn("updated_at", at)
    about = team_consensus(teams, fresh_info, fresh_pieces).withColumn("updated_at", at)
    ends = fresh.select("team", "fetched_at").unionByName(fresh_info.select("team", "fetched_at")).unionByName(fresh_pieces.select("team", "fetched_at"))
    until = teams.join(ends.groupBy("team").agg((F.min("fetched_at") + F.expr(f"interval {hours} hours")).alias("due")), "team", "left")
    changed = {
        "players": tables["players"], "forecasts": tables["forecasts"], "info": team_news["info"], "pieces": team_news["pieces"],
        "consensus": S.upsert(tables["consensus"], shaped(new, TABLES["consensus"]), ["player"]),
        "team_consensus": S.upsert(old["team_consensus"], shaped(about, TABLES["team_consensus"]), ["team"]),
        "due": S.upsert(old["due"], shaped(until, TABLES["due"]), ["team"]),
    }
    changes = {name: Change(shaped(df, TABLES[name]), ("team",), parts) for name, df in changed.items()}
    changes |= {name: Change(shaped(tables[name], LOGS[name]), ("team",), parts if merging else None, append=not merging) for name in LOGS}
    finished = runs.join(news["processed"], "source", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
    return store.publish(changes | {"runs": Change(shaped(finished, RUNS), ("source",), append=True)}), parts


def fresh_forecasts(forecasts: DataFrame, players: DataFrame, at: Column, hours: int = HOURS) -> DataFrame:
    """team, player, source, probability of rows not older than so many hours, the border included."""
    rows = forecasts.where(F.col("fetched_at") >= at - F.expr(f"interval {hours} hours"))
    return rows.join(players.select("player", "team"), "player").select("team", "player", "source", "probability")


def shown_rounds(matches: DataFrame, now: Column, past: int = 10) -> DataFrame:
    """Matches of the current and the next round. matches: match, stamp, round (nullable).

    Upcoming matches count; if there are none, the last so many, newest round first. Matches without a round show only
    where fewer than two rounds are there."""
    rows = matches.where(F.col("stamp") >= now)
    ahead = not rows.isEmpty()
    if not ahead:
        rows = matches.orderBy(F.desc("stamp"), "match").limit(past)
    rounds = rows.where("round is not null").select("round").distinct().orderBy(F.asc("round") if ahead else F.desc("round")).limit(2)
    shown = rows.join(F.broadcast(rounds.withColumn("_in", F.lit(True))), "round", "left")  # two rows at most
    return shown.where(F.col("_in") | (F.col("round").isNull() & F.lit(rounds.count() < 2))).select("match", "stamp", "round")
