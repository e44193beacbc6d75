"""From parsed pages to the reports of a source: teams, certainty, what failed; and small readers of landed files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..operators.state import first_per_key
from . import pages as P
from .html import is_squad_section, squad
from .pages import CERTAIN

# From which share on a player is certain; notes of a source that flags doubts.
SURE = 90
HURT, DOUBTED, ALTERNATIVE = "Llega con molestias o tocado (fuente Comuniate).", "Muchas dudas sobre la titularidad.", "Duda de titularidad. Alternativa: "


def reports(players: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """source, team, ord, raw, probability, certain, kind, note, position, photo: what jobs.persist takes.

    players: page_id, side, ord, player, position, probability, photo and, if there, alternative; pages: page_id, place (the
    order in which pages were read), home, away (teams, null where they aren't known). A team counts on the first page that
    has players of it; another page's rows of it are left out. A missing share is 100. Certain is a share of 90 or more."""
    team = F.when(F.col("side") == "home", F.col("home")).otherwise(F.col("away"))
    rows = players.join(pages.select("page_id", "place", "home", "away"), "page_id").withColumn("team", team).where("team is not null")
    first = first_per_key(rows.select("team", "page_id", "side", "place"), ["team"], [F.col("place"), F.col("page_id"), F.desc(F.col("side") == "home")])
    kept = rows.join(first.select("team", "page_id", "side"), ["team", "page_id", "side"], "left_semi")
    share = F.coalesce(F.col("probability").cast("double"), F.lit(float(CERTAIN)))
    note = F.when(F.col("alternative").isNotNull(), F.concat(F.lit("Alternativa: "), "alternative")) if "alternative" in players.columns else F.lit(None).cast("string")
    return kept.select(F.lit(source).alias("source"), "team", (F.col("place") * 10_000 + F.col("ord")).alias("ord"), F.col("player").alias("raw"), share.alias("probability"), (share >= SURE).alias("certain"), F.lit("probable").alias("kind"), note.alias("note"), "position", "photo")


def flag_notes(rows: DataFrame) -> DataFrame:
    """rows of a layout that flags doubts and injuries (doubt, injury, alternative) with event, severity and note."""
    event = F.when(F.col("injury"), "injury").when(F.col("doubt"), "doubt")
    note = F.when(F.col("injury"), HURT).when(F.col("alternative").isNotNull(), F.concat(F.lit(ALTERNATIVE), "alternative", F.lit("."))).otherwise(DOUBTED)
    return rows.where("injury or doubt").withColumns({"event": event, "severity": F.when(F.col("injury"), "light").otherwise("none"), "note": note})


def answer(pages: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """source, partial, error of a source's run: partial if a page gave no rows, an error if none did. One row."""
    read = rows.select("page_id").distinct().withColumn("_read", F.lit(1))
    counts = pages.join(read, "page_id", "left").agg(F.count(F.lit(1)).alias("pages"), F.count("_read").alias("read"))
    return counts.select(F.lit(source).alias("source"), (F.col("read") < F.col("pages")).alias("partial"), F.when(F.col("read") == 0, "no page gave rows").alias("error"))


def read_plain_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files of cells between commas, without quotes: the first line of each file is the header; missing cells are null,
    blank lines are left out. Quotes are letters like any other, so a quoted comma does split, as such files want it."""
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "value", F.monotonically_increasing_id().alias("at"))
    head = lines.groupBy("file_path").agg(F.min("at").alias("at"))
    rows = lines.join(head, ["file_path", "at"], "left_anti").select(F.split(F.rtrim("value", F.lit("\r")), ",", -1).alias("x")).where(F.trim(F.array_join("x", "")) != "")
    return rows.select(*(F.trim(F.get("x", F.lit(i))).alias(c) for i, c in enumerate(columns)))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A JSON array of all rows in one file, for reports that people read, a row a line in the order of df's partitions. One
    task writes it, line by line; large results are written as lines (files.write_json)."""
    line = lambda text: df.sparkSession.range(1).coalesce(1).select(F.lit(text).alias("value"))
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).coalesce(1)
    body = rows.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "").otherwise(","), "j").alias("value"))
    line("[").unionByName(body).unionByName(line("]")).coalesce(1).write.mode("overwrite").text(path)


def flat_player(raw: Column) -> Column:
    """A catalogue's answer on a player in one shape, whether clubs and countries stand flat or nested; missing lists are
    empty. raw: struct of id, slug, nationality, country (code), activeClubName, activeClubSlug, activeClub (name, slug),
    playerGameScores."""
    return F.struct(
        raw["id"].alias("id"), raw["slug"].alias("slug"), F.coalesce(raw["nationality"], raw["country"]["code"]).alias("nationality"),
        F.coalesce(raw["activeClubName"], raw["activeClub"]["name"]).alias("club"), F.coalesce(raw["activeClubSlug"], raw["activeClub"]["slug"]).alias("club_slug"),
        F.coalesce(raw["playerGameScores"], F.array().cast("array<struct<score:double>>")).alias("scores"),
    )


# Full first names by short ones, for searches.
SEARCH_NAMES = {"fede": "federico", "koke": "sergio", "cuti": "cristian", "tunde": "babatunde", "pepelu": "jose luis", "abde": "abdessamad", "chupi": "carlos", "chupe": "carlos"}


def search_words(name: Column) -> Column:
    """What to search for: the full first name and the next word where the first is a known short one, the first two of
    three or more, the last of two where the first has three letters or fewer, else all; null for names of which nothing is
    left. An open template and numbers don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\{\{.*$", ""), r"\b\d+[ºª.]?\b", "")
    t = F.filter(F.split(normalize_name(bare), " "), lambda w: w != "")
    first, n = F.get(t, 0), F.size(t)
    full = F.try_element_at(F.create_map(*(F.lit(x) for pair in SEARCH_NAMES.items() for x in pair)), first)
    words = F.when((n >= 2) & full.isNotNull(), F.concat_ws(" ", full, F.get(t, 1))).when(n >= 3, F.array_join(F.slice(t, 1, 2), " ")).when((n == 2) & (F.length(first) <= 3), F.get(t, 1)).otherwise(F.array_join(t, " "))
    return F.when(n > 0, words)


@dataclass(frozen=True)
class Layout:
    """How a source's pages are read: players and events from landed pages."""

    players: Callable[[DataFrame], DataFrame]
    events: Callable[[DataFrame], DataFrame]


# The sections of a page that lists a team by position, and what stands before its pictures.
SECTIONS = {"portero": "POR", "defensas": "DEF", "medios": "MED", "delanteros": "DEL"}
SECTIONED_BASE = "https://www.comuniate.com"


def _sectioned(pages: DataFrame) -> DataFrame:
    return P.sectioned_lineup(pages, SECTIONS, SECTIONED_BASE)


def _flagged(pages: DataFrame) -> DataFrame:
    return flag_notes(_sectioned(pages)).select("page_id", "side", "ord", "player", "event", "severity", F.lit(None).cast("string").alias("reason"), "note")


#: The layouts by source; another source needs an entry here and nothing else.
LAYOUTS = {
    "comuniate": Layout(_sectioned, _flagged),
    "analiticafantasy": Layout(P.photo_lineup, P.medical_report),
    "futbolfantasy": Layout(P.sided_lineup, P.absences),
    "jornadaperfecta": Layout(P.row_lineup, P.unavailable),
}


def read_source(source: str, layout: Layout, pages: DataFrame, meant: DataFrame) -> dict[str, DataFrame]:
    """reports, events, answers (one row) and quarantine of a source, as jobs takes them. pages: page_id, url, html; meant:
    page_id, place, home, away. A page that gives no players goes to quarantine and makes the run partial; the others count."""
    players = layout.players(pages)
    found = layout.events(pages).join(meant.select("page_id", "home", "away"), "page_id")
    team = F.when(F.col("side") == "home", F.col("home")).otherwise(F.col("away"))
    none = F.lit(None).cast("string")
    note = F.col("note") if "note" in found.columns else none
    events = found.select(F.lit(source).alias("source"), team.alias("team"), F.col("player").alias("raw"), "event", "severity", "reason", none.alias("expected_return"), note.alias("note")).where("team is not null")
    return {"reports": reports(players, meant, source), "events": events, "answers": answer(pages, players, source), "quarantine": P.quarantine(pages, players)}


def encyclopaedia_rosters(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(team, page, section, name, position of the squads that could be read; team, page, error of the others) from landed
    answers: team, page, redirects, sections, wikitext (JSON texts; null where a call failed).

    The page is where the redirect leads, the section the first whose line is one of a squad; the wikitext is that
    section's. A failure concerns its own team alone."""
    redirect = F.from_json("redirects", "query struct<redirects:array<struct<to:string>>>")["query"]["redirects"]
    listed = F.from_json("sections", "parse struct<sections:array<struct<line:string,index:string>>>")["parse"]["sections"]
    section = F.get(F.filter(listed, lambda s: is_squad_section(s["line"])), F.lit(0))
    text = F.from_json("wikitext", "parse struct<wikitext:struct<`*`:string>>")["parse"]["wikitext"]["*"]
    rows = landed.select("team", F.coalesce(F.get(redirect, F.lit(0))["to"], F.col("page")).alias("page"), section["line"].alias("section"), F.coalesce(squad(text), F.array().cast("array<struct<name:string,position:string>>")).alias("squad"), F.col("sections").isNull().alias("lost"), F.col("wikitext").isNull().alias("silent"))
    error = F.when(F.col("lost"), "no answer on sections").when(F.col("section").isNull(), "no section of a squad").when(F.col("silent"), "no answer on the text")
    rows = rows.withColumn("error", error)
    fine = rows.where("error is null").select("team", "page", "section", F.explode("squad").alias("p")).select("team", "page", "section", "p.name", "p.position")
    return fine, rows.where("error is not null").select("team", "page", "error")
