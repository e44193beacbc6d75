"""Line-up pages to rows, for the layouts that sources use. Pages are landed as (page_id, url, html).

A page is cut at the opening tags of its repeated elements; each piece, from one such tag to the next, gives one row by
regular expressions. All of it is Columns: nothing leaves the JVM, and the work is one pass over the pages.

Every layout gives players (page_id, side, ord, player, position, probability, photo) or events (page_id, side, ord,
player, event, severity, reason). A name that repeats within a page's side counts once, the first time. A null or empty
page, or one of another layout, gives no rows; quarantine tells such pages apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.state import first_per_key
from .html import clean_text

# Words and class names of the pages' formats, the probability of a player shown without one.
PHOTO_OF = r"(?i)^foto de\s+"
FACE_OF = r"(?i)^cara de\s+"
ROW_POSITIONS = {"1": "POR", "2": "DEF", "3": "MED", "4": "DEL", "5": "DEL"}
GRAVITY = {"0": "out", "1": "light"}
SUSPENSION = r"(?i)sancion|sanction|amarilla|tarjeta|acumulaci"
CERTAIN = 100
SIDES = ("home", "away")


def tag(attribute: str, value: str, name: str = r"\w+") -> str:
    """A pattern of an opening tag with value among the blank-separated values of an attribute."""
    return rf"<{name}\b(?=[^<>]*\s{attribute}=\"(?:[^\"]*\s)?{value}(?:\s[^\"]*)?\")[^<>]*>"


def of_class(value: str, name: str = r"\w+") -> str:
    return tag("class", value, name)


def pieces(html: Column, opening: str) -> Column:
    """The page cut before every match of opening; what precedes the first is left out."""
    return F.filter(F.split(html, f"(?={opening})"), lambda p: p.rlike(f"^{opening}"))


def attribute(piece: Column, opening: str, name: str) -> Column:
    """An attribute of the first tag of that kind; null if there is none."""
    found = F.regexp_extract(F.regexp_extract(piece, opening, 0), rf"\s{name}=\"([^\"]*)\"", 1)
    return F.nullif(found, F.lit(""))


def inner(piece: Column, opening: str) -> Column:
    """The text inside the first such element, up to the first closing tag of its own name; null if blank."""
    name, rest = opening[1:].split(r"\b", 1)
    return F.nullif(clean_text(F.regexp_extract(piece, rf"(?s)<({name})\b{rest}(.*?)</\1>", 2)), F.lit(""))


def short(piece: Column, opening: str) -> Column:
    """The text between the first such tag and the next tag; null if blank."""
    return F.nullif(clean_text(F.regexp_extract(piece, rf"{opening}([^<]*)", 1)), F.lit(""))


def whole_number(text: Column) -> Column:
    """The digits of a text as a number; null if it has none."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("int")


def photo_url(source: Column, base: str = "") -> Column:
    """An absolute address without its query; one that starts with a slash is put behind base, if base is given."""
    bare = F.regexp_replace(source, r"\?.*$", "")
    return F.when(bare.startswith("http"), bare).when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).when(F.lit(base != "") & (bare != ""), F.concat(F.lit(base), bare))


def _cut(df: DataFrame, source: Column, opening: str, *keep) -> DataFrame:
    return df.select("page_id", *keep, F.posexplode(pieces(source, opening)).alias("ord", "piece"))


def _once(df: DataFrame, *keys: str) -> DataFrame:
    return first_per_key(df.where("player is not null and player != ''"), list(keys), [F.col("ord")])


def _players(df: DataFrame) -> DataFrame:
    return _once(df, "page_id", "side", "player").select("page_id", "side", "ord", "player", "position", "probability", "photo")


def _events(df: DataFrame, *keys: str) -> DataFrame:
    return _once(df, "page_id", "side", *keys, "player").select("page_id", "side", "ord", "player", "event", "severity", "reason")


def sectioned_lineup(pages: DataFrame, sections: dict[str, str], base: str = "") -> DataFrame:
    """One team per page, a section (by id) per position; flags mark doubts and injuries. A player without a percentage
    has probability null here: the caller takes them as certain. Alternatives' names don't count as part of a name."""
    ids = "|".join(sections)
    opening = rf"<\w+\b[^<>]*\sid=\"(?:{ids})\"[^<>]*>"
    names = F.create_map(*(F.lit(x) for pair in sections.items() for x in pair))
    parts = pages.select("page_id", F.explode(pieces(F.col("html"), opening)).alias("part"))
    parts = parts.withColumn("position", names[F.regexp_extract("part", r"^<\w+\b[^<>]*\sid=\"([^\"]*)\"", 1)])
    rows = parts.select("page_id", "position", F.posexplode(pieces(F.col("part"), of_class("jugador_campo"))).alias("ord", "piece"))
    p = F.col("piece")
    bare = F.regexp_replace(p, rf"(?s){of_class('alternativo')}.*?</\w+>", "")
    return rows.select(
        "page_id", F.lit("home").alias("side"), "ord", inner(bare, of_class("nombre_jugador")).alias("player"), "position",
        whole_number(inner(p, of_class("icono_porcentaje"))).alias("probability"),
        photo_url(F.regexp_extract(p, rf"(?s){of_class('cara_jugador')}.*?<img\b[^<>]*\ssrc=\"([^\"]*)\"", 1), base).alias("photo"),
        p.rlike(of_class("duda")).alias("doubt"), p.rlike(of_class("fa-plus", "i")).alias("injury"), inner(p, of_class("alternativo")).alias("alternative"),
    ).where("player is not null")


def flagged_events(rows: DataFrame) -> DataFrame:
    """Events from the flags of sectioned_lineup; an injury counts before a doubt."""
    event = F.when(F.col("injury"), "injury").when(F.col("doubt"), "doubt")
    rows = rows.withColumns({"event": event, "severity": F.when(F.col("injury"), "light").otherwise("none"), "reason": F.lit(None).cast("string")})
    return _events(rows.where("event is not null"))


def listed_matches(pages: DataFrame, prefix: str) -> DataFrame:
    """page_id, ord, match, home, away of the item lists in a page's linked data; names stand as 'A vs. B'.

    A match that was listed before ends its block: what follows it there is not read, as the format's reader has it. A
    page's items are folded in order, in its own row."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    item = "struct<url:string,item:struct<url:string,name:string>>"
    lists = pages.select("page_id", F.posexplode(blocks).alias("block", "text")).where(F.col("text").contains("ItemList"))
    one = F.from_json("text", f"struct<itemListElement:array<{item}>>")["itemListElement"]
    many = F.flatten(F.filter(F.transform(F.from_json("text", f"array<struct<itemListElement:array<{item}>>>"), lambda x: x["itemListElement"]), lambda x: x.isNotNull()))
    rows = lists.select("page_id", "block", F.posexplode(F.when(F.ltrim("text").startswith("["), many).otherwise(one)).alias("at", "i"))
    url, sides = F.coalesce("i.url", "i.item.url"), F.split("i.item.name", r"(?i)\s+vs\.?\s+")
    rows = rows.where(url.startswith(prefix)).select("page_id", "block", (F.col("block") * 1_000_000 + F.col("at")).alias("ord"), F.substring(url, F.lit(len(prefix) + 1), F.length(url)).alias("match"), F.get(sides, 0).alias("home"), F.get(sides, 1).alias("away"))
    item_kind = "struct<ord:bigint,block:int,match:string,home:string,away:string>"
    pages_items = rows.where("home != '' and away != ''").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("block").cast("int").alias("block"), "match", "home", "away"))).alias("items"))
    begin = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{item_kind}>").alias("kept"), F.lit(-1).alias("ended"))

    def read(state: Column, x: Column) -> Column:
        over, known = state["ended"] == x["block"], F.array_contains(state["seen"], x["match"])
        new = ~over & ~known
        return F.struct(
            F.when(new, F.array_append(state["seen"], x["match"])).otherwise(state["seen"]).alias("seen"),
            F.when(new, F.array_append(state["kept"], x)).otherwise(state["kept"]).alias("kept"), F.when(known & ~over, x["block"]).otherwise(state["ended"]).alias("ended"),
        )

    kept = pages_items.select("page_id", F.explode(F.aggregate("items", begin, read)["kept"]).alias("m"))
    return kept.select("page_id", "m.ord", "m.match", "m.home", "m.away")


def linked_matches(pages: DataFrame, slugs: DataFrame, section: str | None = "proxjornada") -> DataFrame:
    """page_id, ord, match, home, away from links /partidos/<number>-<slug>-<slug> of the first such section (of the
    whole page if section is None). slugs: slug, team. A tail may be cut in several ways; the longest first slug wins.

    Every cut of a tail at a hyphen is one row, looked up by equality: as many rows as hyphens, no pairs of teams."""
    source = F.get(pieces(F.col("html"), of_class(section, "section")), 0) if section else F.col("html")
    source = F.regexp_extract(source, r"(?s)^(.*?)(?:</section>|$)", 1)
    found = F.regexp_extract_all(source, F.lit(r'href="[^"]*/partidos/(\d+-[a-z0-9-]+)"'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "link"))
    rows = rows.select("page_id", "ord", F.regexp_extract("link", r"^\d+", 0).alias("match"), F.split(F.regexp_replace("link", r"^\d+-", ""), "-").alias("t"))
    cuts = rows.where("size(t) > 1").select("page_id", "ord", "match", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("k"))
    cuts = cuts.select("page_id", "ord", "match", F.array_join(F.slice("t", F.lit(1), F.col("k")), "-").alias("a"), F.array_join(F.slice("t", F.col("k") + 1, F.size("t")), "-").alias("b"))
    home, away = slugs.select(F.col("slug").alias("a"), F.col("team").alias("home")), slugs.select(F.col("slug").alias("b"), F.col("team").alias("away"))
    both = cuts.join(home, "a").join(away, "b")
    return first_per_key(both, ["page_id", "match"], [F.desc(F.length("a")), F.col("ord"), F.col("a")]).select("page_id", "ord", "match", "home", "away")


def _columns(df: DataFrame, opening: str) -> DataFrame:
    """The first two such parts of a page as its sides; pages with fewer give none."""
    parts = pieces(F.col("html"), opening)
    rows = df.select("page_id", F.posexplode(F.slice(F.when(F.size(parts) >= 2, parts), 1, 2)).alias("at", "part"))
    return rows.select("page_id", F.when(F.col("at") == 0, SIDES[0]).otherwise(SIDES[1]).alias("side"), "part")


def photo_lineup(pages: DataFrame) -> DataFrame:
    """Two fields side by side, the first is home; players are photos with a name, whose badge follows. No positions."""
    face = r'<img\b(?=[^<>]*\salt="(?i:foto de)\s)[^<>]*>'
    rows = _columns(pages, r"<\w+\b[^<>]*\sdata-lineup-field\b[^<>]*>")
    rows = _cut(rows, F.col("part"), face, "side")
    p = F.col("piece")
    badge = F.regexp_extract(inner(p, of_class("tabular-nums")), r"(\d+)", 1).try_cast("int")
    name = F.trim(F.regexp_replace(F.regexp_replace(attribute(p, face, "alt"), PHOTO_OF, ""), r"\s+", " "))
    return _players(rows.select("page_id", "side", "ord", name.alias("player"), F.lit(None).cast("string").alias("position"), F.coalesce(badge, F.lit(CERTAIN)).alias("probability"), photo_url(attribute(p, face, "src")).alias("photo")))


def medical_report(pages: DataFrame) -> DataFrame:
    """Players linked under the headings of doubts and of injuries, for each of the two sides of a page (by the order in
    which a kind of heading comes; all home if a kind comes once)."""
    parts = _cut(pages, F.col("html"), r"<h3\b[^<>]*>")
    head = F.regexp_extract("piece", r"(?s)^<h3\b[^<>]*>(.*?)</h3>", 1)
    event = F.when(head.rlike("(?i)en duda"), "doubt").when(head.rlike("(?i)lesionados"), "injury")
    parts = parts.withColumn("event", event).where("event is not null")
    kinds = parts.groupBy("page_id", "event").agg(F.sort_array(F.collect_list(F.struct("ord", "piece"))).alias("parts"))
    sides = kinds.select("page_id", "event", F.posexplode("parts").alias("at", "s")).select("page_id", "event", F.when(F.col("at") == 0, SIDES[0]).otherwise(SIDES[1]).alias("side"), F.col("s.piece").alias("part"))
    link = r'<a\b(?=[^<>]*\shref="/jugadores/)[^<>]*>'
    rows = sides.select("page_id", "event", "side", F.posexplode(pieces(F.col("part"), link)).alias("ord", "piece"))
    body = F.regexp_extract("piece", r"(?s)^(.*?)</a>", 1)
    why = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<p\b[^<>]*>(.*?)</p>"), F.lit(1)), clean_text), " | ")
    severity = F.when(F.col("event") == "injury", "light").otherwise("none")
    return _events(rows.select("page_id", "side", "event", "ord", short(body, of_class("truncate", "span")).alias("player"), severity.alias("severity"), F.nullif(why, F.lit("")).alias("reason")), "event")


def sided_lineup(pages: DataFrame) -> DataFrame:
    """Shirts within a wrapper per side. Those without a percentage are the bench and are left out; only keepers have a
    position. The name is the photo's, else the short one."""
    sides = []
    for word, side in zip(("local", "visitante"), SIDES):
        opening = rf"<\w+\b(?=[^<>]*\sclass=\"(?:[^\"]*\s)?campo-wrapper(?=[\s\"])[^\"]*)(?=[^<>]*\sclass=\"(?:[^\"]*\s)?{word}[\s\"])[^<>]*>"
        sides.append(pages.select("page_id", F.lit(side).alias("side"), F.explode(pieces(F.col("html"), opening)).alias("part")))
    rows = sides[0].unionByName(sides[1])
    other = F.regexp_extract("part", rf"(?s)^(<.*?)(?:{of_class('campo-wrapper')}|$)", 1)
    rows = _cut(rows, F.when(other != "", other).otherwise(F.col("part")), of_class("camiseta-wrapper"), "side")
    p = F.col("piece")
    percentage = whole_number(attribute(p, of_class("camiseta", "a"), "data-probabilidad"))
    image = r"<img\b[^<>]*>"
    photo = F.regexp_extract(p, rf"(?s){of_class('fotocontainer')}.*?({image})", 1)
    name = F.coalesce(F.nullif(clean_text(attribute(photo, image, "alt")), F.lit("")), inner(p, of_class("truncate-name")))
    keeper = F.regexp_extract(p, r"^<[^<>]*>", 0).rlike(of_class("portero"))
    rows = rows.select("page_id", "side", "ord", name.alias("player"), F.when(keeper, "POR").alias("position"), percentage.alias("probability"), photo_url(attribute(photo, image, "data-src")).alias("photo"))
    return _players(rows).where("probability is not null")


def absences(pages: DataFrame) -> DataFrame:
    """Injured and suspended players by section; the heading tells the kind, a class the gravity."""
    parts = _cut(pages, F.col("html"), of_class("mod", "section"))
    opening = F.regexp_extract("piece", r"^<[^<>]*>", 0)
    side = F.when(opening.rlike(of_class("local")), SIDES[0]).when(opening.rlike(of_class("visitante")), SIDES[1])
    head = clean_text(F.regexp_extract("piece", r"(?s)<header\b[^<>]*>(.*?)</header>", 1))
    kind = F.when(head.rlike("(?i)lesionados del"), "lesionado").when(head.rlike("(?i)sancionados del"), "sancionado")
    parts = parts.select("page_id", side.alias("side"), kind.alias("kind"), "piece").where("side is not null and kind is not null")
    rows = parts.select("page_id", "side", "kind", F.posexplode(pieces(F.col("piece"), of_class("elemento"))).alias("ord", "piece"))
    p, hurt = F.col("piece"), F.col("kind") == "lesionado"
    rows = rows.where(F.regexp_extract(p, r"^<[^<>]*>", 0).contains(F.col("kind")))
    grade = F.regexp_extract(p, r"gravedad-(\d)", 1)
    severity = F.when(hurt & (grade == "0"), GRAVITY["0"]).when(hurt & (grade == "1"), GRAVITY["1"]).otherwise("moderate")
    event = F.when(hurt, "injury").when(clean_text(p).rlike(SUSPENSION), "suspension").otherwise("transfer")
    rows = rows.select("page_id", "side", "ord", inner(p, of_class("jugador")).alias("player"), event.alias("event"), severity.alias("severity"), inner(p, of_class("lesion")).alias("reason"))
    return rows.where("player is not null")


def row_lineup(pages: DataFrame) -> DataFrame:
    """Two fields one after another; the row of the field tells the position, no percentage means certain."""
    rows = _columns(pages, of_class("campo-futbol", "div"))
    line = rf"<\w+\b[^<>]*\sclass=\"[^\"]*linea-\d[^\"]*\"[^<>]*>"
    rows = rows.select("page_id", "side", F.posexplode(pieces(F.col("part"), line)).alias("row", "part"))
    rows = rows.withColumn("line", F.regexp_extract("part", r"^<[^<>]*linea-(\d)", 1))
    rows = rows.select("page_id", "side", "line", "row", F.posexplode(pieces(F.col("part"), of_class("player", "a"))).alias("at", "piece"))
    p, face = F.col("piece"), of_class("face", "img")
    name = F.trim(F.regexp_replace(F.regexp_replace(attribute(p, face, "alt"), FACE_OF, ""), r"\s+", " "))
    positions = F.create_map(*(F.lit(x) for pair in ROW_POSITIONS.items() for x in pair))
    share = F.coalesce(whole_number(inner(p, of_class("percent-budget"))), F.lit(CERTAIN))
    return _players(rows.select("page_id", "side", (F.col("row") * 1000 + F.col("at")).alias("ord"), name.alias("player"), F.try_element_at(positions, F.col("line")).alias("position"), share.alias("probability"), photo_url(attribute(p, face, "src")).alias("photo")))


def unavailable(pages: DataFrame) -> DataFrame:
    """Cards of players who can't play, by side: those that follow the first field are home's. The picture's class or
    the state's word tells the kind: injury, doubt, suspension, else a light injury. (The
    word 'duda' alone is no doubt: the class must say so.)"""
    rows = _cut(_columns(pages, of_class("campo-futbol", "div")), F.col("part"), of_class("fifa-card", "a"), "side")
    p, face = F.col("piece"), of_class("face", "img")
    state = F.coalesce(short(p, of_class("capitalize", "span")), F.lit(""))
    status = F.regexp_extract(p, rf"(?s){of_class('status')}.*?<img\b[^<>]*\sclass=\"([^\"]*)\"", 1)
    like = lambda pattern: status.rlike(f"(?i){pattern}") | state.rlike(f"(?i){pattern}")
    doubt = status.rlike("(?i)doubt") | state.rlike("(?i)du[aá]")
    event = F.when(like("lesion"), "injury").when(doubt, "doubt").when(like("sanci"), "suspension").otherwise("injury")
    severity = F.when(like("lesion"), "moderate").when(doubt, "none").when(like("sanci"), "moderate").otherwise("light")
    photo = F.nullif(F.regexp_replace(F.trim(attribute(p, face, "alt")), FACE_OF, ""), F.lit(""))
    name = F.coalesce(photo, short(p, of_class("name", "span")))
    why = F.coalesce(attribute(p, of_class("status"), "title"), F.nullif(state, F.lit("")))
    return _events(rows.select("page_id", "side", "ord", name.alias("player"), event.alias("event"), severity.alias("severity"), why.alias("reason")))


def quarantine(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages that gave no row: the layout has changed or the page is broken."""
    return pages.join(rows.select("page_id").distinct(), "page_id", "left_anti")


def run_status(pages: DataFrame, rows: DataFrame, source: str = "source") -> DataFrame:
    """Per source its pages, those read, and success, partial or failed."""
    read = rows.select("page_id").distinct().withColumn("_read", F.lit(1))
    out = pages.join(read, "page_id", "left").groupBy(source).agg(F.count(F.lit(1)).alias("pages"), F.count("_read").alias("read"))
    return out.withColumn("status", F.when(F.col("read") == F.col("pages"), "success").when(F.col("read") > 0, "partial").otherwise("failed"))
