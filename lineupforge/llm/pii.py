"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Strict patterns find the seed entities (emails, IP addresses, card and phone numbers); looser ones find candidates, that
is, tokens of the same shapes that the strict ones refuse. What stands around either is a lexical pattern of its kind:
the word before, the two words before, the words on both sides. Patterns and instances (values) form a bipartite graph that is
gone through generation by generation. A pattern's score is the share of its occurrences, over all documents, that hold
accepted instances; with ACCEPT or more, and SUPPORT different accepted instances, it accepts all its instances, which
support further patterns in the next generation, until none is added. At first only seeds are accepted. Each occurrence
of an accepted candidate becomes a span of its kind.

Scores only rise from one generation to the next, and fall with the number of occurrences. So the graph is gone through
twice: first with the candidates' occurrences alone, which leaves few patterns; for these all documents are counted.

Spans are code points, end exclusive; a base span of one kind may overlap another kind's. Edge cases: a null text is
empty; repeated rows get the same spans each; an empty table gives an empty result; find() reads only doc_id and text,
and redact() keeps further columns apart in a struct, so that no name can clash. Very long texts are read whole:
quantifiers are possessive or simple classes, so long runs need no deep recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, beside, boxed, cut, let, small, unboxed, words

SUPPORT, ACCEPT = 3, 0.8
KINDS = ("email", "ip", "card", "phone")
# Equal to the plain patterns of the contract: the look-behinds only skip starts inside a run that failed at its start.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![^\x20\x09-\x0D@])|\G)[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9+])[0-9](?:[\x20-]?[0-9]){12,18}+",
    "phone": r"(?<![0-9])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: What may join a word to the value after it, as in "tel:". Read backwards: the two words before; forwards: the word after.
GLUE = ":=#("
BEFORE = rf"^(?:{SPACE}+|(?=[{GLUE}]))([^\x20\x09-\x0D]++(?:{SPACE}+[^\x20\x09-\x0D]++)?+)"
AFTER = rf"^{SPACE}+([^\x20\x09-\x0D]++)"
SPANS = "array<struct<start:int,kind:int,end:int,value:string,left:string,right:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The checksum of a row of at most 19 digits."""
    turned = F.reverse(digits)

    def value(i):
        d = F.substring(turned, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(x), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _left(gap: Column) -> Column:
    """The last two words (or one) of what stands before a value, lower-cased; read backwards, in one step however long."""
    return F.regexp_replace(F.lower(F.reverse(F.regexp_extract(F.reverse(gap), BEFORE, 1))), SPACE, " ")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost matches as structs of start, kind (its number), end, value, left and right (the words around it). A match
    starts where the pieces between matches, and the matches so far, end."""
    k = F.lit(KINDS.index(kind))

    def placed(m):
        pieces = let(
            F.split(text, pattern, -1),
            lambda g: F.transform(m, lambda x, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(x).alias("n"), x.alias("value"), _left(F.get(g, i)).alias("left"), F.lower(F.regexp_extract(F.get(g, i + 1), AFTER, 1)).alias("right"))),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(a, p):
            start = a["at"] + p["gap"]
            span = F.struct(start.alias("start"), k.alias("kind"), (start + p["n"]).alias("end"), p["value"].alias("value"), p["left"].alias("left"), p["right"].alias("right"))
            return F.struct((start + p["n"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(pieces, zero, step, lambda a: a["out"])

    none = F.array().cast(SPANS)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    needed = NEEDS[kind] if pattern == STRICT[kind] else NEEDS[kind].replace("+", "")
    return F.when(text.contains(needed), found).otherwise(none) if needed else found


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), base (valid strict spans by start and kind) and loose (candidates that overlap
    no base span)."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digits = text.rlike("[0-9@]")
    none = F.array().cast(SPANS)
    every = F.concat(*(F.filter(_matches(text, k, STRICT[k]), _checked(k)) for k in KINDS))
    likely = F.concat(*(_matches(text, k, LOOSE[k]) for k in KINDS))
    apart = lambda b: F.filter(likely, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    both = let(F.when(digits, F.sort_array(every)).otherwise(none), lambda b: F.struct(b.alias("base"), F.when(digits, apart(b)).otherwise(none).alias("loose")))
    return rows.select("doc_id", F.xxhash64("text").alias("tie"), both.alias("s")).select("doc_id", "tie", "s.base", "s.loose")


def graph(spans: DataFrame) -> DataFrame:
    """The edges: kind, pattern (one or two words before, or the word before, ">" and the word after), value, n, seed
    (boolean)."""

    def edges(col: str, seed: bool) -> DataFrame:
        s = spans.where(F.size(col) > 0).select(F.explode(col).alias("s")).select("s.*")
        last = F.element_at(F.split("left", " "), -1)
        forms = F.array(last, F.col("left"), F.when(F.col("right") != "", F.concat(last, F.lit(" > "), F.col("right"))))
        patterns = F.when(F.col("left") != "", F.array_distinct(F.filter(forms, lambda p: p.isNotNull())))
        return s.select("kind", "value", F.explode(patterns).alias("pattern"), F.lit(seed).alias("seed"))

    every = edges("base", True).unionByName(edges("loose", False))
    return every.groupBy("kind", "pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, uses: how often each pattern's words stand in all documents, with anything at all as the value (for words
    on both sides: one token)."""
    c = F.col
    wanted = patterns.select("pattern").distinct()
    vocabulary = small(cut(wanted.select(F.element_at(F.split(F.split_part("pattern", F.lit(" > "), F.lit(1)), " "), -1).alias("word")).distinct()))
    text = words(F.lower(F.coalesce(c("text"), F.lit(""))))
    at = lambda w, i: F.get(w, i)
    token = docs.select(F.explode(let(text, lambda w: F.transform(w, lambda x, i: F.struct(at(w, i - 1).alias("before"), x.alias("own"), at(w, i + 1).alias("next"), at(w, i + 2).alias("after"))))).alias("t")).select("t.*")
    # a word counts as it stands, and as what is glued to the front of a value
    glued = F.regexp_extract("own", rf"^([^0-9+@]*[{GLUE}])", 1)
    forms = F.array(F.struct(c("own").alias("word"), "after"), F.struct(F.when(glued != c("own"), glued).alias("word"), c("next").alias("after")))
    token = token.select("before", F.explode(forms).alias("f")).select("before", "f.word", "f.after").where("word != ''").join(vocabulary, "word", "left_semi")
    said = F.array(c("word"), F.concat_ws(" ", "before", "word"), F.concat_ws(" > ", "word", "after"))
    said = token.select(F.explode(F.array_distinct(said)).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("uses"))
    return said.join(small(wanted), "pattern", "left_semi")


def grown(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, accepted) after the last generation: kind, pattern, score; and kind, value, generation. edges: those
    of graph() with uses (null: as often as the pattern's instances stand)."""
    c = F.col
    edges = cut(edges.withColumn("generation", F.when(c("seed"), 0)))
    for generation in range(1, 1 << 30):
        known = c("generation").isNotNull()
        score = F.sum(F.when(known, c("n")).otherwise(0)) / F.greatest(F.coalesce(F.max("uses"), F.lit(0)), F.sum("n"))
        patterns = edges.groupBy("kind", "pattern").agg(score.alias("score"), F.sum(known.cast("int")).alias("support"))
        patterns = cut(patterns.where((c("score") >= ACCEPT) & (c("support") >= SUPPORT)).select("kind", "pattern", "score"))
        fresh = cut(edges.where(~known).join(small(patterns), ["kind", "pattern"], "left_semi").select("kind", "value").distinct())
        if not fresh.count():
            break
        edges = edges.join(small(fresh.withColumn("_new", F.lit(generation))), ["kind", "value"], "left")
        edges = cut(edges.withColumn("generation", F.coalesce("generation", "_new")).drop("_new"))
    return patterns, edges.where(c("generation").isNotNull()).groupBy("kind", "value").agg(F.min("generation").alias("generation"))


def bootstrapped(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grown() over all documents. spans: what extracted() found in docs."""
    edges = cut(graph(spans).withColumn("uses", F.lit(None).cast("long")))
    hopeful, _ = grown(edges)
    edges = edges.join(small(hopeful.select("kind", "pattern")), ["kind", "pattern"], "left_semi").drop("uses")
    return grown(edges.join(small(cut(occurrences(docs, hopeful))), "pattern", "left"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, tie, base and spans: arrays of start, kind, end and value by start and kind; spans has base and what
    the patterns discovered."""
    c = F.col
    spans = cut(extracted(docs))
    good = small(cut(bootstrapped(docs, spans)[1].where("generation > 0").select("kind", "value")))
    bare = lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])
    more = spans.where(F.size("loose") > 0).select("doc_id", "tie", F.explode("loose").alias("s")).select("doc_id", "tie", bare(c("s")).alias("s"), "s.kind", "s.value")
    more = more.join(good, ["kind", "value"], "left_semi").groupBy(c("doc_id").alias("_id"), c("tie").alias("_tie")).agg(F.collect_set("s").alias("more"))
    rows = spans.join(small(cut(more)), c("doc_id").eqNullSafe(c("_id")) & (c("tie") == c("_tie")), "left")
    base = F.transform("base", bare)
    return rows.select("doc_id", "tie", base.alias("base"), F.when(c("more").isNull(), base).otherwise(F.sort_array(F.concat(base, c("more")))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one, of the kind that
    starts first. A null text stays null, n_chars (if there) is counted anew."""
    c = F.col
    found = find(docs).where(F.size("spans") > 0).select(c("doc_id").alias("_id"), c("tie").alias("_tie"), c("spans").alias("_spans")).dropDuplicates(["_id", "_tie"])
    rows = docs.select(boxed(docs), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    rows = rows.join(beside(cut(found)), c("doc_id").eqNullSafe(c("_id")) & (c("tie") == c("_tie")), "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(c("text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    clean = F.aggregate("_spans", zero, step, lambda a: F.concat(a["out"], F.substring(c("text"), a["at"] + 1, F.length(c("text")))))
    return unboxed(rows, docs, F.when(c("_spans").isNull(), c("text")).otherwise(clean))
