"""Source divergence audit: how far the sources of a language stand apart in their use of terms.

Terms are counted by language and source, a language keeps those in at least three of its documents, and each kept term
becomes a wide vector: its counts, indexed by the sources of the language. Higher-order functions emit a row for each pair
of sources that a term adds to; equal ones (same sources, same counts) are counted before they are shuffled, and what they
add is computed once for all of them and summed.

A share is p = 1 + floor(1e9 * (count + 1) / (N + V)), N the counts of the group over the V kept terms; the divergence of
p from q is floor((p - q)^2 / q). All of it is long arithmetic, exact up to 9e15 terms counted.

Edge cases: null text, lang and source are read as ''; a group without terms, or a language without kept terms, has its
rows all the same (value 0 where V is 0); repeated rows and rows with a null doc_id are documents of their own; ties go
by item in UTF-8 order; an empty table gives an empty result; long texts are read whole; only text, lang and source are
read, so further columns can't clash."""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: A term, in UTF-8 bytes whose A-Z are lower-cased: letters of ASCII and all characters beyond it.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that a task holds before it passes their counts on, and documents, for a term's two counts share an integer.
HELD, DOCUMENTS = 700_000, 1 << 24
#: Parts into which a group's terms are dealt before its leaders are chosen from the leaders of the parts.
PARTS = 16


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / total) for count < total, three decimal digits at a time: exact below 9e15."""
    rest, value = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        value = value * 1000 + _div(rest * 1000, total)
        rest = (rest * 1000) % total
    return value + 1


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents (that have it). Tasks count what they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, dict[bytes, int]] = defaultdict(dict)  # n * DOCUMENTS + documents, by term

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                both = np.fromiter(found.values(), np.int64, len(found))
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(both), np.int64)))
                columns = [same(lang), same(source), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(both // DOCUMENTS), pa.array(both % DOCUMENTS)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
            counts.clear()

        held = documents = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = counts[lang, source]
                held -= len(found)
                for term, n in Counter(TERM.findall(text.lower())).items():  # lower() of bytes changes A-Z alone
                    found[term] = found.get(term, 0) + n * DOCUMENTS + 1
                held += len(found)
                documents += 1
                if held > HELD or documents == DOCUMENTS - 1:
                    yield from flushed()
                    held = documents = 0
        yield from flushed()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    each = rows.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def vectors(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(kept terms: lang, term, total, counts - an array of (ix, n) of the sources that have it; languages: lang, v, total,
    sources - an array of (ix, source, n), ix from 0 in UTF-8 order)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct()
    groups = cut(groups.withColumn("ix", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    counted = term_counts(docs).join(small(groups), ["lang", "source"])
    kept = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("ix", "n"))).alias("counts"))
    kept = cut(kept.where(F.col("documents") >= least).drop("documents"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total"))
    sums = kept.select("lang", F.inline("counts")).groupBy("lang", "ix").agg(F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    filled = groups.join(sums, ["lang", "ix"], "left").join(size, "lang", "left").select("lang", "ix", "source", zero("n"), zero("v"), zero("total"))
    langs = filled.groupBy("lang", "v", "total").agg(F.sort_array(F.collect_list(F.struct("ix", "source", "n"))).alias("sources"))
    return kept, cut(langs)


def count_pairs(kept: DataFrame) -> DataFrame:
    """lang, i, j, n, m, terms: the number of kept terms that stand n times in source i and m times in source j, i < j."""
    both = lambda a: F.transform(F.filter("counts", lambda b: b["ix"] > a["ix"]), lambda b: F.struct(a["ix"].alias("i"), b["ix"].alias("j"), a["n"].alias("n"), b["n"].alias("m")))
    pairs = kept.select("lang", F.inline(F.flatten(F.transform("counts", both))))
    return pairs.groupBy("lang", "i", "j", "n", "m").agg(F.count(F.lit(1)).alias("terms"))


def source_pairs(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the divergence of source from item, summed over the kept terms.

    What a term adds depends on its two counts alone, so terms are counted by these, and each sum starts with V times what
    a term adds that neither source has, corrected by the terms that one of them has, then by those that both have."""
    c, zero = F.col, F.lit(0).cast("long")
    f = lambda n, m: apart(share(n, c("total_i") + c("v")), share(m, c("total_j") + c("v")))
    told = lambda df: df.join(small(langs.select("lang", "v", "sources")), "lang")
    totals = lambda df: df.withColumns({f"total_{k}": c("sources")[c(k)]["n"] for k in "ij"})
    turned = lambda df: df.select("lang", c("j").alias("i"), c("i").alias("j"), c("m").alias("n"), c("n").alias("m"), "terms")
    others = lambda df: totals(df.withColumn("j", F.explode(F.transform("sources", lambda s: s["ix"]))).where(c("i") != c("j")))
    neither = others(langs.select("lang", "v", "sources", F.explode(F.transform("sources", lambda s: s["ix"])).alias("i")))
    held = kept.select("lang", F.inline("counts")).groupBy("lang", c("ix").alias("i"), "n").agg(F.count(F.lit(1)).alias("terms"))
    first = others(told(held.withColumn("m", zero)))
    second = totals(told(turned(first)))
    pairs = count_pairs(kept)
    both = totals(told(pairs.unionByName(turned(pairs))))
    parts = [
        (neither, F.when(c("v") > 0, c("v") * f(zero, zero)).otherwise(0)),
        (first, c("terms") * (f(c("n"), zero) - f(zero, zero))),
        (second, c("terms") * (f(zero, c("m")) - f(zero, zero))),
        (both, c("terms") * (f(c("n"), c("m")) - f(c("n"), zero) - f(zero, c("m")) + f(zero, zero))),
    ]
    added = [df.select("lang", "i", "j", value.alias("value")).groupBy("lang", "i", "j").agg(F.sum("value").alias("value")) for df, value in parts]
    sums = functools.reduce(DataFrame.unionByName, added).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    return told(sums).select("lang", c("sources")[c("i")]["source"].alias("source"), c("sources")[c("j")]["source"].alias("item"), "value")


def leading_terms(kept: DataFrame, langs: DataFrame, most: int) -> DataFrame:
    """lang, source, item (a term that the source uses more than its language does), value, rank up to most."""
    c = F.col
    named = kept.withColumnRenamed("total", "n_lang").join(small(langs), "lang")
    joined = named.select("lang", "term", share(c("n_lang"), c("total") + c("v")).alias("q"), "v", "sources", F.inline("counts"))
    own = c("sources")[c("ix")]
    scored = joined.select("lang", own["source"].alias("source"), c("term").alias("item"), "q", share(c("n"), own["n"] + c("v")).alias("p"))
    scored = scored.where(c("p") > c("q")).select("lang", "source", "item", apart(c("p"), c("q")).alias("value"))
    order = [c("value").desc(), c("item")]
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    scored = scored.withColumn("part", part).withColumn("rank", first).where(c("rank") <= most).drop("part", "rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(c("rank") <= most)


def audit(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' rows for each other source of the language, 'term' rows for the most
    leading terms of the source against its language."""
    kept, langs = vectors(docs, least)
    pairs = source_pairs(kept, langs).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    tell = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return tell(pairs, "pair").unionByName(tell(leading_terms(kept, langs, most), "term"))
