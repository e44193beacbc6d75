"""Quality rules by host: rule failures of documents are summed by host, each host's failure rates are shrunk towards
an empirical beta prior, and the verdict on the host is joined back to its documents.

Edge cases: a null or blank text has no words and fails the length rule; a null host is a host like any other;
repeated rows count as often as they stand; an empty table gives an empty result; only the named columns are read, so
further columns cannot clash. Long texts are read whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, small, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules for documents, and the shrunk failure rate above which a host fails a rule."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    host_rate: float = 0.5


def _repeated(w: Column) -> Column:
    """Words of w that lie in a 3-word window found twice or more: window hashes are sorted with their places, places
    with an equal neighbour kept, and the words they cover counted."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    places = let(
        F.sort_array(windows),
        lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(s, x, j - 1) | same(s, x, j + 1), x["i"])), lambda i: i.isNotNull())),
    )
    covered = let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(n >= 3, covered).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long) of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    bare = F.translate(text, BLANKS, "")
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("repeat"))).alias("w"),
        let(bare, lambda b: F.struct(F.length(b).cast("long").alias("chars"), (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias("symbols"))).alias("c"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )


def host_verdicts(measured: DataFrame, flags: dict[str, Column], host: str, rate: float) -> DataFrame:
    """A row per host: its documents, shrunk failure rate per rule, and host_failed (any rate above the limit).

    The prior of a rule is the beta distribution with the mean and the variance of the hosts' own rates."""
    sums = measured.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f.cast("long")).alias(f"k_{r}") for r, f in flags.items()))
    sums = cut(sums)
    stats = sums.agg(
        *(
            x
            for r in flags
            for x in (
                (F.sum(f"k_{r}") / F.sum("n")).alias(f"m_{r}"),
                F.coalesce(F.var_pop(F.col(f"k_{r}") / F.col("n")), F.lit(0.0)).alias(f"v_{r}"),
            )
        )
    ).first()
    failed = F.lit(False)
    for r in flags:
        m, v = stats[f"m_{r}"] or 0.0, stats[f"v_{r}"] or 0.0
        # method of moments; hosts that hardly differ share a strong prior, at most as strong as 1,000 documents
        weight = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        sums = sums.withColumn(f"rate_{r}", (F.col(f"k_{r}") + m * weight) / (F.col("n") + weight)).drop(f"k_{r}")
        failed = failed | (F.col(f"rate_{r}") > rate)
    return sums.withColumn("host_failed", failed)


def quality(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """doc_id, host, the measures, base_failed (length or repetition), the host's shrunk rates, kept."""
    m = F.col("m")
    measured = docs.select("doc_id", F.col(host).alias("host"), measures(F.col("text")).alias("m")).select(
        "doc_id", "host", m["w"]["n"].alias("n_words"), m["c"]["chars"].alias("word_chars"), m["c"]["symbols"].alias("n_symbols"),
        m["l"]["n"].alias("n_lines"), m["l"]["dup"].alias("n_dup_lines"), m["w"]["repeat"].alias("n_repeat_words"),
    )
    measured = cut(measured)
    c = F.col
    flags = {
        "short": c("n_words") < rules.min_words,
        "repeat": 100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > rules.max_symbol_percent * c("word_chars"),
        "lines": 100 * c("n_dup_lines") > rules.max_dup_line_percent * c("n_lines"),
    }
    hosts = cut(host_verdicts(measured, flags, "host", rules.host_rate).drop("n"))
    hosts = hosts.withColumnRenamed("host", "_host")
    joined = measured.join(small(hosts), c("host").eqNullSafe(c("_host")), "left").drop("_host")
    joined = joined.withColumn("base_failed", flags["short"] | flags["repeat"])
    return joined.withColumn("kept", ~c("base_failed") & ~F.coalesce(c("host_failed"), F.lit(False)))
