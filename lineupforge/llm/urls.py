"""URL filters by association rules: Spark's FP-growth mines combinations of URL tokens from labelled URLs, rules pruned by
confidence and support remain, and an inverted index finds those that match a URL.

A list of host and path rules comes first: it decides the URLs it fits, and these are the labelled ones. What no listed rule
fits is judged by the best mined rule whose tokens the URL has (highest confidence, then support, fewest tokens, least
tokens), else by the default.

The index holds a rule once, under the token of its antecedent that the fewest token sets have, so that a token in every URL
leads to no rule unless the rule has no other. URLs with the same tokens are judged once.

All tokens of the labelled URLs are mined. Tokens of which no larger rule can outlast pruning don't enter FP-growth and get
their own rule from counts: those whose URLs all have one label (no larger rule is more confident) and those that all URLs
have (a larger rule is as confident without them). Frequent sets may still double with each other token that stands in many
URLs of both labels. `width` is a bound for that: a labelled URL then enters with its `width` most telling tokens only
(those whose own labels differ most from the average, by standard errors), and rules of the others are left out. Judging
uses all tokens; labels, supports and confidences are counted over all labelled URLs.

Edge cases: a null URL, or one without `://`, has an empty host and path, no tokens, and the default verdict; without
labelled URLs, or of one label only, nothing is mined or every mined rule has that label; a token often repeated in a URL
counts once; repeated rows count as often as they stand when rules are mined and are judged alike; ties are settled as
said; an empty table gives an empty result; very long URLs are read whole; only the named columns are read, so further
columns can't clash."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
#: Prefix of the item that stands for a label beside the tokens; no token starts so.
LABEL = "="


@dataclass(frozen=True)
class Mining:
    """min_support: share of the labelled URLs, min_count: their number, that an antecedent and its label need at least."""

    min_support: float = 0.002
    min_count: int = 3
    min_confidence: float = 0.9
    #: None: all tokens of a URL are mined; else its most telling ones, so many at most
    width: int | None = None


def host(url: Column) -> Column:
    """After the first `://` up to / ? # or the end, A-Z lower-cased; '' for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end; '' for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, `host/path`) that fits, both null if none does. A rule fits
    its host and all subdomains if the path starts with the rule's."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, start = rule.split("/", 1)
        fits.append((((host == name) | host.endswith("." + name)) & path.startswith("/" + start), rule, verdict))
    first = lambda k: F.coalesce(*(F.when(fit[0], fit[k]) for fit in fits), F.lit(None).cast("string"))
    return first(1), first(2)


def tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, sorted: labels of the host (`h:`) and words of the path (`p:`), runs of digits as #."""
    words = lambda text, mark, stop: F.transform(F.filter(F.split(text, stop), lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.regexp_replace(w, "[0-9]+", "#")))
    return F.array_sort(F.array_distinct(F.concat(words(host, "h:", r"\."), words(F.translate(path, UPPER, LOWER), "p:", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))))


def narrowed(labelled: DataFrame, width: int) -> DataFrame:
    """labelled (tokens, label) with at most width tokens a row, those whose share of `block` is the most standard errors
    away from the average; ties by token."""
    wide = labelled.where(F.size("tokens") > width).select("tokens").distinct()
    each = labelled.select(F.explode("tokens").alias("token"), (F.col("label") == BLOCK).cast("long").alias("k"))
    stats = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    base = labelled.agg(F.avg((F.col("label") == BLOCK).cast("double"))).first()[0]
    stats = cut(stats.select("token", (-F.round(F.abs(F.col("k") - F.col("n") * F.lit(base)) / F.sqrt("n"), 9)).alias("z")))
    by = wide.select("tokens", F.explode("tokens").alias("token")).join(small(stats), "token").groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("z", "token"))).alias("by"))
    fewer = cut(by.select("tokens", F.transform(F.slice("by", 1, width), lambda x: x["token"]).alias("fewer")))
    return labelled.join(small(fewer), "tokens", "left").select(F.coalesce("fewer", "tokens").alias("tokens"), "label")


def settled(labelled: DataFrame, rows: int, least: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """labelled without the tokens whose larger rules are all pruned (see above), and the rules of these tokens alone, with
    support of least and so much confidence at least. rows: those of labelled."""
    counts = cut(labelled.select(F.explode("tokens").alias("token"), "label").groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("token").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
    alone = cut(total.where((F.col("labels") == 1) | (F.col("all") == rows)).drop("labels"))
    share = F.col("n") / F.col("all")
    rules = counts.join(small(alone), "token").where((F.col("n") >= least) & (share >= confidence)).select(F.array("token").alias("antecedent"), "label", share.alias("confidence"), F.col("n").alias("support"))
    others = labelled.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(small(alone.select("token")), "token", "left_anti")
    others = cut(others.groupBy("tokens").agg(F.collect_list("token").alias("others")))
    return labelled.join(small(others), "tokens", "left").select(F.coalesce("others", F.array().cast("array<string>")).alias("tokens"), "label"), rules


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules from labelled (tokens, label): antecedent (sorted tokens), label, confidence, support (number of URLs).

    A rule is pruned if another of a part of its tokens and the same label is as confident."""
    sizes = labelled.agg(F.count(F.lit(1)), F.max(F.size("tokens"))).first()
    if not sizes[0]:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, label string, confidence double, support long")
    if mining.width is not None and sizes[1] > mining.width:
        labelled = narrowed(labelled, mining.width)
    least = max(mining.min_support, min(1.0, (mining.min_count - 0.5) / sizes[0]))  # half a row below, for rounding
    fitted, alone = settled(labelled, sizes[0], max(math.ceil(least * sizes[0]), mining.min_count), mining.min_confidence)
    items = fitted.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=mining.min_confidence).fit(items)
    label = F.col("consequent")[0]
    found = model.associationRules.where(label.startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
    support = F.round(F.col("support") * sizes[0]).cast("long")
    rules = cut(found.select(F.array_sort("antecedent").alias("antecedent"), F.substr(label, F.lit(len(LABEL) + 1)).alias("label"), "confidence", support.alias("support")).where(F.col("support") >= mining.min_count).unionByName(alone))
    return pruned(rules)


def pruned(rules: DataFrame) -> DataFrame:
    """rules (a written table) without those for which another of a part of the tokens and the same label is as confident."""
    sets = rules.select(F.col("antecedent").alias("tokens")).distinct()
    inside = matching(sets, rules).select("tokens", "rule.*").where(F.size("antecedent") < F.size("tokens"))
    parts = inside.groupBy(F.col("tokens").alias("antecedent"), "label").agg(F.max("confidence").alias("part"))
    return rules.join(parts, ["antecedent", "label"], "left").where(F.coalesce(F.col("part") < F.col("confidence"), F.lit(True))).drop("part")


def matching(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, rule: each of the distinct token sets with each rule whose antecedent it holds, by an inverted index of the
    rules under their rarest token."""
    each = sets.select("tokens", F.explode("tokens").alias("token"))
    needed = rules.select(F.explode("antecedent").alias("token")).distinct()
    held = cut(each.join(small(cut(needed)), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("sets")))
    entries = rules.select(F.struct(*rules.columns).alias("rule")).select("rule", F.explode("rule.antecedent").alias("token"))
    # a token that no set holds is missing from held: its rule matches nothing
    counted = entries.join(small(held), "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("sets", F.lit(0)), "token")).alias("rarest"))
    index = cut(counted.select("rule", F.col("rarest.token").alias("token")))
    near = each.join(small(index), "token")
    return near.where(F.size(F.array_except("rule.antecedent", "tokens")) == 0).select("tokens", "rule")


def judged(urls: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = (), mining: Mining = Mining(), default: str = ALLOW) -> DataFrame:
    """key, host, path, rule (the listed one that fits, else null), mined (the tokens of the mined rule that decides, else
    null), confidence, verdict."""
    parts = urls.select(F.col(key).alias("key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    known = cut(parts.select("key", "host", "path", rule.alias("rule"), verdict.alias("label"), tokens(F.col("host"), F.col("path")).alias("tokens")))
    learnt = mine(known.where(F.col("label").isNotNull()).select("tokens", "label"), mining)
    open_sets = cut(known.where(F.col("label").isNull()).groupBy("tokens").agg(F.count(F.lit(1)).alias("rows")).select("tokens"))
    order = F.struct((-F.col("rule.confidence")).alias("c"), (-F.col("rule.support")).alias("s"), F.size("rule.antecedent").alias("n"), F.col("rule.antecedent").alias("antecedent"), F.col("rule.label").alias("label"))
    best = cut(matching(open_sets, cut(learnt)).groupBy("tokens").agg(F.min(order).alias("best")))
    out = known.join(small(best), "tokens", "left")
    mined = F.col("label").isNull()
    return out.select(
        F.col("key").alias(key), "host", "path", "rule", F.when(mined, F.col("best.antecedent")).alias("mined"),
        F.when(mined, -F.col("best.c")).alias("confidence"), F.coalesce("label", "best.label", F.lit(default)).alias("verdict"),
    )
