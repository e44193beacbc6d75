"""Joins of names that are nearly equal: candidates by shared q-grams, the edit distance only for these."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_tokens, edit_similarity

#: Length of the pieces by which names meet, and what stands before the first and after the last letter.
Q, EDGE = 2, "\x01"


def pieces(value: Column) -> Column:
    """The q-grams of a text with its edges, numbered where one comes again: as many as it has letters, and one."""
    edged = F.concat(F.lit(EDGE), value, F.lit(EDGE))
    grams = F.transform(F.sequence(F.lit(1), F.length(value) + 1), lambda i: F.substr(edged, i, F.lit(Q)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string")))


def most_edits(length: Column, similarity: float) -> Column:
    """The most edits that a text of a length may be away from one that is as similar, which may be the longer one."""
    return F.floor((1 - similarity) * F.floor(length / F.lit(similarity) + 1e-9) + 1e-9).cast("int")


def edit_join(values: DataFrame, by: list[str], value: str, similarity: float = 0.75) -> DataFrame:
    """by, a, b, similarity: distinct non-empty values of a group, a before b, whose edit similarity (1 - edits / the longer
    length) is at least so much; above 2/3, for then near values must share a piece.

    An edit spoils at most q of a value's pieces. So of two values k edits apart, both put in one global order (rarest
    piece of the group first), the first q * k + 1 pieces of each must have one in common: values meet by these alone, a
    pair counts at its first common one, and the distance is computed for pairs whose lengths allow it."""
    if similarity <= 2 / 3:
        raise ValueError("similarity must be above 2/3")
    rows = values.select(*by, F.col(value).alias("v")).where(F.coalesce(F.col(value), F.lit("")) != "").distinct()
    each = rows.select(*by, "v", F.explode(pieces(F.col("v"))).alias("piece"))
    counts = each.groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(counts, [*by, "piece"]).groupBy(*by, "v").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("p"))
    needed = most_edits(F.length("v"), similarity) * Q + 1
    first = ordered.select(*by, "v", F.transform(F.slice(F.col("p"), F.lit(1), needed), lambda x: x["piece"]).alias("p"))
    a = first.select(*by, F.col("v").alias("a"), F.col("p").alias("pa"), F.explode("p").alias("piece"))
    b = first.select(*by, F.col("v").alias("b"), F.col("p").alias("pb"), F.explode("p").alias("piece"))
    near = (F.col("a") < F.col("b")) & (F.least(F.length("a"), F.length("b")) >= F.greatest(F.length("a"), F.length("b")) * similarity - 1e-9)
    # both prefixes are in the global order of the group, so their first common piece is the same seen from either side
    pairs = a.join(b, [*by, "piece"]).where(near & (F.get(F.array_intersect("pa", "pb"), 0) == F.col("piece")))
    scored = pairs.select(*by, "a", "b", edit_similarity(F.col("a"), F.col("b")).alias("similarity"))
    return scored.where(F.col("similarity") >= similarity)


def name_pairs(rows: DataFrame, by: list[str], key: str, name: str, more: str | None = None, **made: Column) -> DataFrame:
    """All pairs of a group, a before b by key: by, a_key, b_key (and a_more, b_more) with columns made of `a_name` and `b_name`.

    The pairs are as many as the squares of the groups, but what is made of two names is made once for every two distinct
    names of a group and dealt to the pairs that have them, within a task. A row holds the keys of two names of a group."""
    held = F.struct(key, *([more] if more else []))
    one = rows.where(reduce(and_, (F.col(c).isNotNull() for c in by))).groupBy(*by, F.col(name).alias("n")).agg(F.collect_list(held).alias("k"))
    side = lambda s: one.select(*by, F.col("n").alias(f"{s}_name"), F.col("k").alias(f"{s}_rows"))
    met = side("a").join(side("b").hint("merge"), by).select("a_rows", "b_rows", *(c.alias(n) for n, c in made.items()))
    dealt = met.withColumn("a", F.explode("a_rows")).drop("a_rows").withColumn("b", F.explode("b_rows")).drop("b_rows")
    said = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in [key, *([more] if more else [])]]
    return dealt.where(F.col(f"a.{key}") < F.col(f"b.{key}")).select(*said, *made)


def duplicates(players: DataFrame, similarity: float = 0.75) -> DataFrame:
    """team, a, b, kind: players of a team (a before b) who may be one, and why: same_slug, same_name (the same tokens but
    for initials), initial (one has an initial, and the same last name), typo_or_compound (the same beginning and a near
    last name), the first that holds. players: team, player, name, slug.

    Each kind has its own equality to join on, and near last names meet by edit_join: no pairs of a whole team. Players of
    equal name and slug are one row of the pairs, under the smallest player; the others are linked to that one alone."""
    t = F.col("t")
    long = F.array_join(F.filter(t, lambda w: F.length(w) > 1), " ")
    last, first = F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit("")), F.coalesce(F.get(t, 0), F.lit(""))
    rows = players.select("team", "player", F.coalesce("slug", F.lit("")).alias("slug"), all_tokens(F.coalesce("name", F.lit(""))).alias("t"))
    groups = rows.groupBy("team", "slug", "t").agg(F.min("player").alias("lead"))
    copies = rows.join(groups, ["team", "slug", "t"]).where("player != lead").select("team", F.col("lead").alias("a"), F.col("player").alias("b"), F.when(F.col("slug") != "", "same_slug").otherwise("same_name").alias("kind"))
    one = groups.select("team", F.col("lead").alias("player"), "slug", "t", long.alias("long"), last.alias("last"), (F.length(first) == 1).alias("initial"))
    keyed = lambda key, s: one.select("team", key.alias("key"), F.col("player").alias(f"player_{s}")).where("key is not null")
    met = lambda key: keyed(key, "a").join(keyed(key, "b"), ["team", "key"]).where("player_a < player_b").drop("key")
    # an initial meets all of its last name; two of these without an initial need not meet here
    lone = one.where("initial").select("team", F.col("last").alias("key"), F.col("player").alias("p"))
    by_last = lone.join(one.select("team", F.col("last").alias("key"), F.col("player").alias("q")), ["team", "key"]).where("p != q")
    by_initial = by_last.select("team", F.least("p", "q").alias("player_a"), F.greatest("p", "q").alias("player_b")).distinct()
    near = edit_join(one, ["team"], "last", similarity).select("team", F.col("a").alias("x"), F.col("b").alias("y"))
    same = one.where("last != ''").select("team", F.col("last").alias("x"), F.col("last").alias("y")).distinct()
    # the first two tokens of a both among the first two of b: the same two, or one twice
    two = F.slice("t", 1, 2)
    twin = F.get("t", F.lit(0)) == F.get("t", F.lit(1))
    pair_key = F.concat(F.lit("s:"), F.array_join(F.array_sort(two), " "))
    starts_a = F.when(F.size("t") >= 2, F.when(twin, F.concat(F.lit("e:"), F.get("t", F.lit(0)))).otherwise(pair_key))
    starts_b = F.concat(F.when((F.size("t") >= 2) & ~twin, F.array(pair_key)).otherwise(F.array().cast("array<string>")), F.transform(F.array_distinct(two), lambda w: F.concat(F.lit("e:"), w)))
    both = near.unionByName(near.select("team", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(same)
    left = one.select("team", starts_a.alias("start"), F.col("player").alias("player_a"), F.col("last").alias("x")).where("start is not null").join(both, ["team", "x"])
    right = one.select("team", F.explode(starts_b).alias("start"), F.col("player").alias("player_b"), F.col("last").alias("y"))
    typos = left.join(right, ["team", "start", "y"]).where("player_a < player_b").select("team", "player_a", "player_b")
    pair = ["team", "player_a", "player_b"]
    found = [(met(F.nullif(F.col("slug"), F.lit(""))), 0, "same_slug"), (met(F.col("long")), 1, "same_name"), (by_initial, 2, "initial"), (typos, 3, "typo_or_compound")]
    rows = None
    for df, rank, kind in found:
        ranked = df.select(*pair, F.struct(F.lit(rank).alias("r"), F.lit(kind).alias("kind")).alias("k"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    best = rows.groupBy(*pair).agg(F.min("k").alias("k")).select("team", F.col("player_a").alias("a"), F.col("player_b").alias("b"), "k.kind")
    return best.unionByName(copies)

