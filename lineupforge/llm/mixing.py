"""Mixing sources to target weights.

The words of each source, its documents one after another, are packed into blocks of fixed length. For every output
shard the plan draws how many of its slots each source gets: counts that are multinomial given the sources' totals
(slots are dealt to shards by a pseudorandom permutation, which is drawing without replacement from the targets). The
shards are then filled from the plan: a shard's slots of a source are the source's next ones, and the source's k-th slot
maps through a pseudorandom permutation of the source's blocks to a block; a second pass over the blocks starts only
when all were taken once. Blocks are joined by index with the documents' pieces.

Edge cases: a null text has no words; a null source is a source, ordered last; repeated rows are rows of their own;
sources without words get the target 0; an empty table gives an empty result; very long texts span many blocks. Only
doc_id, text and source are read; mixed_documents() keeps further columns apart in a struct, so that no name can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, cut, let, running_offset, small, unboxed, words

#: Words per block, slots per output shard, rounds of the permutations.
BLOCK, SHARD, ROUNDS = 256, 1024, 12


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """The image of x under a permutation of 0..n-1 that key chooses: rounds of the swap-or-not shuffle, in each of
    which x and its partner (k - x mod n) change places or not by a bit hashed from the larger of both."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(y, r):
        return let(
            F.pmod(F.pmod(F.xxhash64(key, r), n) - y, n),
            lambda p: F.when(F.xxhash64(key, r, F.greatest(y, p)).bitwiseAND(F.lit(1)) == 1, p).otherwise(y),
        )

    return F.aggregate(rounds, x.cast("long"), step)


def targets(sizes: DataFrame, weights: list[int], share: float) -> DataFrame:
    """Adds rank, weight and target (double) to a table of source, source_size with a row per source.

    All sources together get share times all words, by weight; a target stops at twice its source's size, and what is
    over goes to the others by weight until none is above. The loop ends after a few rounds: each caps a source more."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    cycle = F.array(*map(F.lit, weights))
    sizes = cut(sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.get(cycle, F.pmod(F.col("rank"), F.lit(len(weights)))).cast("double")))
    total = (sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    level, cap = 0.0, 2.0 * F.col("source_size")
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        capped, weight = sizes.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        new = max(level, (total - capped) / weight) if weight else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return sizes.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def shard_plan(source: DataFrame, total: int, seed: int) -> DataFrame:
    """shard, skey, slots: how many slots of each output shard every source was drawn for. source: skey, start (of the
    source's slots among all, which are total) and slots."""
    # slots: in two steps, so that no row makes more than 4,096 others, and a large source's are dealt over tasks
    parts = source.where("slots > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / 4096))))
    parts = parts.repartition(max(1, min(total // 4096 + 1, source.sparkSession.sparkContext.defaultParallelism * 4)), "skey", "part")
    slot = F.explode(F.sequence(F.col("part") * 4096, F.least(F.col("part") * 4096 + 4095, F.col("slots") - 1)))
    slots = parts.select("skey", "start", slot.alias("k"))
    shard = F.floor(permuted(F.col("start") + F.col("k"), F.lit(max(total, 1)), F.lit(seed)) / SHARD)
    return slots.select("skey", shard.alias("shard")).groupBy("shard", "skey").agg(F.count(F.lit(1)).alias("slots"))


def mix(docs: DataFrame, weights: list[int], share: float, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, draws). rows: a row per document and block it reaches into - doc_id, tie (a hash of the text), source,
    source_size, target, size, offset (in the source's words), block, at (in the block), from (in the document), words;
    documents without words have one row with a null block. draws: a row per slot of the output - shard, seat (the
    place among its source's slots in the shard), skey, block, take (words used: the last slot of a source may use
    fewer), pass (over the source's blocks)."""
    base = docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), F.size(words(F.col("text"))).cast("long").alias("size"))
    base = cut(base.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    sizes = base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    source = targets(sizes, weights, share)
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    source = source.withColumn("want", F.floor(F.col("target") + 0.5).cast("long")).withColumn("blocks", blocks)
    # the last block of a source is shorter: place has its position in the permuted order
    source = source.withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * block)
    source = source.withColumn("key", F.xxhash64("skey", F.lit(seed)))
    source = source.withColumn("place", F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.col("key"), inverse=True)))
    # whole passes over the blocks, and blocks of what is then left; one more where the short block is among these
    rest = F.col("want") - F.floor(F.col("want") / F.col("source_size")) * F.col("source_size")
    last = F.ceil(rest / F.lit(block))
    last = last + (((last > F.col("place")) & (rest > (last - 1) * block + F.col("tail"))).cast("long"))
    source = source.withColumn("slots", F.when(F.col("want") > 0, F.floor(F.col("want") / F.col("source_size")) * F.col("blocks") + last).otherwise(0).cast("long"))
    source = cut(source.withColumn("start", F.sum("slots").over(Window.orderBy("rank")) - F.col("slots")))
    total = source.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    k = F.col("k")
    plan = cut(shard_plan(source, total, seed))
    plan = running_offset(plan, ["skey"], ["shard"], "slots", "first", plan.count())
    draws = plan.join(small(source.select("skey", "want", "blocks", "tail", "key", "place")), "skey")
    draws = draws.withColumn("seat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).withColumn("k", F.col("first") + F.col("seat"))
    before = k * block - (F.lit(block) - F.col("tail")) * (F.floor(k / F.col("blocks")) + (k % F.col("blocks") > F.col("place")).cast("long"))
    draws = draws.withColumn("block", permuted(k % F.col("blocks"), F.col("blocks"), F.col("key")))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block))
    draws = draws.withColumn("take", F.least(length, F.col("want") - before))
    draws = draws.select("shard", "seat", "skey", "block", "take", F.floor(k / F.col("blocks")).alias("pass"))

    rows = running_offset(base, ["skey"], ["doc_id", "tie", "size"], "size", "offset", base.count())
    rows = rows.join(small(source.select("skey", "source_size", "target")), "skey")
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    rows = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))))
    rows = rows.withColumn("from", F.greatest(F.lit(0), F.col("block") * block - F.col("offset")))
    rows = rows.withColumn("at", F.col("offset") + F.col("from") - F.col("block") * block)
    rows = rows.withColumn("words", F.least(F.lit(block) - F.col("at"), F.col("size") - F.col("from")))
    return rows, draws


def joined(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """Pieces of documents as drawn: rows joined by block index with the draws, used being the words taken of a piece."""
    used = F.greatest(F.lit(0), F.least(F.col("at") + F.col("words"), F.col("take")) - F.col("at"))
    # the draws come of a small table but are many: without the hint Spark takes them for small and broadcasts them
    return rows.join(draws.hint("merge"), ["skey", "block"], "left").withColumn("used", F.when(F.col("take").isNotNull(), used).otherwise(0))


def mixed_words(docs: DataFrame, weights: list[int], share: float, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    rows, draws = mix(docs, weights, share, seed, block)
    keys = ["skey", "offset", "doc_id", "tie", "size", "source_size", "target"]
    # documents without words share offsets, so equal ones are counted and spread again
    pieces = joined(rows, draws)
    full = pieces.where("size > 0").groupBy(*keys).agg(F.sum("used").alias("taken"))
    none = pieces.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed_shards(docs: DataFrame, weights: list[int], share: float, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """The output shards: shard, source, seat, block, doc_id, from, used: the words of documents that each slot holds."""
    rows, draws = mix(docs, weights, share, seed, block)
    return joined(rows, draws).where("used > 0").select("shard", "source", "seat", "block", "doc_id", "from", "used")


def mixed_documents(docs: DataFrame, weights: list[int], share: float, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """The mix as documents: for each document and each pass over its source that takes words of it, a row with docs'
    columns, whose text is the words taken, joined by spaces (the text itself where all are taken); n_chars is counted
    anew. Repeated rows share the columns of one of them."""
    rows, draws = mix(docs, weights, share, seed, block)
    c = F.col
    used = joined(rows, draws).where("used > 0").groupBy("skey", "offset", c("doc_id").alias("_id"), "tie", c("size").alias("_size"), "pass")
    used = cut(used.agg(F.sort_array(F.collect_list(F.struct("from", "used"))).alias("_ranges"), F.sum("used").alias("_used")).drop("offset", "pass"))
    texts = docs.select(boxed(docs), "doc_id", "text", F.xxhash64("text").alias("_tie"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_skey"))
    if texts.groupBy("doc_id", "_tie", "_skey").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "_tie", "_skey"])
    out = texts.join(used, c("doc_id").eqNullSafe(c("_id")) & (c("_tie") == c("tie")) & (c("_skey") == c("skey")))
    taken = let(words(c("text")), lambda w: F.array_join(F.flatten(F.transform("_ranges", lambda r: F.slice(w, (r["from"] + 1).cast("int"), r["used"].cast("int")))), " "))
    return unboxed(out, docs, F.when(c("_used") == c("_size"), c("text")).otherwise(taken))
