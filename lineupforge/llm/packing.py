"""Packing by optimal length buckets: dynamic programming over the global histogram of lengths chooses the bucket
boundaries that minimise padding; inside each bucket, batches form within a budget of tokens.

A document longer than the longest bucket is cut into pieces of that length and a rest, so no token is lost. Documents
without tokens (null or blank text) are in no batch: one row with piece 0, length 0 and null bucket and batch.
Repeated rows are packed as rows of their own; ties (equal lengths) are ordered by hash. An empty table gives an empty
result. Only doc_id and text are read. The histogram has a row per length, at most max_len, whatever the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_offset, words

MAX_LEN, BUCKETS, BUDGET = 2048, 12, 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most so many buckets with the least padding in all: best[k][j] is the least padding of the
    lengths up to j in k buckets, the last of which reaches from i to j and pads all its rows to lengths[j]."""
    if not lengths:
        return []
    size, number = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    n = len(size)
    rows, tokens = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * size)])
    best, choice = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            at[j] = cost.argmin()
            new[j] = cost[at[j]]
        choice.append(at)
        best = new
    ends, j = [], n
    for at in reversed(choice):
        if j:
            ends.append(int(lengths[j - 1]))
            j = at[j]
    return ends[::-1]


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, length, bucket (the length to which its rows are padded), batch (number within the
    bucket), seat (place in the batch). A batch has at most budget // bucket rows."""
    c = F.col
    base = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.size(words(c("text"))).cast("long").alias("n"))
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((c("n") - 1) / max_len)))))
    pieces = cut(pieces.withColumn("start", c("piece") * max_len).withColumn("length", F.least(F.lit(max_len), c("n") - c("piece") * max_len)))
    histogram = pieces.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("rows")).orderBy("length").collect()
    ends = boundaries([r["length"] for r in histogram], [r["rows"] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(c("length") <= end, F.lit(end).cast("long")).otherwise(bucket)
    pieces = pieces.withColumn("bucket", F.when(c("length") > 0, bucket)).withColumn("one", F.lit(1).cast("long"))
    filled = running_offset(pieces.where("bucket is not null"), ["bucket"], ["doc_id", "tie", "piece"], "one", "place", sum(r["rows"] for r in histogram))
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / c("bucket")))
    filled = filled.withColumn("batch", F.floor(c("place") / rows)).withColumn("seat", c("place") % rows)
    empty = pieces.where("bucket is null").withColumns({"batch": F.lit(None).cast("long"), "seat": F.lit(None).cast("long")})
    out = ["doc_id", "piece", "start", "length", "bucket", "batch", "seat"]
    return filled.select(out).unionByName(empty.select(out))
