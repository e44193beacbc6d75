"""A cascade over what is left: each stage is asked only for what no earlier one decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import written
from .state import first_per_key


def residual(items: DataFrame, key: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """A row per distinct key of items: key, stage (that decided, null if none), answer, confidence, failures (array of
    stage and reason, in order).

    A stage takes the items that are open (all their columns) and returns rows of key, answer, confidence, reason. A row
    with an answer decides its key; one without is a failure that says why; a key without any row failed without a
    reason. Of several rows on a key the most confident answer counts, then the smallest. What a stage says of keys that
    are not open is passed over, so a stage cannot overrule an earlier one. Each stage's rows are written once."""
    left = items.where(F.col(key).isNotNull())
    decided: DataFrame | None = None
    failed: DataFrame | None = None
    for number, (name, stage) in enumerate(stages):
        said = stage(left).select(key, F.col("answer").cast("string").alias("answer"), F.col("confidence").cast("double").alias("confidence"), F.col("reason").cast("string").alias("reason"))
        asked = left.select(key).distinct()
        best = first_per_key(said, [key], [F.desc(F.col("answer").isNotNull()), F.desc_nulls_last("confidence"), "answer", "reason"])
        told = written(asked.join(best, key, "left").withColumns({"stage": F.lit(name), "number": F.lit(number)}))
        done, open_ = told.where("answer is not null"), told.where("answer is null").select(key, "number", "stage", "reason")
        decided = done if decided is None else decided.unionByName(done)
        failed = open_ if failed is None else failed.unionByName(open_)
        left = left.join(open_.select(key), key, "left_semi")
    keys = items.where(F.col(key).isNotNull()).select(key).distinct()
    if decided is None or failed is None:
        raise ValueError("a cascade needs a stage")
    why = failed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("number", "stage", "reason"))).alias("f"))  # a row per stage at most
    out = keys.join(decided.select(key, "stage", "answer", "confidence"), key, "left").join(why, key, "left")
    failures = F.transform(F.coalesce("f", F.array().cast("array<struct<number:int,stage:string,reason:string>>")), lambda x: F.struct(x["stage"].alias("stage"), x["reason"].alias("reason")))
    return out.select(key, "stage", "answer", "confidence", failures.alias("failures"))
