"""The polling cycle as Structured Streaming: micro-batches update the latest value per key and append dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.state import first_per_key
from ..sinks.store import Change, Store

STATE = "state"


def latest_state(stream: DataFrame, path: str, keys: list[str], order: list[Column], valid: Column, dead: str, checkpoint: str):
    """A query that keeps a store under path with the newest row per key, and appends rows that aren't valid to dead. Each
    batch writes the parts of its own keys, as one version; the version before stays, older ones go. A batch without valid
    rows leaves the state alone; a repeated batch changes nothing."""
    spark = stream.sparkSession
    store = Store(spark, path)

    def batch(rows: DataFrame, number: int) -> None:
        rows.where(~valid).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        good = first_per_key(rows.where(valid), keys, order)
        parts = store.parts_of(good.select(*keys))
        if not parts:
            return
        known = STATE in store.manifest()["tables"]
        newest = first_per_key(store.read(STATE, parts).unionByName(good), keys, order) if known else good
        store.publish({STATE: Change(newest, tuple(keys), parts if known else None)})
        store.vacuum(keep=2)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest state, or None."""
    store = Store(spark, path)
    return store.read(STATE) if store.versions() else None
