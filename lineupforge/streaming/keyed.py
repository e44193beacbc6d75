"""Keyed state in Spark's own state store: the newest value per key with event-time expiry, instead of tables that a batch
writes anew.

latest_values() keeps one value per live key and a timer. A row that is newer than the value replaces it and is put out as
'live'; an older one is passed over; when the watermark passes a value's time plus its time to live, the value goes, from
the state too, and is put out as 'expired'. Rows behind the watermark are dropped by Spark before they reach the state (the
query's progress counts them). Where nothing is said of a key for so long, its state is gone, so the state is as large as
the keys that live. The session needs the RocksDB state store (see PROVIDER)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.state import first_per_key, upsert
from ..sinks.store import Change, Store

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LIVE, EXPIRED = "live", "expired"
STAMP, ORDER, AT = "stamp_ms", "order_in_stamp", "event_time"


class Latest(StatefulProcessor):
    """The newest row of a key. Rows of one time are told apart by the order column, the greater one is the newer."""

    def __init__(self, keys: list[str], values: StructType, ttl_ms: int):
        self.keys, self.values, self.ttl_ms = keys, values, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", self.values)

    def told(self, key: Any, value: tuple, status: str) -> pd.DataFrame:
        row = dict(zip(self.keys, key)) | dict(zip(self.values.names, value)) | {"status": status}
        return pd.DataFrame({k: pd.Series([v], dtype=object if v is None or isinstance(v, str) else None) for k, v in row.items()})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = self.values.names
        order = [names.index(STAMP), names.index(ORDER)]
        old = tuple(self.state.get()) if self.state.exists() else None
        best = old
        for part in rows:
            for value in part[names].astype(object).where(part[names].notna(), None).itertuples(index=False, name=None):
                if best is None or [value[i] for i in order] > [best[i] for i in order]:
                    best = value
        if best is not None and best != old:
            if old is not None:
                self.handle.deleteTimer(int(old[order[0]]) + self.ttl_ms)
            self.state.update(best)
            self.handle.registerTimer(int(best[order[0]]) + self.ttl_ms)
            yield self.told(key, best, LIVE)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            value = tuple(self.state.get())
            if int(value[self.values.names.index(STAMP)]) + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield self.told(key, value, EXPIRED)

    def close(self) -> None:
        pass


def latest_values(stream: DataFrame, keys: list[str], stamp: str, order: str, values: list[str], late: str, ttl_ms: int) -> DataFrame:
    """A stream of keys, values, stamp_ms, order_in_stamp and status (live, expired) from a stream of rows.

    keys and values: columns of text or numbers; stamp: a timestamp; order: a number that tells rows of one time apart;
    late: how far rows may come out of order ('1 hour'); ttl_ms: how long a value lives after its stamp. Rows with a null
    key or stamp have no state; they are left out here and belong to the dead letters."""
    ms = F.unix_millis(F.col(stamp).cast("timestamp"))
    rows = stream.where(valid_keys(keys, stamp)).select(*keys, *values, ms.alias(STAMP), F.col(order).cast("long").alias(ORDER), F.col(stamp).cast("timestamp").alias(AT))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    state = StructType([*(StructField(v, kinds[v], True) for v in values), StructField(STAMP, LongType(), True), StructField(ORDER, LongType(), True)])
    out = StructType([*(StructField(k, kinds[k], True) for k in keys), *state.fields, StructField("status", StringType(), True)])
    grouped = rows.withWatermark(AT, late).groupBy(*keys)
    return grouped.transformWithStateInPandas(statefulProcessor=Latest(keys, state, ttl_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


def follow(changes: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str):
    """A query that keeps a store's table at the live values of a stream of latest_values(): live ones are put over those
    of their keys, expired ones go if nothing newer is there. Only parts with changes are written, each batch as one
    version; a batch that is repeated after a failure leaves the same rows."""

    def batch(rows: DataFrame, number: int) -> None:
        last = first_per_key(rows, keys, [F.desc(STAMP), F.desc(ORDER), F.desc(F.col("status") == EXPIRED)])
        parts = store.parts_of(last.select(*keys))
        if not parts:
            return
        known = store.manifest()["tables"]
        shape = rows.drop("status")
        base = store.read(table, parts) if table in known else rows.sparkSession.createDataFrame([], shape.schema)
        after = upsert(base, last.where(F.col("status") == LIVE).drop("status"), keys)
        gone = last.where(F.col("status") == EXPIRED).select(*keys)
        after = after.join(gone, keys, "left_anti").select(*shape.columns)
        store.publish({table: Change(after, tuple(keys), parts if table in known else None)})

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def use_state_store(spark: SparkSession) -> None:
    """Chooses the state store that transformWithState needs, for queries that the session starts from now on."""
    spark.conf.set(*PROVIDER)


def valid_keys(keys: list[str], stamp: str) -> Column:
    """Whether a row has what latest_values() needs; the others are dead letters."""
    has = F.col(stamp).isNotNull()
    for k in keys:
        has = has & F.col(k).isNotNull()
    return has
