"""Keyed state: newer and older rows, late ones, expiry, restart, what the state holds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineupforge.sinks.store import Store
from lineupforge.streaming import keyed

ZERO = dt.datetime(2024, 8, 10)
SCHEMA = "k string, source string, ts timestamp, n long, p int, note string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ms(hour):
    return int((ZERO + dt.timedelta(hours=hour)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.fixture()
def feed(spark, tmp_path):
    """put(rows): a file more; run(): all new files, a batch each; the rows put out so far, by batch."""
    keyed.use_state_store(spark)
    number, out = [0], []

    def put(*data):
        number[0] += 1
        data = [(k, s, None if h is None else ZERO + dt.timedelta(hours=h), n, p, note) for k, s, h, n, p, note in data]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{number[0]:03d}")

    def run(store=None):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        changes = keyed.latest_values(stream, ["k", "source"], "ts", "n", ["p", "note"], "1 hour", 12 * 3_600_000)
        if store is not None:
            query = keyed.follow(changes, store, "latest", ["k", "source"], f"{tmp_path}/check")
        else:
            query = changes.writeStream.foreachBatch(lambda df, i: out.append(rows(df))).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return query

    return put, run, out


def test_newest_late_and_expired(spark, feed):
    put, run, out = feed
    put(("a", "s", 0, 1, 10, "x"), ("a", "s", 0, 2, 11, None), ("b", "s", 2, 3, 20, "y"), (None, "s", 2, 4, 1, ""), ("c", "s", None, 5, 1, ""))
    run()
    assert sum(out, []) == [("a", "s", 11, None, ms(0), 2, "live"), ("b", "s", 20, "y", ms(2), 3, "live")]
    out.clear()
    # an older row within the delay changes nothing; a newer one does; the watermark then is at 9 hours
    put(("a", "s", 1.25, 6, 12, None), ("a", "s", 1.1, 7, 99, None), ("c", "s", 10, 8, 30, None), ("b", "s", 1.5, 9, 98, None))
    query = run()
    assert sorted(sum(out, [])) == [("a", "s", 12, None, ms(1.25), 6, "live"), ("c", "s", 30, None, ms(10), 8, "live")]
    out.clear()
    # after a restart from the checkpoint: a late row is dropped, though it is newer than the value
    put(("b", "s", 3, 10, 97, None), ("d", "s", 11, 11, 40, None))
    query = run()
    assert sum(out, []) == [("d", "s", 40, None, ms(11), 11, "live")]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress) == 1
    out.clear()
    # the watermark passes 13:15 (a's stamp and its life) and stays below 14:00 (b's)
    put(("e", "s", 14.5, 12, 50, None))
    run()
    assert sorted(sum(out, [])) == [("a", "s", 12, None, ms(1.25), 6, "expired"), ("e", "s", 50, None, ms(14.5), 12, "live")]
    out.clear()
    put(("f", "s", 100, 13, 60, None))
    run()
    said = sorted(sum(out, []))
    assert [r[0] for r in said if r[-1] == "expired"] == ["b", "c", "d", "e"] and [r[0] for r in said if r[-1] == "live"] == ["f"]


def test_state_follows_live_keys(spark, feed, tmp_path):
    put, run, out = feed
    put(*((f"k{i}", "s", 0, i, i, None) for i in range(50)))
    run()
    held = lambda: spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "latest").load().count()
    assert held() == 50
    put(*((f"m{i}", "s", 30, i, i, None) for i in range(3)))
    run()
    assert held() == 3


def test_a_table_follows_the_stream(spark, feed, tmp_path):
    put, run, _ = feed
    store = Store(spark, f"file://{tmp_path}/store", parts=8)
    put(*((f"k{i}", "s", 0, i, i, None) for i in range(10)))
    run(store)
    assert store.read("latest").count() == 10
    before = store.manifest()["tables"]["latest"]["parts"]
    put(("k3", "s", 1, 99, 77, "new"))
    run(store)
    after = store.manifest()["tables"]["latest"]["parts"]
    assert sum(after[k] != before.get(k) for k in after) == 1  # the part of k3
    got = {r["k"]: r["p"] for r in store.read("latest").collect()}
    assert got == {f"k{i}": 77 if i == 3 else i for i in range(10)}
    put(("z", "s", 13.5, 100, 1, None))
    run(store)
    assert {r["k"] for r in store.read("latest").collect()} == {"z", "k3"} and store.verify() == []
    put(("y", "s", 30, 101, 1, None))
    run(store)
    assert {r["k"] for r in store.read("latest").collect()} == {"y"}


def test_equal_to_the_batch_form(spark, feed):
    """All rows within the delay: the last live row of each key is the newest of a whole table."""
    put, run, out = feed
    data = [(f"k{i % 7}", f"s{i % 3}", (i * 37 % 50) / 60, i, i, None) for i in range(120)]
    for j in range(3):
        put(*data[j::3])
    run()
    last = {}
    for r in sum(out, []):
        last[r[:2]] = r
    want = {}
    for k, s, h, n, p, _ in data:
        if (k, s) not in want or (h, n) > want[k, s][:2]:
            want[k, s] = (h, n, p)
    assert {k: r[2] for k, r in last.items()} == {k: w[2] for k, w in want.items()}


def test_valid_keys(spark):
    df = spark.createDataFrame([("a", "s", ZERO), (None, "s", ZERO), ("a", None, ZERO), ("a", "s", None)], "k string, source string, ts timestamp")
    assert [r[0] for r in df.select(F.coalesce(keyed.valid_keys(["k", "source"], "ts"), F.lit(False))).collect()] == [True, False, False, False]
