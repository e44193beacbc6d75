"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands between words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes on disk (Parquet) up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(v) with v bound to value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def boxed(df: DataFrame) -> Column:
    """All columns of df in one struct, row, where their names can't clash with others."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def unboxed(rows: DataFrame, df: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of df out of row; with text instead of its own, and n_chars, if there, counted anew."""
    new = {}
    if text is not None:
        new["text"] = text
        if "n_chars" in df.columns:
            new["n_chars"] = F.length(text).cast(df.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only on a local master, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, local, True)
        sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as a table to the shared folder and read again: lineage ends there, so lost executors cost no
    recomputation, and its size is known to the planner. The table goes when the driver's JVM ends, or by drop(path)."""
    spark = df.sparkSession
    path = path or cut_path(spark)
    df.write.parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of cut() that no later result reads."""
    files, at = _files(spark, path)
    files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is of so few bytes, else as it is (Spark then shuffles and splits skewed keys).

    For written tables (see cut) and projections of these: the size is that of their files."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df


def beside(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """small() for a table that is joined to whole texts: beyond the size it is hashed by partition, so that the texts
    needn't be sorted. It has a row or two for each text at most, so a partition of it is small beside that of the texts."""
    hinted = small(df, most)
    return hinted if hinted is not df else df.hint("shuffle_hash")


def perhaps(hash: Column, keys: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """(marks, on, hit): rows joined to marks (left) on `on` for which hit holds may have hash among the key (long) of
    keys; the others surely have not. marks has 64 bits in a row for every four keys, so it may be broadcast where keys
    are too many, and a join then moves only the rows that hit holds for."""
    words = F.lit(max(1, keys.count() // 4))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h), F.lit(64)).cast("int"))
    marks = cut(keys.groupBy(F.pmod(F.col(key), words).alias("_place")).agg(F.bit_or(bit(F.col(key))).alias("_bits")))
    return F.broadcast(marks), F.pmod(hash, words) == F.col("_place"), F.coalesce(F.col("_bits").bitwiseAND(bit(hash)) != 0, F.lit(False))


def running_offset(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys that come earlier.

    The order within a key is by a hash of the order columns first, which deals every key, a hot one too, over many
    tasks of about 4,096 rows; the sums of these parts are then added up in a table with a row per part."""
    parts = max(1, rows // 4096)
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    sums = df.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part")
    sums = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    df = df.withColumn("_inside", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return df.join(sums, [*keys, "_part"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")
