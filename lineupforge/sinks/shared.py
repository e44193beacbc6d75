"""Where work in progress may be written."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the checkpoint folder set; a local one only on a local master, as in tests."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, local, True)
        sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path there, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, written there and read again: computed once, without lineage that lost executors would have to compute anew."""
    path = scratch(df.sparkSession, "written") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a written table is broadcast. Files may be far smaller than the rows in them, so their size doesn't tell.
FEW = 20_000


def looked_up(rows: DataFrame, keys: list[str], values: DataFrame | None = None, **made: Column) -> DataFrame:
    """rows with columns made of keys alone, each made once for every distinct value of the keys (null is one), however
    many rows have it. values: where the keys' values stand, if that is less to read than rows."""
    given = (rows if values is None else values).select(*keys).distinct()
    known = written(given.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c.alias(n) for n, c in made.items())))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return rows.join(known.hint("broadcast" if known.count() <= FEW else "merge"), same, "left").drop(*(f"_k_{k}" for k in keys))
