"""Files: CSV with full or minimal quoting, JSON, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: str, trim: bool = False) -> DataFrame:
    """Quoted CSV with a header; cells may hold line breaks."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(df: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    """The rows of some ids, to be restored later."""
    df.join(ids.select(key).distinct(), key, "left_semi").write.mode("overwrite").json(path)


def restore(df: DataFrame, path: str, key: str) -> DataFrame:
    """df with a snapshot's rows in place of the rows of their ids."""
    saved = df.sparkSession.read.schema(df.schema).json(path)
    return df.join(saved.select(key).distinct(), key, "left_anti").unionByName(saved)
