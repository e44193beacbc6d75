"""Several tables published together: data first, then one manifest that names all of it.

A store is a folder. Each publication writes Parquet under data/<version>/<table>/ and, when all tables are there, the
manifest of that version, which is put in place by one rename. Readers follow the newest manifest, so they see all tables
of a publication or none: whatever fails before the rename leaves them on the version before. Tables and parts that a
publication does not touch are named by the new manifest where they already are; nothing is copied. A log is appended to.

Each table is dealt into parts by a hash of some key columns. A publication may replace a few parts of a table, and a reader
may ask for a few, so work on some keys reads and writes the parts of those keys alone. A manifest has the rows and a hash of
the contents of each part, which verify() counts again. Earlier versions are the backup: roll_back() publishes one of them
anew, vacuum() drops data that no kept manifest names. One publisher at a time; any number of readers."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

PART, FOLDER = "store_part", "store_folder"


def contents(columns: list[str]) -> list[Column]:
    """Aggregates over rows: their number, and a sum of row hashes, which no order of rows changes."""
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in columns)).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("hash")]


@dataclass(frozen=True)
class Change:
    """What is published of a table: its rows, dealt by some columns. parts: only these are replaced (None: the table);
    append: the rows are added to what is there."""

    rows: DataFrame
    by: tuple[str, ...]
    parts: tuple[int, ...] | None = None
    append: bool = False


class Store:
    """The tables under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 16):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The tables of a version (the newest): name -> schema, by, parts (number -> a list of path, rows, hash)."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        text = self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def part_of(self, *by: str) -> Column:
        """The part of a row, by columns of these names; their order counts."""
        return F.pmod(F.xxhash64(*by), F.lit(self.parts)).cast("int")

    def parts_of(self, keys: DataFrame) -> tuple[int, ...]:
        """The parts that hold rows of some keys (columns in the order of the table's by). At most as many as the store has."""
        return tuple(sorted(r[0] for r in keys.select(self.part_of(*keys.columns).alias("p")).distinct().collect()))

    def read(self, name: str, parts: tuple[int, ...] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its parts, as of a version (the newest)."""
        entry = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(entry["schema"])
        paths = [p["path"] for k, files in entry["parts"].items() if parts is None or int(k) in parts for p in files]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))

    def _staged(self, name: str, change: Change, folder: str) -> dict:
        at = f"{folder}/{name}"
        dealt = change.rows.withColumn(PART, self.part_of(*change.by))
        if change.parts is not None:
            dealt = dealt.where(F.col(PART).isin(list(change.parts)))
        # Spark makes tasks of even size of the parts, a large part several, small ones together
        dealt.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.root}/{at}")
        if not any(n.startswith(PART) for n in self._names(f"{self.root}/{at}")):
            return {}
        columns = change.rows.columns
        written = self.spark.read.schema(StructType(change.rows.schema.fields).add(PART, IntegerType())).parquet(f"{self.root}/{at}")
        counted = written.groupBy(PART).agg(*contents(columns)).collect()  # a row per part
        return {str(r[PART]): [{"path": f"{at}/{PART}={r[PART]}", "rows": r["rows"], "hash": r["hash"]}] for r in counted}

    def publish(self, changes: dict[str, Change], drop: tuple[str, ...] = ()) -> int:
        """Writes all changes, then the manifest; the new version. Fails as a whole: nothing is visible before the end."""
        old = self.manifest()
        version, folder = old["version"] + 1, f"data/{old['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        tables = {k: v for k, v in old["tables"].items() if k not in drop}
        for name, change in changes.items():
            before = tables.get(name, {"parts": {}})
            schema = json.loads(StructType(change.rows.schema.fields).json())
            whole = change.parts is None and not change.append
            shape = lambda x: [(f["name"], f["type"]) for f in x["fields"]]
            if name in tables and not whole and shape(before["schema"]) != shape(schema):
                raise ValueError(f"{name}: rows of another schema than the table's")
            new = self._staged(name, change, folder)
            kept = {} if whole else {k: v for k, v in before["parts"].items() if change.append or int(k) not in change.parts}
            tables[name] = {"schema": schema if whole else before.get("schema", schema), "by": list(change.by), "parts": kept | {k: (kept.get(k, []) + v) for k, v in new.items()}}
        self._put({"version": version, "tables": tables})
        return version

    def _put(self, manifest: dict) -> None:
        target = f"{self.root}/manifests/{manifest['version']:09d}.json"
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        lines = self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
        lines.coalesce(1).write.text(staged)
        fs, _ = self._fs(self.root)
        of = lambda p: self._fs(p)[1]
        fs.mkdirs(of(f"{self.root}/manifests"))
        part = next(n for n in self._names(staged) if n.startswith("part-"))
        if fs.exists(of(target)) or not fs.rename(of(f"{staged}/{part}"), of(target)):
            raise RuntimeError(f"version {manifest['version']} was published by another")
        fs.delete(of(staged), True)

    def verify(self, version: int | None = None) -> list[tuple[str, int]]:
        """(table, part) whose files no longer hold the rows that the manifest names; empty if all is as published."""
        wrong = set()
        for name, entry in self.manifest(version)["tables"].items():
            schema = StructType.fromJson(entry["schema"])
            said = {p["path"]: (int(k), p["rows"], p["hash"]) for k, files in entry["parts"].items() for p in files}
            there = [p for p in said if self._names(f"{self.root}/{p}")]
            wrong |= {(name, said[p][0]) for p in said if p not in there}
            if there:
                rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in there))
                folder = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+/[^/]+)/[^/]+$", 1)
                got = {r["folder"]: (r["rows"], r["hash"]) for r in rows.select("*", folder.alias(FOLDER)).groupBy(F.col(FOLDER).alias("folder")).agg(*contents(rows.columns)).collect()}
                wrong |= {(name, said[p][0]) for p in there if got.get(p, (0, "0")) != said[p][1:]}
        return sorted(wrong)

    def roll_back(self, version: int) -> int:
        """Publishes an earlier version anew, if its data is whole; the new version."""
        if wrong := self.verify(version):
            raise ValueError(f"version {version} is damaged: {wrong}")
        new = self.manifest()["version"] + 1
        self._put(self.manifest(version) | {"version": new})
        return new

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drops manifests but the newest, and data folders that no manifest left names; the folders dropped. Not while a
        publication is under way."""
        known = self.versions()
        fs, _ = self._fs(self.root)
        for old in known[:-keep]:
            fs.delete(self._fs(f"{self.root}/manifests/{old:09d}.json")[1], False)
        named = {p["path"].split("/")[1] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for files in t["parts"].values() for p in files}
        gone = [n for n in self._names(f"{self.root}/data") if n not in named]
        for n in gone:
            fs.delete(self._fs(f"{self.root}/data/{n}")[1], True)
        return gone
