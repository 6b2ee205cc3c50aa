"""A table of rows by key in hash partitions, of which a change rewrites only those that it touches.

A version of the table is one small record that says which files every partition has. A change writes new files beside
the old ones and then its record, which appears whole or not at all; readers go by the newest record, so they see all of a change
or nothing, and files they have begun to read stay. Of two writers at once the later one is told so and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.sources.store import _hadoop, exists, write_record

PARTS = 64
#: Sets of files a partition may have before insert_absent merges them.
MOST_FILES = 8


class Conflict(RuntimeError):
    """Another writer has made a version in the meantime."""


class KeyedTable:
    """schema: the columns as in DDL; key: one of them, of which a table has a row each. parts stays what it was when the table was made."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, parts: int = PARTS):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key
        self.parts = self._record()["of"] if exists(spark, f"{folder}/versions") else parts

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _record(self) -> dict:
        """The newest version: its number, the number of partitions, and for each partition the folders of its files."""
        store, at = _hadoop(self.spark, f"{self.folder}/versions")
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        names = sorted(n for n in names if n.startswith("version-"))
        if not names:
            return {"version": -1, "of": self.parts, "files": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{names[-1]}", wholetext=True).first()[0])

    def version(self) -> int:
        return self._record()["version"]

    def _read(self, record: dict, parts=None) -> DataFrame:
        paths = [f"{self.folder}/data/{f}/part={k}" for k, fs in record["files"].items() if parts is None or int(k) in parts for f in fs]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, part int")
        rows = self.spark.read.schema(f"{self.schema}, write string, part int").option("basePath", f"{self.folder}/data").parquet(*paths)  # one for each partition and set of files
        return rows.drop("write")

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self._read(self._record()).drop("part")

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self._bucket().alias("p")).distinct().collect()}  # at most `parts`

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only partitions that may have them are read."""
        return self._read(self._record(), self._touched(keys)).drop("part").join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        name = f"write={uuid.uuid4().hex}"
        rows.withColumn("part", self._bucket()).repartition("part").write.partitionBy("part").parquet(f"{self.folder}/data/{name}")
        store, at = _hadoop(self.spark, f"{self.folder}/data/{name}")
        return name, {int(s.getPath().getName().split("=")[1]) for s in store.listStatus(at) if s.getPath().getName().startswith("part=")}

    def _commit(self, record: dict, files: dict) -> None:
        found = {"version": record["version"] + 1, "of": self.parts, "files": {str(k): v for k, v in files.items() if v}}
        if not write_record(self.spark, f"{self.folder}/versions/version-{found['version']:010d}.json", json.dumps(found)):
            raise Conflict(f"version {found['version']} is there already")

    def rewrite(self, parts: set[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Puts change(rows of the partitions) in place of those rows; all other partitions keep their files. What it gives must belong to the same partitions."""
        record = self._record()
        name, there = self._write(change(self._read(record, parts).drop("part")))
        if not there <= parts:
            raise ValueError("a row has a key of another partition")
        self._commit(record, record["files"] | {str(k): [name] if k in there else [] for k in parts})

    def put(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Rows in place of those of the same key, or what merge(old rows of the touched partitions, new rows) gives."""
        merge = merge or (lambda old, new: old.join(new.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(new))
        self.rewrite(self._touched(rows), lambda old: merge(old, rows))

    def delete(self, keys: DataFrame) -> None:
        """Takes out the rows of the keys; partitions without any of them keep their files."""
        record = self._record()
        gone = keys.select(self.key).distinct()
        has = {r[0] for r in self._read(record, self._touched(keys)).join(gone, self.key, "left_semi").select("part").distinct().collect()}  # at most `parts`
        if has:
            self.rewrite(has, lambda old: old.join(gone, self.key, "left_anti"))

    def insert_absent(self, rows: DataFrame) -> None:
        """Adds the rows (a key once) whose key isn't there yet, as more files of their partitions; these are merged when they are many."""
        record = self._record()
        new = rows.join(self._read(record, self._touched(rows)).select(self.key), self.key, "left_anti")
        name, there = self._write(new)
        if there:
            files = {k: record["files"].get(str(k), []) + [name] for k in there}
            self._commit(record, record["files"] | {str(k): v for k, v in files.items()})
            if many := {k for k, v in files.items() if len(v) > MOST_FILES}:
                self.rewrite(many, lambda old: old)

    def swept(self) -> int:
        """Removes the files that the newest version doesn't have, and the records before it, when nobody reads or writes; how many partitions' files there were."""
        record, gone = self._record(), 0
        kept = {(f, int(k)) for k, fs in record["files"].items() for f in fs}
        store, at = _hadoop(self.spark, f"{self.folder}/data")
        for write in store.listStatus(at) if store.exists(at) else []:
            for part in store.listStatus(write.getPath()):
                name = part.getPath().getName()
                if name.startswith("part=") and (write.getPath().getName(), int(name.split("=")[1])) not in kept:
                    store.delete(part.getPath(), True)
                    gone += 1
        store, at = _hadoop(self.spark, f"{self.folder}/versions")
        for old in store.listStatus(at) if store.exists(at) else []:
            if old.getPath().getName() < f"version-{record['version']:010d}.json":
                store.delete(old.getPath(), False)
        return gone
