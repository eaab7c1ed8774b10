"""A log of the versions of a warehouse's tables.

A version is one small file that lists the folders of every table. It is written under a name of its own and then renamed to
its number, which fails where that number is taken: so a version is there whole or not at all, several tables change at
once, and of two writers one is told that it comes too late. The file system's rename has to be atomic, as it is on local
disks and HDFS.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that was to be written."""


class TableLog:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.folder = spark, f"{warehouse.rstrip('/')}/_versions"
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def latest(self) -> int:
        """The number of the newest version; 0 before the first."""
        where = self.fs.Path(f"{self.folder}/*.json")
        found = where.getFileSystem(self.conf).globStatus(where) or []
        return max((int(s.getPath().getName().removesuffix(".json")) for s in found), default=0)

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version, the newest if none is named, and what it says of each table."""
        version = self.latest() if version is None else version
        if not version:
            return 0, {}
        rows = self.spark.read.text(f"{self.folder}/{version:012d}.json", wholetext=True).collect()
        return version, json.loads(rows[0][0])

    def commit(self, after: int, tables: dict) -> int:
        """Write the version that comes after another; its number. ``Conflict`` if there is one already."""
        new = self.fs.Path(f"{self.folder}/_{uuid.uuid4().hex}")
        store = new.getFileSystem(self.conf)
        out = store.create(new, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        target = self.fs.Path(f"{self.folder}/{after + 1:012d}.json")
        kind = getattr(self.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self.fs.FileContext.getFileContext(store.getUri(), self.conf).rename(store.makeQualified(new), store.makeQualified(target), how)
        except Exception as e:
            store.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} is there already") from None
            raise
        return after + 1
