"""Named stages in a folder: tables that another session can reopen, with the options that made them."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.storage import remove

_ENTRY = "name string, digest string, path string, schema string, options string, after string, written long"


def _plain(options: object) -> object:
    return dataclasses.asdict(options) if dataclasses.is_dataclass(options) else options


class Stages:
    """A folder of tables and a manifest, itself a table, with one row for each table that was written to its end.

    A stage is known by its name; its digest covers its options and the digests of the stages it comes after. A stage whose digest the manifest
    holds is reopened, any other is built into a folder of its own and only then entered, so a stage that was killed half-way is built again and
    what lies before it isn't. Of several entries of a name the last one counts. The folder has to be one that driver and executors share.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[str, dict] | None = None

    def _file_system(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> DataFrame:
        """(name, digest, path, schema, options, after, written) of all entries."""
        path, files = self._file_system()
        if not files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(f"{self.root}/manifest")

    def _entries(self) -> dict[str, dict]:
        if self._known is None:
            # one row a stage that was ever written: a handful
            last = self.manifest().groupBy("name").agg(F.max_by(F.struct("*"), F.struct("written", "path")).alias("e")).select("e.*")
            self._known = {x["name"]: x.asDict() for x in last.collect()}
        return self._known

    def names(self) -> list[str]:
        return sorted(self._entries())

    def open(self, name: str) -> DataFrame:
        """The table of a finished stage; an unknown name is a KeyError."""
        entry = self._entries()[name]
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])

    def options(self, name: str) -> object:
        """The options that a finished stage was built with, as plain values."""
        return json.loads(self._entries()[name]["options"])

    def run(self, name: str, build: Callable[[], DataFrame], *, options: object = None, after: tuple[str, ...] = ()) -> DataFrame:
        """Reopen the stage `name` if it is finished with these options and predecessors, else build, write and enter it."""
        known = self._entries()
        before = {x: known[x]["digest"] for x in after}
        told = json.dumps(_plain(options), sort_keys=True, default=str)
        digest = hashlib.sha256(json.dumps([name, told, before], sort_keys=True).encode()).hexdigest()
        if name in known and known[name]["digest"] == digest:
            return self.open(name)
        made = build()
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        entry = {"name": name, "digest": digest, "path": path, "schema": made.schema.json(), "options": told, "after": ",".join(after), "written": time.time_ns()}
        self.spark.createDataFrame([entry], _ENTRY).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        known[name] = entry
        return self.open(name)

    def sweep(self) -> int:
        """Delete the folders of stages that were killed or replaced; how many they were."""
        path, files = self._file_system()
        if not files.exists(path):
            return 0
        used = {x["path"].rpartition("/")[2] for x in self._entries().values()} | {"manifest"}
        gone = [x.getPath().getName() for x in files.listStatus(path) if x.getPath().getName() not in used]
        for x in gone:
            remove(self.spark, f"{self.root}/{x}")
        return len(gone)
