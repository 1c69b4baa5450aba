"""Period tables published atomically.

Data folders are written once and never changed: ``<path>/<table>/gen=<id>/_p=<period>``.  A
manifest names the folder that is current for each period of each table; it is one small file
``<path>/_manifest/<version>.json`` that appears by a rename when everything it
names is written.  Readers take the newest manifest, so a write of several periods, or of several
tables, is seen whole or not at all, and a write that fails leaves the old version in place.  One
writer at a time: a version that exists already is an error.

``marks`` are values kept with a version (the last batch of a stream, say), published in the same
step as the data they speak of.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_paths


@dataclass
class Version:
    number: int = 0
    tables: dict[str, dict[str, str]] = field(default_factory=dict)      # table -> period -> folder
    marks: dict[str, int] = field(default_factory=dict)


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._fs_path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def current(self) -> Version:
        """The newest version, or an empty one."""
        names = [n for n in self._names(f"{self.path}/_manifest") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return Version()
        stream = self._fs.open(self._fs_path(f"{self.path}/_manifest/{names[-1]}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, table: str, version: Version | None = None) -> DataFrame | None:
        """All periods of a table as of a version (None: nothing published)."""
        folders = sorted((version or self.current()).tables.get(table, {}).values())
        if not folders:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*folders).drop("gen", "_p")

    def publish(self, frames: dict[str, DataFrame], period: str, marks: dict[str, int] | None = None) -> Version:
        """Write the frames, then make their periods current in one step; periods that a frame
        does not hold stay as they were."""
        old = self.current()
        new = Version(old.number + 1, {t: dict(p) for t, p in old.tables.items()}, {**old.marks, **(marks or {})})
        for table, df in frames.items():
            folder = f"{self.path}/{table}/gen={uuid.uuid4().hex[:12]}"
            df.withColumn("_p", F.col(period)).write.partitionBy("_p").parquet(folder)
            for name in self._names(folder):
                if name.startswith("_p="):
                    new.tables.setdefault(table, {})[name[3:]] = f"{folder}/{name}"
        self._commit(new)
        return new

    def _commit(self, version: Version) -> None:
        final = self._fs_path(f"{self.path}/_manifest/{version.number:012d}.json")
        hidden = self._fs_path(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(vars(version)).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"version {version.number} of {self.path} was published by another writer")

    def vacuum(self) -> None:
        """Delete manifests and data folders that the current version does not name."""
        now = self.current()
        used = {f.split("/_p=")[0] for periods in now.tables.values() for f in periods.values()}
        stale = [f"{self.path}/_manifest/{n}" for n in self._names(f"{self.path}/_manifest") if n != f"{now.number:012d}.json"]
        for table in now.tables:
            stale += [f for n in self._names(f"{self.path}/{table}") if (f := f"{self.path}/{table}/{n}") not in used]
        drop_paths(self.spark, stale)
