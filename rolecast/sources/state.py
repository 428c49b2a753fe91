"""Stored state in versions: several tables change together or not at all.

A state is a folder. Each table's rows lie in a folder of their own for each version that
changed it; a version is a small file that names every table's folder and is put in place
last, by one rename. Readers take the last version that is whole, so that a crash before the
rename leaves the state as it was. Folders that neither of the last two versions names are
deleted after a commit; a reader of an older version has to read again.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rolecast.sources.staged import read_if_exists

KEPT_VERSIONS = 2


class Conflict(Exception):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _list(self, path: str) -> list[str]:
        files, there = self._hadoop(path)
        return sorted(s.getPath().getName() for s in files.listStatus(there)) if files.exists(there) else []

    def versions(self) -> list[int]:
        return [int(name[:-5]) for name in self._list(f"{self.path}/versions") if name.endswith(".json") and name[:-5].isdigit()]

    def version(self, number: int | None = None) -> dict:
        """{"tables": {name: folder}, "notes": {...}} of a version, the last one by default; of no version, without tables."""
        known = self.versions()
        if not known:
            return {"tables": {}, "notes": {}}
        text = self.spark.read.text(f"{self.path}/versions/{known[-1] if number is None else number:012d}.json", wholetext=True).first().value
        return json.loads(text)

    def read(self, name: str, schema: str | T.StructType) -> DataFrame:
        """A table as of the last version; an empty one of the schema if none was ever written."""
        folder = self.version()["tables"].get(name)
        if folder is None:
            return self.spark.createDataFrame([], schema)
        return read_if_exists(self.spark, f"{self.path}/{folder}", schema)

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Writes tables to new folders, which nothing names yet."""
        folders = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
        for name, frame in tables.items():
            frame.write.parquet(f"{self.path}/{folders[name]}")
        return folders

    def publish(self, folders: dict[str, str], notes: dict | None = None) -> int:
        """Makes the next version of the last one with these folders in it, and returns its number."""
        known, last = self.versions(), self.version()
        number = known[-1] + 1 if known else 1
        text = json.dumps({"tables": last["tables"] | folders, "notes": last["notes"] | (notes or {})})
        files, draft = self._hadoop(f"{self.path}/versions/.{uuid.uuid4().hex}")
        _, place = self._hadoop(f"{self.path}/versions/{number:012d}.json")
        out = files.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise Conflict(f"version {number} of {self.path} is there already")
        self._clean()
        return number

    def commit(self, notes: dict | None = None, **tables: DataFrame) -> int:
        """Writes all tables, then publishes them together. They may be made from the state itself."""
        return self.publish(self.write(tables), notes)

    def _clean(self) -> None:
        known = self.versions()
        held = {folder for n in known[-KEPT_VERSIONS:] for folder in self.version(n)["tables"].values()}
        for n in known[:-KEPT_VERSIONS]:
            for folder in set(self.version(n)["tables"].values()) - held:
                files, there = self._hadoop(f"{self.path}/{folder}")
                files.delete(there, True)
            files, there = self._hadoop(f"{self.path}/versions/{n:012d}.json")
            files.delete(there, False)
