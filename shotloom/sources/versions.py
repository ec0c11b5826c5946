"""Tables that change together, one numbered version at a time, in a folder that all writers share.

A version is one small commit file that names the parts of every table; it appears by
a rename that fails if the number is taken, so that of two writers who saw the same
version one wins and the other is told. Rows are written before it under names of
their own: a writer that dies leaves parts that no version names, and the tables as
they were.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The part of a table that is not dealt into buckets.
WHOLE = "all"


class StaleVersion(Exception):
    """Another writer has committed the number that this one was to commit."""


class VersionedTables:
    """Reads and commits of the tables under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(self.folder)
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._at.getFileSystem(self._conf)

    def _commit_file(self, version: int) -> str:
        return f"{self.folder}/commits/{version:012d}.json"

    def latest(self) -> int:
        """Number of the latest version; 0 before the first."""
        folder = self._hadoop.Path(f"{self.folder}/commits")
        if not self._files.exists(folder):
            return 0
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return max((int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()), default=0)

    def commit_of(self, version: int) -> dict:
        """What a version holds: tables (schema, and the paths of each part) and notes."""
        if not version:
            return {"tables": {}, "notes": {}}
        stream = self._files.open(self._hadoop.Path(self._commit_file(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def notes(self) -> dict:
        return self.commit_of(self.latest())["notes"]

    def read(self, name: str, version: int | None = None, parts: list | None = None) -> DataFrame | None:
        """A table at a version (the latest if none is given), or some of its parts; None before its first commit."""
        table = self.commit_of(self.latest() if version is None else version)["tables"].get(name)
        if table is None:
            return None
        schema = StructType.fromJson(table["schema"])
        wanted = None if parts is None else {str(p) for p in parts}
        paths = [path for part, paths in table["parts"].items() if wanted is None or part in wanted for path in paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, expected: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, buckets: dict[str, tuple[DataFrame, str, list[int]]] | None = None, notes: dict | None = None) -> int:
        """Write the changes and publish version ``expected`` + 1; StaleVersion if that number is taken.

        ``replace``: the whole table; ``append``: rows beside those that are there;
        ``buckets``: (rows, bucket column, the buckets that they replace), the others stay.
        """
        if self.latest() != expected:
            raise StaleVersion(f"version {self.latest()} is there, not {expected}")
        content = self.commit_of(expected)
        tables = content["tables"]
        for name, rows in (replace or {}).items():
            tables[name] = {"schema": rows.schema.jsonValue(), "parts": {WHOLE: [self._write(name, rows)]}}
        for name, rows in (append or {}).items():
            table = tables.setdefault(name, {"schema": rows.schema.jsonValue(), "parts": {}})
            table["parts"].setdefault(WHOLE, []).append(self._write(name, rows))
        for name, (rows, column, touched) in (buckets or {}).items():
            path = self._write(name, rows, column)
            table = tables.setdefault(name, {"schema": rows.drop(column).schema.jsonValue(), "parts": {}})
            for bucket in touched:
                own = f"{path}/{column}={bucket}"
                table["parts"].pop(str(bucket), None)
                if self._files.exists(self._hadoop.Path(own)):
                    table["parts"][str(bucket)] = [own]
        content["notes"] = {**content["notes"], **(notes or {})}
        self._publish(expected + 1, content)
        return expected + 1

    def _write(self, name: str, rows: DataFrame, column: str | None = None) -> str:
        path = f"{self.folder}/data/{name}-{uuid.uuid4().hex}"
        if column:  # a task for each bucket that is there, so that a bucket is one file
            rows = rows.repartition(F.col(column))
        writer = rows.write.partitionBy(column) if column else rows.write
        writer.parquet(path)
        return path

    def _publish(self, version: int, content: dict) -> None:
        draft = self._hadoop.Path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        stream = self._files.create(draft, True)
        stream.write(json.dumps(content).encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, self._hadoop.Path(self._commit_file(version)), no_options)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise StaleVersion(f"version {version} is there") from None
            raise

    def compact(self, name: str, most: int = 16) -> int:
        """Rewrite an appended table as one part if it has more than ``most``; the latest version afterwards."""
        version = self.latest()
        parts = self.commit_of(version)["tables"].get(name, {"parts": {}})["parts"]
        return self.commit(version, replace={name: self.read(name, version)}) if len(parts.get(WHOLE, [])) > most else version

    def vacuum(self, keep: int = 2) -> int:
        """Delete the commits before the last ``keep`` and the rows that no kept one names; the number of deleted folders.

        Run it when no writer is at work: rows that are written but not committed yet go, too.
        """
        last = self.latest()
        kept = range(max(1, last - keep + 1), last + 1)
        named = {path.split("/data/", 1)[1].split("/")[0] for v in kept for table in self.commit_of(v)["tables"].values() for paths in table["parts"].values() for path in paths}
        gone, data = 0, self._hadoop.Path(f"{self.folder}/data")
        for v in range(1, kept.start):
            self._files.delete(self._hadoop.Path(self._commit_file(v)), False)
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            if status.getPath().getName() not in named:
                gone += bool(self._files.delete(status.getPath(), True))
        return gone
