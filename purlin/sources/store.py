"""Tables that grow by whole commits: parts staged first, one small commit file last, readers that follow the commits.

``<root>/<table>/part=<name>`` holds what one writer staged; ``<root>/_commits/<number>.json`` says which part became visible,
in which order. A writer that dies in between leaves a part no commit names: nobody reads it, and the same writer's next try
overwrites it. A commit file is created, never replaced, so of two writers that want the same number one fails and takes the
next. Only the list of commits, one short line each, is read by the driver; ``compact`` keeps it short. Nothing but Hadoop's file
system is used, so the root may lie in any store that Spark reads.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """Small files through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def below(self) -> list[tuple[str, int, int]]:
        """(address, bytes, time of modification in ms) of every file below the root but hidden ones."""
        out, found = [], self._fs.listFiles(self._path(""), True)
        while found.hasNext():
            status = found.next()
            if status.getPath().getName()[0] not in "._":
                out.append((status.getPath().toUri().toString(), status.getLen(), status.getModificationTime()))
        return sorted(out)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def typed(schema: T.StructType | str) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files: they go when the write ends, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark, root), root.rstrip("/")

    def stage(self, table: str, part: str, frame: DataFrame) -> DataFrame:
        """Write a part that nobody sees yet, in place of what an earlier try left, and read it back."""
        path = f"{self.root}/{table}/part={part}"
        with shuffles_released(self.spark):
            frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def commits(self) -> list[dict[str, Any]]:
        """What was committed, in order, from the last compaction on: number, part, and what the writer noted."""
        names = [n for n in self.files.names("_commits") if n.endswith(".json")]
        if not names:
            return []
        lines = self.spark.read.schema("value string, part string").option("wholetext", True).text(f"{self.root}/_commits/*.json").select("value").collect()
        found = sorted((json.loads(r["value"]) for r in lines if r["value"]), key=lambda c: c["number"])
        last = max((i for i, c in enumerate(found) if c.get("compacted")), default=0)
        return found[last:]

    def publish(self, part: str, **notes: Any) -> int:
        """Make a staged part visible; the commit's number."""
        done = self.commits()
        number = done[-1]["number"] + 1 if done else 0
        while not self.files.create(f"_commits/{number:012d}.json", json.dumps({"number": number, "part": part, **notes})):
            number += 1  # another writer was faster
        return number

    def read(self, table: str, schema: T.StructType | str, commits: list[dict[str, Any]] | None = None) -> DataFrame:
        """Rows of all committed parts with ``__commit``, their commit's number; parts without the table count as empty."""
        commits = self.commits() if commits is None else commits
        schema = typed(schema)
        there = set(self.files.names(table))
        numbers = {c["part"]: c["number"] for c in commits if f"part={c['part']}" in there}
        wide = T.StructType([*schema.fields, T.StructField("__commit", T.LongType())])
        if not numbers:
            return self.spark.createDataFrame([], wide)
        stored = T.StructType([*schema.fields, T.StructField("part", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/part={p}" for p in numbers])
        order = self.spark.createDataFrame(list(numbers.items()), "part string, __commit long")  # a line a commit
        return rows.join(F.broadcast(order), "part").drop("part").select(*[f.name for f in schema.fields], "__commit")

    def compact(self, tables: Mapping[str, DataFrame], **notes: Any) -> int:
        """A commit that stands for all before it, with these tables; the old parts are deleted once it is visible."""
        before = self.commits()
        part = f"compacted-{before[-1]['number'] if before else 0}"
        for name, frame in tables.items():
            self.stage(name, part, frame)
        number = self.publish(part, compacted=True, **notes)
        for c in before:
            if c["number"] < number:
                self.files.delete(f"_commits/{c['number']:012d}.json")
                for name in tables:
                    self.files.delete(f"{name}/part={c['part']}")
        return number


_scratch: list[Files] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; deleted when the driver ends. Only a local
    session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="purlin-")
    _scratch.append(Files(spark, f"{shared}/{name}-{uuid.uuid4().hex}"))
    return _scratch[-1].root


@atexit.register
def _clear() -> None:
    for files in _scratch:
        try:
            files.delete("")
        except Exception:  # the session may have ended before
            pass


class Scratch:
    """Tables of one computation, written to cut their lineage: a lost executor costs tasks, not the way here."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, scratch(spark, name), 0

    def freeze(self, frame: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        with shuffles_released(self.spark):
            frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._purlin_name = str(self._n)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            Files(self.spark, self.root).delete(f._purlin_name)
