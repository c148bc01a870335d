"""Scans of many files that survive bad ones, and datasets built again only from files that changed.

A file's lines are JSON records. A line becomes a record or a fault; a file with a fault fails whole, gives no rows and does
not stop the others. Every file gets one status row. The cache keeps, by commits (``store.py``), the rows of each file and its
fingerprint (path, size, time of modification); a build lists the folder, reads only files whose fingerprint is new, and drops the
rows of files that are gone.
"""

from __future__ import annotations

import datetime as dt
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.sources.store import Files, Store, scratch, typed

STATUS = "file string, status string, error string, records bigint"
FINGERPRINT = "file string, size bigint, modified timestamp"


@dataclass(frozen=True)
class Scan:
    """``rows``: file and the records of all good files; ``status``: file, status (processed, empty, failed), error, records."""

    rows: DataFrame
    status: DataFrame


def parsed(lines: DataFrame, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """(file, record, fault) of (file, line): the line as a struct, or what is wrong with it."""
    kind = typed(schema)
    wide = T.StructType([*kind.fields, T.StructField("__bad", T.StringType())])
    rows = lines.where(F.trim("line") != "").withColumn("r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    fault = F.when(F.col("r").isNull() | F.col("r.__bad").isNotNull(), F.concat(F.lit("not a record: "), F.substring("line", 1, 80)))
    for c in required:
        fault = F.coalesce(fault, F.when(F.col(f"r.{c}").isNull(), F.lit(f"without {c}")))
    return rows.select("file", F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields]).alias("record"), fault.alias("fault"))


def judged(files: DataFrame, records: DataFrame) -> Scan:
    """Good files' rows and every file's status, from all files (file) and their ``parsed`` lines."""
    counts = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("fault").alias("error"))
    status = files.select("file").join(counts, "file", "left").select(
        "file",
        F.when(F.col("error").isNotNull(), "failed").when(F.col("n").isNull(), "empty").otherwise("processed").alias("status"),
        "error",
        F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("records"),
    )
    bad = counts.where("error is not null").select("file")
    return Scan(records.join(bad, "file", "left_anti").select("file", "record.*"), status)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, modified) of the files below a folder, empty ones too, which Spark's readers leave out; no contents are read.
    Names come from Hadoop's listing, as in Spark's own index of files; hidden ones don't count."""
    found = [(re.sub("^file:/+", "file:/", uri), size, dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)) for uri, size, ms in Files(spark, path).below()]
    return spark.createDataFrame(found, typed(FINGERPRINT))


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    found = spark.read.option("recursiveFileLookup", True).text(paths)
    return found.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.col("value").alias("line"))


def scan(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> Scan:
    """All files below a folder."""
    return judged(listed(spark, path), parsed(lines_of(spark, path), schema, required))


class FileCache:
    """The records of a folder's files, kept between builds."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, required: tuple[str, ...] = ()):
        self.spark, self.store, self.schema, self.required = spark, Store(spark, root), typed(schema), required

    def _known(self) -> DataFrame:
        """Each file's last line in the manifests: fingerprint, status, error, records, commit."""
        kind = typed(f"{FINGERPRINT}, status string, error string, records bigint")
        rows = self.store.read("manifest", kind)
        last = rows.groupBy("file").agg(F.max_by(F.struct(*kind.names[1:]), "__commit").alias("m"), F.max("__commit").alias("__commit"))
        return last.select("file", "m.*", "__commit").where("status != 'gone'")

    def changed(self, path: str) -> tuple[list[str], list[str]]:
        """(files that are new or not as they were, files that are gone)."""
        there, known = listed(self.spark, path), self._known().select("file", "size", "modified")
        fresh = there.join(known, ["file", "size", "modified"], "left_anti").select("file")
        gone = known.join(there, "file", "left_anti").select("file")
        return sorted(r["file"] for r in fresh.collect()), sorted(r["file"] for r in gone.collect())  # names, as in Spark's own list of files

    def build(self, path: str, force: bool = False) -> DataFrame:
        """Bring the cache up to date; a status row for each file: cached, processed, empty or failed. Files that fail or
        are empty are left out with a warning; none with a record is an error."""
        fresh, gone = self.changed(path)
        if force:
            fresh = sorted(r["file"] for r in listed(self.spark, path).collect())
        commits = self.store.commits()
        part = f"build-{commits[-1]['number'] + 1 if commits else 0}"
        if fresh or gone:
            kind = typed(f"{FINGERPRINT}, status string, error string, records bigint")
            dropped = self.spark.createDataFrame([(f, None, None, "gone", None, 0) for f in gone], kind)
            if fresh:
                names = self.spark.createDataFrame([(f,) for f in fresh], "file string")
                prints = listed(self.spark, path).join(names, "file")
                records = self.store.stage("parsed", part, parsed(lines_of(self.spark, fresh), self.schema, self.required))
                found = judged(names, records)
                self.store.stage("rows", part, found.rows)
                dropped = dropped.unionByName(prints.join(found.status, "file").select(*kind.names))
            self.store.stage("manifest", part, dropped)
            self.store.publish(part)
            self.store.files.delete(f"parsed/part={part}")
        report = self._known().select("file", F.when(F.col("file").isin(fresh) | (F.col("status") != "processed"), F.col("status")).otherwise("cached").alias("status"), "error", "records")
        for r in report.where("status in ('failed', 'empty')").limit(20).collect():
            warnings.warn(f"{r['file']} is left out: {r['error'] or r['status']}", RuntimeWarning, stacklevel=2)
        if report.where("records > 0").isEmpty():
            raise ValueError("none of the files has a record")
        return report

    def rows(self) -> DataFrame:
        """file and the records of every file's last reading."""
        kind = T.StructType([T.StructField("file", T.StringType()), *self.schema.fields])
        last = self._known().where("status = 'processed'").select("file", "__commit")
        return self.store.read("rows", kind).join(last, ["file", "__commit"]).select(*kind.names)


def write_lines(lines: DataFrame, name: str) -> str:
    """A new folder with the lines of each file of (file, line) below ``file=<name>``."""
    root = scratch(lines.sparkSession, name)
    lines.select("file", F.col("line").alias("value")).repartition("file").write.partitionBy("file").text(root)
    return root
