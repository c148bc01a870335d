"""Shared pieces: frozen tables in the cluster's shared folder, bounded caches, column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}  # frozen tables by path
_local: dict[str, str] = {}  # folders of local sessions, by application


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``. A temporary one where that is unset and the session is a
    local one (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="purlin-"))


def freeze(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The folder stays until ``discard`` of the frame, ``release``, or the end of the driver's Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/purlin-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._purlin_path = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; other tables are still tried
        pass


def discard(*frames: DataFrame) -> None:
    """Delete frozen tables that nothing is going to read any more."""
    for frame in frames:
        if (path := getattr(frame, "_purlin_path", None)) in _written:
            _delete(path)


def release() -> None:
    """Delete every frozen table; frames that still read one become unusable. For long sessions, between queries."""
    for path in list(_written):
        _delete(path)


atexit.register(release)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_purlin_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="purlin-")) / "purlin_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(target))
    context._purlin_shipped = True


def give_back() -> None:
    """Return freed memory to the system: after a fit the C library would keep some hundred MB of small arrays' memory in the driver."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns __c0, __c1, ..., so operators' own names can't clash; and the new name of each."""
    names = {c: f"__c{i}" for i, c in enumerate(keep or df.columns)}
    return df.select(*[quoted(c).alias(n) for c, n in names.items()]), names


def renamed_back(names: dict[str, str]) -> list[Column]:
    return [F.col(n).alias(c) for c, n in names.items()]


def id_crc(id_col: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(id_col.cast("string").cast("binary"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))


class Memo(dict):
    """``fn`` remembered for short keys; emptied at ``limit`` entries, so memory stays bounded."""

    def __init__(self, fn: Callable, limit: int = 300_000, longest: int = 48):
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
