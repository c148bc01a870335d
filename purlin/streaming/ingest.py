"""Incremental ingest of documents: files arrive as a stream, a document's new version replaces the old one's chunks.

``DocumentIndex.apply`` is what ``foreachBatch`` calls. Of a micro-batch the last version of each document counts; a document that
can't be indexed gets a status and leaves what was indexed before. Chunks and the log of the batch are staged, then one
commit makes both visible (``sources/store.py``); a batch that was committed before changes nothing. Nothing is rewritten: a
document's current chunks are those of its last commit in the log, an equi-join with a table of one row a document.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from purlin.sources.store import Store, typed

LOG = "document_id string, filename string, status string, error string, chunks_extracted bigint, stale_chunks_replaced bigint"


class DocumentIndex:
    """``chunker`` maps documents (document_id, ...) to chunks (document_id, ...; schema ``chunk_schema``).

    ``fault``: a condition over the documents' columns, an error text or null.
    """

    def __init__(self, spark: SparkSession, root: str, chunker: Callable[[DataFrame], DataFrame], chunk_schema: str, fault: Column | None = None):
        self.spark, self.store, self.chunker, self.fault = spark, Store(spark, root), chunker, fault
        self.schema = typed(chunk_schema)

    def _log(self, commits: list[dict[str, Any]] | None = None) -> DataFrame:
        return self.store.read("log", LOG, commits)

    def _current(self, commits: list[dict[str, Any]] | None = None) -> DataFrame:
        """(document_id, __commit, chunks): the last commit that indexed each document."""
        good = self._log(commits).where("status = 'indexed'")
        return good.groupBy("document_id").agg(F.max(F.struct("__commit", "chunks_extracted")).alias("last")).select("document_id", "last.__commit", F.col("last.chunks_extracted").alias("chunks"))

    def chunks(self) -> DataFrame:
        """The chunks of every document's last version."""
        commits = self.store.commits()
        rows = self.store.read("chunks", self.schema, commits)
        return rows.join(self._current(commits).drop("chunks"), ["document_id", "__commit"]).select(*self.schema.names)

    def log(self) -> DataFrame:
        """A row for each document of each batch: status indexed or failed, and what it replaced."""
        return self._log().withColumnRenamed("__commit", "commit")

    def apply(self, batch: DataFrame, batch_id: int, stream: str = "default") -> None:
        """Index one micro-batch: document_id, filename, version, and what the chunker reads."""
        commits = self.store.commits()
        if any((c.get("stream"), c.get("batch")) == (stream, batch_id) or batch_id <= c.get("done", {}).get(stream, -1) for c in commits):
            return
        part = f"{stream}-{batch_id:012d}"
        whole = F.struct(*batch.columns)
        last = batch.groupBy("document_id").agg(F.max_by(whole, F.struct("version", F.xxhash64(*batch.columns))).alias("d")).select("d.*")
        last = self.store.stage("arrived", part, last.withColumn("__fault", (self.fault if self.fault is not None else F.lit(None)).cast("string")))
        chunks = self.store.stage("chunks", part, self.chunker(last.where("__fault is null").drop("__fault")).select(*self.schema.names))
        counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        log = last.select("document_id", "filename", "__fault").join(counts, "document_id", "left").join(self._current(commits).drop("__commit"), "document_id", "left")
        error = F.coalesce("__fault", F.when(F.col("n").isNull(), F.lit("no text could be extracted")))
        log = log.select(
            "document_id",
            "filename",
            F.when(error.isNull(), "indexed").otherwise("failed").alias("status"),
            error.alias("error"),
            F.coalesce("n", F.lit(0)).cast("long").alias("chunks_extracted"),
            F.when(error.isNull(), F.coalesce("chunks", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("stale_chunks_replaced"),
        )
        self.store.stage("log", part, log)
        self.store.publish(part, stream=stream, batch=batch_id)
        self.store.files.delete(f"arrived/part={part}")

    def start(self, arriving: DataFrame, checkpoint: str, stream: str = "default", **trigger: Any) -> StreamingQuery:
        """Index what a stream brings, batch by batch; ``trigger`` as of ``DataStreamWriter.trigger``."""
        writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: self.apply(batch, i, stream))
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def delete(self, ids: list[str]) -> None:
        """Documents leave the index: a commit whose log says they have no chunks."""
        commits = self.store.commits()
        gone = self.spark.createDataFrame([(i,) for i in sorted(set(ids))], "document_id string").join(self._current(commits), "document_id", "left")
        part = f"deleted-{commits[-1]['number'] + 1 if commits else 0}"
        log = gone.select("document_id", F.lit(None).cast("string").alias("filename"), F.lit("indexed").alias("status"), F.lit("deleted").alias("error"), F.lit(0).cast("long").alias("chunks_extracted"), F.coalesce("chunks", F.lit(0)).cast("long").alias("stale_chunks_replaced"))
        self.store.stage("log", part, log)
        self.store.publish(part)

    def compact(self) -> None:
        """One commit in place of all: current chunks and a log line for each document. Batches done stay known as done."""
        commits = self.store.commits()
        done: dict[str, int] = {}
        for c in commits:
            for stream, batch in [*c.get("done", {}).items(), *([(c["stream"], c["batch"])] if "stream" in c else [])]:
                done[stream] = max(batch, done.get(stream, -1))
        log = self._log(commits).where("status = 'indexed'")
        last = log.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "__commit"]), "__commit").alias("l")).select("l.*").where("chunks_extracted > 0")
        self.store.compact({"chunks": self.chunks(), "log": last}, done=done)
