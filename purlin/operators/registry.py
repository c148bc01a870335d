"""Tables of files, index documents and conversations: upserts, transitions, removal, listings. All are whole-table rewrites
that a single writer stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["project_id", "file_id"]


def register(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """``files`` with ``uploads`` in: what a file was before stays (status, processing_status, uploaded_at), the rest is new
    and its error is gone."""
    old = files.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in files.columns if c not in KEY], F.lit(True).alias("had"))
    new = uploads.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in uploads.columns if c not in KEY], F.lit(True).alias("has"))
    rows = old.join(new, KEY, "full")
    has = F.coalesce("has", F.lit(False))
    kept = {"status": "uploaded", "processing_status": "ready_for_ingestion"}
    out = list(KEY)
    for c in files.columns:
        if c in KEY:
            continue
        fresh = F.col(f"new_{c}") if f"new_{c}" in rows.columns else F.col(f"old_{c}")
        if c in kept:
            value = F.when(has, F.coalesce(F.col(f"old_{c}"), F.lit(kept[c]))).otherwise(F.col(f"old_{c}"))
        elif c == "uploaded_at":
            value = F.coalesce(F.col("old_uploaded_at"), fresh)
        elif c == "error":
            value = F.when(~has, F.col("old_error"))
        else:
            value = F.when(has, fresh).otherwise(F.col(f"old_{c}"))
        out.append(value.alias(c))
    return rows.select(*out)


def patched(files: DataFrame, project: str, file: str, **values: object) -> DataFrame:
    """One record with new values; an unknown one is an error."""
    own = (F.col("project_id") == project) & (F.col("file_id") == file)
    if files.where(own).isEmpty():
        raise KeyError(f"unknown file {project}/{file}")
    return files.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def removed(files: DataFrame, project: str, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files left, files removed); a project is gone with its last file, as projects are what files name."""
    own = F.coalesce((F.col("project_id") == project) & F.col("file_id").isin(ids), F.lit(False)) if ids else F.lit(False)
    return files.where(~own), files.where(own).orderBy("uploaded_at", "file_id")


def out_of_graph(files: DataFrame) -> tuple[DataFrame, Column]:
    """Every ingested file back to uploaded after a full reset, and the condition by which the changed ones are counted."""
    changed = F.col("status") == "ingested"
    reset = {"status": F.when(changed, "uploaded").otherwise(F.col("status")), "processing_status": F.when(changed, "ready_for_ingestion").otherwise(F.col("processing_status"))}
    return files.withColumns(reset), changed


def of_project(files: DataFrame, project: str, ids: list[str] | None = None) -> DataFrame:
    rows = files.where(F.col("project_id") == project)
    return (rows.where(F.col("file_id").isin(ids)) if ids else rows).orderBy("uploaded_at", "file_id")


def projects(files: DataFrame) -> DataFrame:
    """A row a project: number of files, the last upload, and the files by time of upload. A project has some dozens."""
    listed = F.sort_array(F.collect_list(F.struct("uploaded_at", "file_id")))
    return files.groupBy("project_id").agg(F.count(F.lit(1)).alias("file_count"), F.max("uploaded_at").alias("updated_at"), F.transform(listed, lambda x: x["file_id"]).alias("files"))


def unregistered(disk: DataFrame, files: DataFrame) -> DataFrame:
    """Files on disk (path) that no record names."""
    return disk.join(files.select(F.col("stored_path").alias("path")), "path", "left_anti")


def resolve_scope(files: DataFrame, project: str, wanted: list[str] | None) -> DataFrame:
    """The ingested files of a project; wanted ones that are unknown, or not ingested, are an error, as is none at all."""
    rows = of_project(files, project, wanted)
    found = rows.select("file_id", "status").limit(10_000).collect()  # a project's files
    missing = sorted(set(wanted or []) - {r["file_id"] for r in found})
    if missing:
        raise LookupError(f"unknown file ids: {missing}")
    if wanted:
        if waiting := sorted(r["file_id"] for r in found if r["status"] != "ingested"):
            raise ValueError(f"not ingested: {waiting}")
    else:
        rows = rows.where("status = 'ingested'")
    if not any(r["status"] == "ingested" for r in found):
        raise LookupError("no ingested files in scope")
    return rows


def first_of_content(files: DataFrame) -> DataFrame:
    """Of files (path, content_hash) with equal bytes the one whose path sorts first."""
    return files.groupBy("content_hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def delete_documents(chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks left, deleted chunks by document; 0 for unknown ids). ``ids``: document_id."""
    wanted = ids.distinct()
    counts = wanted.join(chunks.join(wanted, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left")
    return chunks.join(wanted, "document_id", "left_anti"), counts.select("document_id", F.coalesce("n", F.lit(0)).alias("deleted"))


def replace_document(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` in place of what there was of its documents."""
    return chunks.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def index_manifest(chunks: DataFrame, version: str, provider: str, model: str) -> DataFrame:
    """One row: totals, what made the index, and its documents with their chunks."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_list(F.struct("document_id", "n"))).alias("by_document"))
    return row.select(F.lit(version).alias("index_version"), F.lit(provider).alias("embedding_provider"), F.lit(model).alias("embedding_model"), "*")


def index_fits(manifest: DataFrame, version: str, provider: str, model: str) -> bool:
    """Whether an index was made by the same version, provider and model."""
    row = manifest.select("index_version", "embedding_provider", "embedding_model").first()
    return row is not None and tuple(row) == (version, provider, model)


def merged_manifest(old: DataFrame, new: DataFrame, keep: DataFrame) -> DataFrame:
    """Scenes (file_id, scene_key, ...): the files of ``new`` replaced, and only files of ``keep`` (file_id) left."""
    left = old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new, allowMissingColumns=True)
    return left.join(keep.select("file_id"), "file_id", "left_semi")


def ledger(findings: DataFrame, most: int = 20) -> DataFrame:
    """The last ``most`` findings of each conversation, one for each criterion, project and set of files: the latest."""
    key = [F.lower("criterion"), F.col("project_id"), F.concat_ws("\x01", F.sort_array("file_ids"))]
    once = findings.withColumn("__n", F.row_number().over(Window.partitionBy("conv_id", *key).orderBy(F.col("turn").desc()))).where("__n = 1")
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return once.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most).drop("__n")


def findings_of(entries: DataFrame, conversation: str, project: str, files: list[str]) -> DataFrame:
    scope = F.array(*[F.lit(f) for f in sorted(files)]).cast("array<string>")
    return entries.where((F.col("conv_id") == conversation) & (F.col("project_id") == project) & (F.sort_array("file_ids") == scope))


def evicted(states: DataFrame, now: Column, ttl_seconds: int = 21_600, most: int = 1000) -> DataFrame:
    """Conversations (conv_id, last_access) that stay: not older than the time to live, and of those the latest ``most``."""
    live = states.where(F.col("last_access") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
    return live.orderBy(F.col("last_access").desc(), "conv_id").limit(most)
