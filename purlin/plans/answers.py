"""Queries of answer checks, routing, the file registry, the index and conversation state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.functions import answers as fn
from purlin.functions import text
from purlin.operators import registry as ops
from purlin.plans.registry import Registry
from purlin.sources.views import read_view, run_sql

R = Registry()
ANSWERS = """select doc_id as answer_id, concat('Total carbon is ', cast(doc_id % 50 as string), ',5 kg [Clause 9-', cast(doc_id % 7 as string), ', Page ', cast(doc_id % 9 + 1 as string), '].', chr(10),
    'Mass 12 kg (بند ۹ - ', cast(doc_id % 5 as string), '، صفحه ', cast(doc_id % 4 + 1 as string), ')', chr(10), 'see [Document ', source, ', Section 9-', cast(doc_id % 3 as string), ', Page ', cast(doc_id % 6 + 1 as string), ']') as answer from {documents}"""
SOURCES = """select doc_id as answer_id, 1 as place, 'regulation' as type, source, source as document_id, concat('9-', cast(doc_id % 7 as string)) as clause_id, 'none' as section_id, cast(doc_id % 9 + 1 as string) as page_number, cast(null as string) as element_id, 'a' as name from {documents}
    union all select doc_id, 2, 'regulation', source, source, 'unknown', concat('9-', cast(doc_id % 2 as string)), cast(doc_id % 6 + 1 as string), cast(null as string), 'b' from {documents}
    union all select doc_id, 3, 'graph', null, null, null, null, null, concat('e', cast(doc_id % 10 as string)), 'wall' from {documents}
    union all select doc_id, 4, 'graph', null, null, null, null, null, concat('e', cast(doc_id % 10 as string)), 'wall' from {documents} where doc_id % 2 = 0"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, ANSWERS)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, SOURCES)


@R.operator(
    "citation_faults",
    """select doc_id as answer_id, 'clause' as kind, concat('9-', cast(doc_id % 5 as string)) as cited, cast(doc_id % 4 + 1 as int) as page from {documents} where not (doc_id % 5 = doc_id % 7 and doc_id % 4 = doc_id % 9)
      union all select doc_id, 'document', concat(source, '|9-', cast(doc_id % 3 as string)), cast(doc_id % 6 + 1 as int) from {documents} where doc_id % 3 <> doc_id % 2""",
)
def citation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.citation_faults(_answers(spark, sf_dir), _sources(spark, sf_dir)).select("answer_id", "kind", "cited", "page")


@R.operator("sources_used", "select answer_id, cast(place as int) as place from {sources} where type = 'graph' or place = 1 or (place = 2 and (answer_id % 3 = answer_id % 2))", sources=SOURCES)
def sources_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.used_sources(_answers(spark, sf_dir), _sources(spark, sf_dir)).select("answer_id", "place")


@R.operator("sources_distinct", "select answer_id, cast(place as int) as place from {sources} where place <> 4", sources=SOURCES)
def sources_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.distinct_sources(_sources(spark, sf_dir)).select("answer_id", "place")


@R.operator(
    "citations_canonical",
    """select doc_id as answer_id, concat('Total carbon is ', cast(doc_id % 50 as varchar), ',5 kg [Clause 9-', cast(doc_id % 7 as varchar), ', Page ', cast(doc_id % 9 + 1 as varchar), '].', chr(10),
    'Mass 12 kg [Clause 9-', cast(doc_id % 5 as varchar), ', Page ', cast(doc_id % 4 + 1 as varchar), ']', chr(10), 'see [Document ', source, ', Section 9-', cast(doc_id % 3 as varchar), ', Page ', cast(doc_id % 6 + 1 as varchar), ']') as answer from {documents}""",
)
def citations_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("answer_id", fn.canonical_citations(F.col("answer")).alias("answer"))


@R.operator(
    "sustainability_numbers_grounded",
    """select doc_id as answer_id, cast(case when doc_id % 50 = 7 then 0 else 1 end + 1 as int) as invalid from {documents}""",
)
def sustainability_numbers_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the evidence holds 7.5 alone; both quantity lines name a number
    found = fn.ungrounded_numbers(F.col("answer"), F.lit("carbon 7.5 kg"), F.lit("no numbers here"))
    return _answers(spark, sf_dir).select("answer_id", F.size(found).alias("invalid"))


@R.operator("unsupported_number_audit", "select doc_id as answer_id, cast(2 - case when doc_id % 50 = 12 then 1 else 0 end - case when doc_id % 50 = 5 then 1 else 0 end as int) as invalid from {documents} where doc_id % 50 > 12")
def unsupported_number_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fn.unsupported_numbers(F.col("answer"), F.lit("the numbers 5 and 99"))
    return _answers(spark, sf_dir).where("answer_id % 50 > 12").select("answer_id", F.size(found).alias("invalid"))


QUESTIONS = {
    0: ("list all LEED requirements for the project and assess the evidence", (True, True, True, True, True, "leed,standard,sustainability")),
    1: ("what is the embodied carbon of the model", (True, True, True, False, True, "")),
    2: ("how many IfcWall are there", (False, True, False, False, True, "")),
    3: ("hello", (True, True, False, False, False, "")),
    4: ("sustainable material guidance and building code", (True, True, False, False, True, "leed,regulation,standard,sustainability")),
    5: ("which regulation names IfcDoor in the uploaded pdf", (True, True, False, False, True, "")),
}
QUESTION = "case cast(doc_id % 6 as int) " + " ".join(f"when {k} then '{q}'" for k, (q, _) in QUESTIONS.items()) + " end"
ROUTES = ["needs_vector", "needs_graph", "needs_sustainability", "needs_leed", "is_technical", "domains"]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select doc_id, {QUESTION} as question from {{documents}}")


@R.operator(
    "routing_policy",
    "select doc_id, " + ", ".join("case cast(doc_id % 6 as int) " + " ".join(f"when {k} then {str(v[i]).lower() if i < 5 else repr(v[i])}" for k, (_, v) in QUESTIONS.items()) + f" end as {c}" for i, c in enumerate(ROUTES)) + " from {documents}",
)
def routing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = {c: F.lit(None).cast("boolean") for c in ROUTES[:5]} | {"domains": F.lit(None).cast("array<string>")}
    return fn.routed(_questions(spark, sf_dir).withColumns(blank)).select("doc_id", *ROUTES[:5], F.array_join("domains", ",").alias("domains"))


R.sql(
    "completeness_triggers",
    f"select doc_id, regexp_like(question, '(?i)(\\\\ball\\\\b|\\\\blist\\\\b|\\\\brequirements?\\\\b|\\\\bcomplete\\\\b|\\\\bevery\\\\b|\\\\bstandards?\\\\b|\\\\bdimensions?\\\\b)') as complete from (select doc_id, {QUESTION} as question from {{documents}}) q",
    oracle=f"select doc_id, regexp_matches(question, '(?i)(\\ball\\b|\\blist\\b|\\brequirements?\\b|\\bcomplete\\b|\\bevery\\b|\\bstandards?\\b|\\bdimensions?\\b)') as complete from (select doc_id, {QUESTION} as question from {{documents}}) q",
)


@R.operator("router_outage", "select doc_id, case cast(doc_id % 6 as int) when 3 then false when 1 then false when 2 then false else true end as needs_vector, doc_id % 6 in (2, 5) as needs_graph, doc_id % 6 in (0, 1) as needs_sustainability, doc_id % 6 <> 3 as is_technical from {documents}")
def router_outage(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {"topic": F.lit(None).cast("string"), **{f"last_{c}": F.lit(None).cast("boolean") for c in ("vector", "graph", "sustainability")}}
    found = fn.routed_without_router(_questions(spark, sf_dir).withColumns(none))
    return found.select("doc_id", "needs_vector", "needs_graph", "needs_sustainability", "is_technical")


@R.operator("leed_language", "select doc_id, case cast(doc_id % 4 as int) when 0 then true when 1 then false when 2 then true else false end as fits from {documents}")
def leed_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "case cast(doc_id % 4 as int) when 0 then 'state: insufficient_evidence' when 1 then 'the building is now LEED Gold' when 2 then 'nothing to say' else 'not_satisfied_from_available_evidence' end"
    return read_view(spark, sf_dir, "documents").select("doc_id", fn.leed_language_fits(F.expr(says), F.lit("insufficient_evidence")).alias("fits"))


@R.operator(
    "checklist_coverage",
    "select item_id as query_id, cast(4 as bigint) as items, cast(1 + item_id % 4 as bigint) as covered from {benchmark}",
)
def checklist_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("list all items of the table").alias("question"))
    cells = '[["Item","Value"],["alpha one","v1"],["beta two","v2"],["gamma three","v3"],["delta four","v4"]]'
    chunks = asked.select("query_id", F.lit(1).alias("position"), F.lit("d").alias("document_id"), F.lit("9-1").alias("section_id"), F.lit("").alias("text"), F.lit(cells).alias("table_data_json"))
    names = F.array(*[F.lit(x) for x in ("Alpha-One", "beta two", "GAMMA  three", "delta.four")])
    answers = asked.select("query_id", F.array_join(F.slice(names, 1, (F.col("query_id") % 4 + 1).cast("int")), "; ").alias("answer"))
    found = fn.coverage(fn.checklist(asked.withColumn("question", F.lit("list every item in the table")), chunks), answers)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("covered"), 1)).alias("covered"))


R.sql("fact_coverage", "select item_id, contains(lower(text), ' a ') or contains(lower(text), 'the') as hit from {benchmark}")
R.sql(
    "answer_metrics",
    "select count(*) as cases, count(case when quality = 1 then 1 end) as correct, floor(avg(case when toxic = 0 then 1e0 else 0e0 end) * 1e6 + 0.5) / 1e6 as clean_rate, floor(avg(case when quality is not null then cast(quality as double) end) * 1e6 + 0.5) / 1e6 as mean_quality from {labels}",
)

# The file registry
FILES = """select concat('P', cast(o_custkey % 4 as string)) as project_id, concat('F', cast(o_custkey % 40 as string)) as file_id, concat('f', cast(o_custkey % 40 as string), '.ifc') as filename, concat('/data/f', cast(o_custkey % 40 as string)) as stored_path,
    case when o_custkey % 40 % 3 = 0 then 'ingested' else 'uploaded' end as status, 'waiting' as processing_status, min(o_orderdate) as uploaded_at, case when o_custkey % 40 % 5 = 0 then 'boom' end as error from {orders} group by o_custkey % 4, o_custkey % 40"""
UPLOADS = """select concat('P', cast(o_custkey % 4 as string)) as project_id, concat('F', cast(o_custkey % 60 as string)) as file_id, concat('v2-', cast(o_custkey % 60 as string), '.ifc') as filename, concat('/data/f', cast(o_custkey % 60 as string)) as stored_path, max(o_orderdate) as uploaded_at
    from {orders} where o_custkey % 60 % 4 = 0 group by o_custkey % 4, o_custkey % 60"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, FILES)


@R.operator(
    "registry_upsert",
    """select coalesce(n.project_id, o.project_id) as project_id, coalesce(n.file_id, o.file_id) as file_id, coalesce(n.filename, o.filename) as filename, coalesce(o.status, 'uploaded') as status, case when o.file_id is null then 'ready_for_ingestion' else o.processing_status end as processing_status,
      coalesce(o.uploaded_at, n.uploaded_at) as uploaded_at, case when n.file_id is null then o.error end as error from {files} o full outer join {uploads} n on o.project_id = n.project_id and o.file_id = n.file_id""",
    files=FILES, uploads=UPLOADS,
)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.register(_files(spark, sf_dir), run_sql(spark, sf_dir, UPLOADS)).drop("stored_path")


@R.operator("registry_projects", "select project_id, count(*) as file_count, max(uploaded_at) as updated_at, string_agg(file_id, ',' order by uploaded_at, file_id) as files from {files} group by project_id", files=FILES)
def registry_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.projects(_files(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


@R.operator("registry_removal", "select project_id, count(*) as left_files from {files} where not (project_id = 'P1' or (project_id = 'P2' and file_id = 'F2')) group by project_id", files=FILES)
def registry_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    gone = [r[0] for r in files.where("project_id = 'P1'").select("file_id").collect()]  # a project's files
    left = ops.removed(ops.removed(files, "P1", gone)[0], "P2", ["F2"])[0]
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("left_files"))


@R.operator("registry_reset", "select project_id, file_id, 'uploaded' as status, status = 'ingested' as changed from {files}", files=FILES)
def registry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    reset, _ = ops.out_of_graph(files)
    return reset.join(files.select("project_id", "file_id", (F.col("status") == "ingested").alias("changed")), ["project_id", "file_id"]).select("project_id", "file_id", "status", "changed")


@R.operator("registry_files_of_project", "select file_id, status from {files} where project_id = 'P0' and file_id in ('F0', 'F4', 'F8')", files=FILES)
def registry_files_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.of_project(_files(spark, sf_dir), "P0", ["F0", "F4", "F8"]).select("file_id", "status")


@R.operator("registry_scope", "select file_id from {files} where project_id = 'P0' and status = 'ingested'", files=FILES)
def registry_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve_scope(_files(spark, sf_dir), "P0", None).select("file_id")


@R.operator("unregistered_files", "select distinct concat('/data/f', cast(c_custkey % 90 as varchar)) as path from {customer} where concat('/data/f', cast(c_custkey % 90 as varchar)) not in (select stored_path from {files})", files=FILES)
def unregistered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = run_sql(spark, sf_dir, "select distinct concat('/data/f', cast(c_custkey % 90 as string)) as path from {customer}")
    return ops.unregistered(disk, _files(spark, sf_dir))


# The index
CHUNKS = "select doc_id as chunk_id, concat(source, '/', cast(doc_id % 16 as string)) as document_id, text from {documents}"


@R.operator("source_content_duplicates", "select sha256(coalesce(text, '')) as content_hash, min(concat('/src/', lpad(cast(doc_id as varchar), 9, '0'))) as path, count(*) as copies from {documents} group by 1")
def source_content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_view(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), F.concat(F.lit("/src/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"))
    return ops.first_of_content(files)


@R.operator("index_delete_counts", "select w.document_id, count(c.chunk_id) as deleted from (select unnest(['src1/1', 'src2/2', 'nowhere']) as document_id) w left join {chunks} c on w.document_id = c.document_id group by w.document_id", chunks=CHUNKS)
def index_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(1).select(F.explode(F.array(F.lit("src1/1"), F.lit("src2/2"), F.lit("nowhere"))).alias("document_id"))
    return ops.delete_documents(run_sql(spark, sf_dir, CHUNKS), ids)[1]


@R.operator("index_replace_document", "select chunk_id, document_id from {chunks} where document_id not in (select document_id from {chunks} where chunk_id % 10 = 0) union all select chunk_id + 1000000, document_id from {chunks} where chunk_id % 10 = 0", chunks=CHUNKS)
def index_replace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = run_sql(spark, sf_dir, CHUNKS).select("chunk_id", "document_id")
    return ops.replace_document(chunks, chunks.where("chunk_id % 10 = 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000))


@R.operator("index_manifest", "select '3' as index_version, 'p' as embedding_provider, 'm' as embedding_model, count(*) as total_chunks, count(distinct document_id) as documents from {chunks}", chunks=CHUNKS)
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.index_manifest(run_sql(spark, sf_dir, CHUNKS), "3", "p", "m").drop("by_document")


SCENES = "select source_file_id as file_id, coalesce(storey_name, 'unassigned') as scene_key, count(*) as elements from {elements} group by 1, 2"


@R.operator("scene_manifest_merge", "select file_id, scene_key, elements from {scenes} where file_id in ('F0') union all select file_id, scene_key, elements + 1 from {scenes} where file_id = 'F1'", scenes=SCENES)
def scene_manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = run_sql(spark, sf_dir, SCENES)
    new = scenes.where("file_id = 'F1'").withColumn("elements", F.col("elements") + 1)
    keep = spark.range(1).select(F.explode(F.array(F.lit("F0"), F.lit("F1"))).alias("file_id"))
    return ops.merged_manifest(scenes, new, keep).select("file_id", "scene_key", "elements")


# Conversation state
FINDINGS = "select conv_id, turn, case when turn % 2 = 0 then 'MR Credit' else 'mr credit' end as criterion, concat('P', cast(conv_id % 2 as string)) as project_id, split(case when turn % 3 = 0 then 'F0,F1' else 'F1,F0' end, ',') as file_ids, length(text) as score from {conversations}"


@R.operator("findings_ledger", "select conv_id, turn, score from (select conv_id, turn, length(text) as score, row_number() over (partition by conv_id order by turn desc) as rn from {conversations}) x where rn = 1")
def findings_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ledger(run_sql(spark, sf_dir, FINDINGS)).select("conv_id", "turn", "score")


@R.operator("state_eviction_ttl", "select user_id as conv_id, max(ts) as last_access from {events} group by user_id having max(ts) >= (select max(ts) from {events}) - interval 6 hour order by last_access desc, conv_id limit 1000")
def state_eviction_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = read_view(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.max("ts").alias("last_access"))
    latest = states.agg(F.max("last_access")).first()[0]
    return ops.evicted(states, F.lit(latest).cast("timestamp_ntz"))


R.sql("cleared_conversation", "select conv_id, count(*) as turns from {conversations} where conv_id <> 3 group by conv_id")

# Text functions over whole columns
UNITS = "select p_partkey, p_size as value, case cast(p_partkey % 4 as int) when 0 then 'mass' when 1 then 'length' when 2 then 'area' else 'volume' end as kind, case cast(p_partkey % 4 as int) when 0 then ' LB ' when 1 then 'mm' when 2 then 'Square   Foot' else 'furlong' end as unit from {part}"


@R.operator("unit_normalisation", "select p_partkey, floor(case cast(p_partkey % 4 as int) when 0 then p_size * 0.45359237 when 1 then p_size * 0.001 when 2 then p_size * 0.09290304 end * 1e6 + 0.5) / 1e6 as normalized, p_partkey % 4 = 3 as failed from {part}")
def unit_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = text.normalised_quantity(F.col("value").cast("double"), F.col("kind"), F.col("unit"))
    return run_sql(spark, sf_dir, UNITS).select("p_partkey", value.alias("n")).selectExpr("p_partkey", "floor(n * 1e6 + 0.5) / 1e6 as normalized", "n is null as failed")


@R.operator("si_prefix_scales", "select p_partkey, power(case cast(p_partkey % 4 as int) when 0 then 1e0 when 1 then 1e-3 when 2 then 1e3 else 1e-2 end, 2) as scale from {part}")
def si_prefix_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.expr("case cast(p_partkey % 4 as int) when 0 then '' when 1 then 'milli' when 2 then 'KILO' else 'centi' end")
    return read_view(spark, sf_dir, "part").select("p_partkey", text.si_scale(prefix, 2).alias("scale"))


@R.operator("safe_ids", "select p_partkey, substr(trim(regexp_replace(concat('-', p_brand, ' ', p_name, '/', p_type, '.'), '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), 1, 80) as slug from {part}")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "part").select("p_partkey", text.safe_id(F.concat(F.lit("-"), "p_brand", F.lit(" "), "p_name", F.lit("/"), "p_type", F.lit("."))).alias("slug"))


@R.operator("clean_scalars", "select p_partkey, case when p_partkey % 3 = 0 then '' else p_name end as cleaned from {part}")
def clean_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "part").select("p_partkey", text.clean_scalar(F.expr("case when p_partkey % 3 = 0 then ' NaN' else p_name end")).alias("cleaned"))


@R.operator("parent_sections", "select doc_id, case when doc_id % 2 = 0 then concat('9-', cast(doc_id % 7 as varchar), '-', cast(doc_id % 5 as varchar)) else concat('9-', cast(doc_id % 7 as varchar)) end as parent_id, regexp_replace(section_id, '-[0-9]+$', '') as dropped from {sections}")
def parent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "sections").select("doc_id", text.parent_section(F.col("section_id")).alias("parent_id"), text.parent_by_drop(F.col("section_id")).alias("dropped"))


@R.operator("headings", r"select doc_id, trim(substr(split(text, chr(10))[1], 1, 200)) as heading from {documents} where regexp_matches(text, '^[A-ZÀ-Ý][a-zà-ÿ]')")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "documents").where(F.col("text").rlike("^[A-ZÀ-Ý][a-zà-ÿ]")).select("doc_id", text.heading(F.col("text")).alias("heading"))


@R.operator("stable_ids", "select p_partkey, sha256(concat(p_name, '|', cast(p_partkey as varchar), '|')) as id from {part}")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "part").select("p_partkey", text.stable_id(F.col("p_name"), F.col("p_partkey"), F.lit(None).cast("string")).alias("id"))


@R.operator("embedding_labels", "select doc_id, concat(case when source <> 'src1' then concat(source, ' | ') else '' end, section_id, chr(10), 'x') as labelled from {s}", s="select s.doc_id, s.section_id, s.document_id as source from {sections} s")
def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.expr("case when document_id <> 'src1' then document_id end")
    return read_view(spark, sf_dir, "sections").select("doc_id", text.embedding_text(document, F.col("section_id"), F.lit(""), F.lit("x")).alias("labelled"))


@R.operator("valid_sources", "select doc_id, doc_id % 3 <> 0 as valid from {documents}")
def valid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "documents").select("doc_id", text.valid_source(F.expr("case when doc_id % 9 = 0 then ' Unknown' when doc_id % 9 = 3 then null when doc_id % 9 = 6 then 'NONE' else source end")).alias("valid"))


@R.operator("boolean_texts", "select p_partkey, p_partkey % 4 < 2 as value from {part}")
def boolean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "part").select("p_partkey", text.boolean_text(F.expr("case cast(p_partkey % 4 as int) when 0 then ' YES' when 1 then 'enabled' when 2 then 'no' end")).alias("value"))


@R.operator("domains_normalised", "select p_partkey, case cast(p_partkey % 4 as int) when 0 then 'leed' when 1 then 'standard' else 'regulation' end as domain from {part}")
def domains_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "part").select("p_partkey", text.domain_of(F.expr("case cast(p_partkey % 4 as int) when 0 then ' LEED' when 1 then 'standard' when 2 then 'other' end")).alias("domain"))


@R.operator("arabic_forms", "select p_partkey, concat('موسسه اب ', cast(p_partkey as varchar), '-2 ي'[1:7], 'می شود') as plain from {part}".replace("'-2 ي'[1:7]", "'-2 ی '"))
def arabic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("مؤسسة  أبـ "), F.col("p_partkey").cast("string"), F.lit("–۲ ي می‌شود"))
    return read_view(spark, sf_dir, "part").select("p_partkey", text.normalise_text(raw).alias("plain"))


@R.operator("question_terms", "select item_id, 'mabhas,19,walls' as terms from {benchmark}")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.terms_of(F.lit("What is  the Mabhas ۱۹ of Walls for")), ",").alias("terms"))


@R.operator("heading_scores", "select item_id, case cast(item_id % 3 as int) when 0 then 1e0 when 1 then 0.5e0 else 0e0 end as score from {benchmark}")
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr("case cast(item_id % 3 as int) when 0 then 'Fire  Doors' when 1 then 'door handles' else '' end")
    return read_view(spark, sf_dir, "benchmark").select("item_id", text.heading_score(F.lit("which fire doors have a door"), title).alias("score"))


@R.operator("document_scores", "select item_id, case when item_id % 3 = 2 then 0e0 else 1e0 end as score from {benchmark}")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, source = F.expr("case when item_id % 3 = 0 then '15' end"), F.expr("case when item_id % 3 = 1 then ' 15_lifts.pdf' else '150.pdf' end")
    return read_view(spark, sf_dir, "benchmark").select("item_id", text.document_score(F.lit("see Mabhas ۱۵"), number, source).alias("score"))


QUERIES, ORACLE_SQL = R.queries, R.oracles
