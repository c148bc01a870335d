"""Queries on streams: windows over events, which run on batch frames too, conversation state, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.functions.text import fixed_windows
from purlin.plans.registry import Registry
from purlin.sources.store import scratch
from purlin.sources.views import read_view
from purlin.streaming import events as ops
from purlin.streaming.ingest import DocumentIndex
from purlin.streaming.sessions import LiveTable, conversation_events

R = Registry()


@R.operator(
    "event_tumbling_counts",
    "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as events, cast(sum(cast(value as decimal(18,4))) as double) as total from {events} group by 1, 2",
)
def event_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.tumbling_counts(read_view(spark, sf_dir, "events"))
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", "total")


@R.operator(
    "event_sessions",
    """select user_id, count(*) as sessions, cast(max(n) as bigint) as largest, cast(sum(n) as bigint) as events from (
        select user_id, s, count(*) as n from (select user_id, ts, sum(case when before is null or ts >= before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as s
          from (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as before from {events}) a) b group by user_id, s) c group by user_id""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sessions(read_view(spark, sf_dir, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("largest"), F.sum("events").alias("events"))


@R.operator(
    "conversation_expiry",
    """select user_id as conv_id, count(*) as messages, max(ts) as last_access, string_agg(event_type || ': ' || props, '|' order by event_id) filter (n <= 4) as recent from (
        select *, row_number() over (partition by user_id order by event_id desc) as n from {events}) e
      group by user_id having max(ts) >= (select max(ts) from {events}) - interval 6 hour order by last_access desc, conv_id limit 1000""",
)
def conversation_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that a stream of all events leaves alive: timers end the others on the event clock."""
    events = read_view(spark, sf_dir, "events")
    root = scratch(spark, "conversations")
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: the table may be one file or a folder
    turns = arriving.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"), F.col("props").alias("text"), "ts")
    table = LiveTable(spark, f"{root}/live")
    query = conversation_events(turns).writeStream.option("checkpointLocation", f"{root}/stream").outputMode("update").foreachBatch(table.apply).trigger(availableNow=True).start()
    query.awaitTermination()
    now = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return table.live(F.lit(now)).select("conv_id", "messages", F.col("last_access").cast("timestamp_ntz").alias("last_access"), F.array_join("recent", "|").alias("recent"))


ARRIVALS = {
    "first": "select cast(doc_id as string) as document_id, concat('d', cast(doc_id as string), '.txt') as filename, cast(1 as bigint) as version, text from {documents}",
    # of every third document a shorter version comes, twice in one drop; of every fifth one of a kind that isn't taken; every seventh comes empty
    "second": """select cast(doc_id as string) as document_id, concat('d', cast(doc_id as string), case when doc_id % 5 = 0 then '.exe' else '.txt' end) as filename, cast(k + 1 as bigint) as version,
        case when doc_id % 7 = 0 then '' else concat('v', cast(k + 1 as string), ' ', substr(text, 1, cast(floor(length(text) / 2) as int))) end as text
      from {documents} cross join (select 1 as k union all select 2 as k) x where doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0""",
}
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CHUNKS = "document_id string, version bigint, chunk_no int, chunk string"


def _chunked(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "version", F.posexplode(fixed_windows(F.col("text"), 1200, 200)).alias("chunk_no", "chunk"))


@R.operator(
    "incremental_ingest",
    "select document_id, version, cast(row_number() over (partition by document_id order by i) - 1 as int) as chunk_no, length(chunk) as n_chars, md5(chunk) as chunk_md5 from {cut} where chunk <> ''",
    **{"good": f"select * from (select * from {{first}} union all select * from {{second}}) a where filename like '%.txt' and trim(coalesce(text, ''), {BLANKS}) <> ''",
       "last": "select document_id, max(version) as version from {good} group by document_id",
       "pieces": "select g.document_id, g.version, text, unnest(range(0, cast(greatest(ceil((length(text) - 1200) / 1000.0), 0) as bigint) + 1)) as i from {good} g join {last} l on g.document_id = l.document_id and g.version = l.version",
       "cut": f"select *, trim(substr(text, cast(i * 1000 + 1 as bigint), 1200), {BLANKS}) as chunk from {{pieces}}"},
    **ARRIVALS,
)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of an index that all documents reach in two drops of a file stream; a drop's last version of a document counts."""
    root = scratch(spark, "ingest")
    taken = F.when(~F.col("filename").endswith(".txt"), "only .txt files are taken")
    index = DocumentIndex(spark, f"{root}/index", _chunked, CHUNKS, fault=taken)
    for drop, sql in ARRIVALS.items():
        spark.sql(sql, documents=read_view(spark, sf_dir, "documents")).write.parquet(f"{root}/in/{drop}")
        arriving = spark.readStream.schema("document_id string, filename string, version bigint, text string").option("recursiveFileLookup", True).parquet(f"{root}/in")
        index.start(arriving, f"{root}/stream").awaitTermination()
    return index.chunks().select("document_id", "version", "chunk_no", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


QUERIES, ORACLE_SQL = R.queries, R.oracles
