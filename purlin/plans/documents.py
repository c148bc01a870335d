"""Queries on document text: chunks, links, blocks, catalogue, dedup, answer checks, conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from purlin.functions import text as fn
from purlin.plans.registry import Registry
from purlin.sources.views import read_view

R = Registry()
TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@R.operator(
    "chunk_fixed_window",
    f"""select doc_id, chunk_no, length(chunk) as n_chars, md5(chunk) as chunk_md5 from (
        select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as chunk_no, trim(substr(text, cast(i * 1000 + 1 as bigint), 1200), {TRIM}) as chunk from (
          select doc_id, text, unnest(range(0, cast(greatest(ceil((length(text) - 1200) / 1000.0), 0) as bigint) + 1)) as i from {{documents}} where length(text) > 0) s
        where trim(substr(text, cast(i * 1000 + 1 as bigint), 1200), {TRIM}) <> '') t""",
)
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_view(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.fixed_windows(F.col("text"), 1200, 200)).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", "chunk_no", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


R.sql(
    "chunk_links",
    """select doc_id, source as document_id, section_id, lag(doc_id) over (partition by document_id order by doc_id) as prev_id, lead(doc_id) over (partition by document_id order by doc_id) as next_id,
      lag(doc_id) over (partition by document_id, section_id order by doc_id) as section_prev_id, lead(doc_id) over (partition by document_id, section_id order by doc_id) as section_next_id,
      cast(row_number() over (partition by document_id order by doc_id) - 1 as bigint) as position from {sections} s""".replace("source as document_id", "document_id"),
)


@R.operator(
    "line_blocks",
    f"""select doc_id, count(distinct block) as blocks, cast(max(block_chars) as bigint) as longest from (
        select doc_id, block, sum(length(line)) + count(*) - 1 as block_chars from (
          select doc_id, pos, line, sum(case when line = '' or line similar to '[-•●▪] .*' or before = '' or before is null then 1 else 0 end) over (partition by doc_id order by pos) as block from (
            select doc_id, pos, line, lag(line) over (partition by doc_id order by pos) as before from (
              select doc_id, pos, trim(line, {TRIM}) as line from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from {{documents}}) a) b) c) d
        where line <> '' group by doc_id, block) e group by doc_id""",
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_view(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", fn.stripped(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag("line").over(w)
    starts = (F.col("line") == "") | F.col("line").rlike("^[-•●▪] ") | (before == "") | before.isNull()
    blocks = lines.withColumn("block", F.sum(starts.cast("int")).over(w)).where("line <> ''").groupBy("doc_id", "block").agg((F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("chars"))
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("chars").alias("longest"))


R.sql(
    "document_catalogue",
    """select source as document_id, count(*) as chunk_count, count(distinct lang) as languages, min(doc_id) as first_id, max(doc_id) as last_id, cast(sum(length(text)) as bigint) as total_chars, max(length(text)) as longest
      from {documents} group by source""".replace("max(length(text))", "cast(max(length(text)) as bigint)"),
)


@R.operator("content_hash_dedup", "select doc_id, sha256(text) as content_hash, row_number() over (partition by sha256(text) order by doc_id) = 1 as kept from {documents} where text <> ''")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read_view(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", (F.col("doc_id") == F.col("first_id")).alias("kept"))


@R.operator(
    "material_normalization",
    r"""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat(p_name, '_', p_type, '/', p_brand)), '[_/\\|:;,+#-]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) as normalized_name,
      case when lower(concat(p_name, ' ', p_type)) like '%steel%' then 'steel' else 'other' end as category from {part}""",
)
def material_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read_view(spark, sf_dir, "part").select("p_partkey", fn.normalise_material(F.concat("p_name", F.lit("_"), "p_type", F.lit("/"), "p_brand")).alias("normalized_name"))
    return named.withColumn("category", F.when(fn.material_category(F.col("normalized_name")) == "steel", "steel").otherwise("other"))


ANSWERS = """select doc_id, concat('See [', source, ' § 9-', cast(doc_id % 7 as string), '] and [', case when doc_id % 3 = 0 then 'other' else source end, ' § 9-', cast(doc_id % 5 as string), '].') as answer from {documents}"""


@R.operator(
    "citation_validation",
    """select c.doc_id, c.cited, s.document_id is not null as supported from (
        select distinct doc_id, substr(x, 2, length(x) - 2) as cited from (select doc_id, unnest(regexp_extract_all(answer, '\\[[^\\]]+ § [0-9-]+\\]')) as x from {answers}) a) c
      left join (select distinct document_id, concat(document_id, ' § ', '9-', cast(doc_id % 7 as string)) as pair from {sections}) s on c.cited = s.pair""",
    answers=ANSWERS,
)
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = spark.sql(ANSWERS, documents=read_view(spark, sf_dir, "documents"))
    cited = answers.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([^\]]+ § [0-9-]+)\]"), F.lit(1)))).alias("cited"))
    supported = read_view(spark, sf_dir, "sections").select(F.concat("document_id", F.lit(" § 9-"), (F.col("doc_id") % 7).cast("string")).alias("cited"), F.lit(True).alias("found")).distinct()
    return cited.join(supported, "cited", "left").select("doc_id", "cited", F.coalesce("found", F.lit(False)).alias("supported"))


@R.operator(
    "numeric_grounding",
    """select conv_id, turn, len(n) as numbers, len(list_filter(n, lambda x: not list_contains(e, x))) as unsupported from (
        select c.conv_id, c.turn, list_distinct(list_transform(regexp_extract_all(c.text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: cast(x as double))) as n,
          coalesce(p.e, []) as e from {conversations} c left join (
            select conv_id, turn + 1 as turn, list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: cast(x as double))) as e from {conversations}) p on c.conv_id = p.conv_id and c.turn = p.turn) s""",
)
def numeric_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_view(spark, sf_dir, "conversations").select("conv_id", "turn", fn.numbers_in(F.col("text")).alias("n"))
    evidence = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("n").alias("e"))
    both = turns.join(evidence, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", F.size("n").cast("bigint").alias("numbers"), F.size(F.array_except("n", F.coalesce("e", F.array().cast("array<double>")))).cast("bigint").alias("unsupported"))


RECENT, SUMMARY = 4, 400


@R.operator(
    "conversation_recent_window",
    f"""select conv_id, count(*) as messages, cast(count(case when rn <= {RECENT} then 1 end) as bigint) as recent, coalesce(right(string_agg(case when rn > {RECENT} then concat(role, ': ', text) end, chr(10) order by turn), {SUMMARY}), '') as summary
      from (select *, row_number() over (partition by conv_id order by turn desc) as rn from {{conversations}}) s group by conv_id""",
)
def conversation_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_windows(read_view(spark, sf_dir, "conversations"))


def recent_windows(turns: DataFrame) -> DataFrame:
    """(conv_id, messages, recent, summary): the summary is the end of the older turns' lines; a null role or text is empty, a
    null turn counts as older than others but stands last in the text. Turns of one number are ordered by their line."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = turns.select("conv_id", "turn", line.alias("line"))
    ranked = lines.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc_nulls_last(), F.col("line").desc())))
    # of the older turns only those that can reach the summary's last characters, the line break before them included, are collected
    newer = Window.partitionBy("conv_id").orderBy(F.col("turn").desc_nulls_first(), F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("after", F.coalesce(F.sum(F.when(F.col("rn") > RECENT, F.length("line") + 1)).over(newer), F.lit(0)))
    kept = F.when((F.col("rn") > RECENT) & (F.col("after") <= SUMMARY), F.struct(F.col("turn").isNull().alias("last"), "turn", F.col("line").alias("t")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["t"]), "\n")
    return ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count(F.when(F.col("rn") <= RECENT, 1)).alias("recent"), F.right(joined, F.lit(SUMMARY)).alias("summary"))


R.sql("conversation_eviction", "select conv_id, last_turn from (select conv_id, max(turn) as last_turn from {conversations} group by conv_id) s where last_turn >= 1 order by last_turn desc, conv_id limit 50")
R.sql(
    "label_quality_by_source",
    "select d.source, count(*) as labelled, count(case when l.quality = 1 then 1 end) as good, count(case when l.toxic = 1 then 1 end) as toxic from {documents} d join {labels} l on d.doc_id = l.doc_id group by d.source",
)

QUERIES, ORACLE_SQL = R.queries, R.oracles
