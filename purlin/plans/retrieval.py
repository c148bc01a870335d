"""Queries of hybrid retrieval. Searches ask with every vector whose id is divisible by 50, against all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.operators import retrieval as ops
from purlin.operators.graph import placed
from purlin.plans.registry import Registry
from purlin.sources.views import read_view, run_sql

R = Registry()
K = 10
RANKED = """select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select q.vec_id as query_id, v.vec_id, greatest(0.0, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[]))) as score
    from {embeddings} q, {embeddings} v where q.vec_id % 50 = 0) s) r where rank <= 10"""
R4 = "floor(({c}) * 1e4 + 0.5) / 1e4"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ops.dense_topk(vectors.where("vec_id % 50 = 0"), vectors, K)


OF = {"frames": {"ranked": ranked}, "more": {"ranked": RANKED}}
R.sql("dense_topk", f"select query_id, vec_id, {R4.format(c='score')} as score, rank from {{ranked}}", **OF)


@R.operator("rrf_fusion", f"select vec_id, {R4.format(c='max(score)')} as best, floor(sum(cast(1.0 / (60 + rank) as decimal(18,12))) * 1e6 + 0.5) / 1e6 as fused, count(distinct query_id) as query_hits from {{ranked}} group by vec_id", ranked=RANKED)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fuse(ranked(spark, sf_dir)).selectExpr("vec_id", f"{R4.format(c='best')} as best", "floor(fused * 1e6 + 0.5) / 1e6 as fused", "query_hits")


FIRST = """(select r.query_id, min(case when a.label = b.label and r.query_id <> r.vec_id then r.rank end) as first_rank, count(distinct b.label) as labels_seen
        from {ranked} r join {embeddings} a on r.query_id = a.vec_id join {embeddings} b on r.vec_id = b.vec_id group by r.query_id) m"""
R.sql(
    "retrieval_metrics",
    """select count(*) as queries, floor(avg(case when first_rank <= 1 then 1.0 else 0.0 end) * 1e4 + 0.5) / 1e4 as recall_1, floor(avg(case when first_rank <= 3 then 1.0 else 0.0 end) * 1e4 + 0.5) / 1e4 as recall_3,
      floor(avg(case when first_rank <= 5 then 1.0 else 0.0 end) * 1e4 + 0.5) / 1e4 as recall_5, floor(avg(case when first_rank <= 10 then 1.0 else 0.0 end) * 1e4 + 0.5) / 1e4 as recall_10,
      floor(avg(coalesce(cast(1 as double) / first_rank, 0.0)) * 1e4 + 0.5) / 1e4 as mrr, floor(avg(labels_seen / cast((select count(distinct label) from {embeddings}) as double)) * 1e4 + 0.5) / 1e4 as coverage from """
    + FIRST,
    **OF,
)
R.sql("first_relevant_rank", "select query_id, first_rank from " + FIRST, **OF)
GRAMS_SQL = {
    "texts": "select concat('d', cast(doc_id as varchar)) as id, text from {documents} where text is not null union all select concat('q', cast(item_id as varchar)), replace(lower(text), 'ß', 'ss') from {benchmark}",
    "words": r"select id, concat(' ', w, ' ') as w from (select id, unnest(regexp_split_to_array(lower(text), '\s+')) as w from {texts}) x where w <> ''",
    "cut": "select id, substr(w, cast(i as int), n) as gram from (select id, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) as i from (select id, w, unnest([3, 4, 5]) as n from {words}) a where n = 3 or length(w) > n - 1) b",
    "tf": "select id, gram, count(*) as tf from {cut} group by id, gram",
    "pool": "select count(*) as n from {documents} where text is not null",
    "df": "select gram, count(*) as df from {tf} where id like 'd%' group by gram",
    "base": "select t.id, sum(power(t.tf * (ln((2.0 + p.n) / (1 + f.df)) + 1), 2)) as base from {tf} t join {df} f on t.gram = f.gram, {pool} p where t.id like 'd%' group by t.id",
    "asked": "select t.id as qid, t.gram, t.tf as qtf, ln((2.0 + p.n) / (2 + coalesce(f.df, 0))) + 1 as qidf, ln((2.0 + p.n) / (1 + coalesce(f.df, 0))) + 1 as idf from {tf} t left join {df} f on t.gram = f.gram, {pool} p where t.id like 'q%'",
    "lengths": "select qid, sqrt(sum(power(qtf * qidf, 2))) as length from {asked} group by qid",
    "met": "select a.qid, t.id, sum(t.tf * a.qtf * a.qidf * a.qidf) as dot, sum(t.tf * t.tf * (a.qidf * a.qidf - a.idf * a.idf)) as more from {tf} t join {asked} a on t.gram = a.gram where t.id like 'd%' group by a.qid, t.id",
    "lexical": "select cast(substr(m.qid, 2) as bigint) as query_id, cast(substr(m.id, 2) as bigint) as id, floor(m.dot / (sqrt(b.base + m.more) * l.length) * 1e9 + 0.5) / 1e9 as score from {met} m join {base} b on m.id = b.id join {lengths} l on m.qid = l.qid",
    "best": "select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from {lexical}) x where rank <= 32",
}


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 best documents of each question."""
    pool = read_view(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return ops.tfidf_scores(read_view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), pool, 32)


R.sql("tfidf_char_scores", "select query_id, id, floor(score * 1e6 + 0.5) / 1e6 as score from {best}", frames={"best": lambda spark, sf: ops.best(lexical(spark, sf), 32)}, more=GRAMS_SQL)

# Chunks with vectors: a document a chunk, its number and section from where it stands, its title from its first line
CHUNKS = """select d.doc_id as id, concat(cast(d.doc_id % 20 as string), ' ', d.source) as document_id, '' as document_number, 'regulation' as domain,
    concat('9-', cast(d.doc_id % 7 as string), '-', cast(d.doc_id % 5 as string), case when d.doc_id % 2 = 0 then concat('-', cast(d.doc_id % 3 as string)) else '' end) as section_id,
    case when d.doc_id % 2 = 0 then concat('9-', cast(d.doc_id % 7 as string), '-', cast(d.doc_id % 5 as string)) else '' end as parent_section_id,
    substr(d.text, 1, 60) as title, d.text, case when d.doc_id % 41 = 0 then 'table' else 'text' end as chunk_kind, d.doc_id % 83 = 0 as is_toc, cast(d.doc_id as int) as page_number, cast(d.doc_id as int) as chunk_index,
    case when d.doc_id % 3 = 0 then '' else md5(d.text) end as content_hash, e.embedding
  from {documents} d join {embeddings} e on d.doc_id = e.vec_id where d.text is not null"""
QUESTIONS = "select item_id as query_id, concat('mabhas ', cast(item_id % 20 as string), ': ', text) as question from {benchmark}"


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, CHUNKS)


def retrieval_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """questions, chunks with links in their sections, vectors of the questions' variants, questions that ask for all."""
    linked = spark.sql(
        """select *, coalesce(cast(lag(id) over own as string), '') as previous_section_chunk_id, coalesce(cast(lead(id) over own as string), '') as next_section_chunk_id
           from {c} window own as (partition by document_id, section_id order by chunk_index)""",
        c=chunks_of(spark, sf_dir),
    )
    linked = linked.withColumn("id", F.col("id").cast("string"))
    questions = run_sql(spark, sf_dir, QUESTIONS)
    known = read_view(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = known.count()
    variants = questions.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant")).withColumn("vec_id", (F.col("query_id") * 7 + F.col("variant") * 3) % size)
    return questions, linked, variants.join(known, "vec_id").select("query_id", "variant", "embedding"), questions.where("query_id % 2 = 0").select("query_id")


@R.operator("retrieval_context", None)
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, linked, vectors, complete = retrieval_inputs(spark, sf_dir)
    return ops.retrieve(questions, linked, vectors, complete).withColumn("strongest_dense", F.expr(R4.format(c="strongest_dense")))


PARTS = """select query_id, id, score as lexical, ((id * 13 + query_id * 29) % 101) / 100e0 as dense, 0e0 as heading, case when id % 20 = query_id % 20 then 1e0 else 0e0 end as document, cast(1 + id % 3 as double) + 1e0 / (60 + rank) as agreement from {best}"""
SCALE = "case when x{c} - n{c} < 1e-9 then case when x{c} > 0 then 1e0 else 0e0 end else ({c} - n{c}) / (x{c} - n{c}) end"


@R.operator(
    "hybrid_rerank",
    f"""select query_id, id, floor((0.45 * {SCALE.format(c='dense')} + 0.25 * {SCALE.format(c='lexical')} + 0.20 * heading + 0.05 * document + 0.05 * {SCALE.format(c='agreement')}) * 1e6 + 0.5) / 1e6 as rerank_score
      from (select *, {', '.join(f"min({c}) over (partition by query_id) as n{c}, max({c}) over (partition by query_id) as x{c}" for c in ('dense', 'lexical', 'agreement'))} from {{parts}}) s""",
    parts=PARTS,
    **GRAMS_SQL,
)
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.sql(PARTS, best=ops.best(lexical(spark, sf_dir), 32))
    return parts.withColumn("s", ops.hybrid_score("query_id")).selectExpr("query_id", "id", "floor(s * 1e6 + 0.5) / 1e6 as rerank_score")


R.sql(
    "candidate_merge",
    f"""select coalesce(d.query_id, x.query_id) as query_id, coalesce(d.vec_id, x.id) as id, {R4.format(c='coalesce(d.score, 0e0)')} as dense, {R4.format(c='coalesce(x.score, 0e0)')} as lexical
      from {{ranked}} d full outer join (select vec_id * 50 as query_id, (vec_id * 17) % 500 as id, vec_id / 500e0 as score from {{embeddings}} where vec_id < 500) x on d.query_id = x.query_id and d.vec_id = x.id""",
    **OF,
)
WANTED = "select distinct document_id, section_id as wanted_id from {sections} union select document_id, '9-2' from {sections}"


@R.operator(
    "section_prefix_expand",
    "select w.document_id, w.wanted_id, count(*) as chunks, min(s.doc_id) as first_id, max(s.doc_id) as last_id from {wanted} w join {sections} s on w.document_id = s.document_id and (s.section_id = w.wanted_id or starts_with(s.section_id, concat(w.wanted_id, '-'))) group by w.document_id, w.wanted_id",
    wanted=WANTED,
)
def section_prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = read_view(spark, sf_dir, "sections")
    found = ops.expand_sections(spark.sql(WANTED, sections=sections), sections)
    return found.groupBy("document_id", "wanted_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


R.sql("section_members", "select a.document_id, a.section_id, a.doc_id, (select count(*) from {sections} b where b.document_id = a.document_id and b.section_id = a.section_id) as members from {sections} a")
R.sql(
    "section_parents",
    """select p.document_id, p.parent_id, p.children, p.largest from (select document_id, parent_id, count(distinct section_id) as children, max(n_text) as largest from (
        select document_id, section_id, n_text, regexp_replace(section_id, '-[0-9]+$', '') as parent_id from {sections}) s group by document_id, parent_id having count(distinct section_id) >= 2) p
      left join (select distinct document_id, section_id from {sections}) o on p.document_id = o.document_id and p.parent_id = o.section_id where o.section_id is null""",
)
R.sql("section_scores", "select document_id, section_id, max(n_text) as score, count(*) as members from {sections} group by document_id, section_id")
PLACED = "select doc_id, concat(source, '/', cast(doc_id % 16 as string)) as own, row_number() over (partition by concat(source, '/', cast(doc_id % 16 as string)) order by doc_id) as pos from {documents}"
LINKS = "select doc_id, lag(doc_id) over (partition by own order by doc_id) as prev_id, lead(doc_id) over (partition by own order by doc_id) as next_id from (select doc_id, concat(source, '/', cast(doc_id % 16 as string)) as own from {documents}) d"


@R.operator(
    "neighbor_expand",
    """select s.doc_id as seed, n.doc_id, cast(abs(n.pos - s.pos) as int) as depth, floor(power(0.88, abs(n.pos - s.pos)) * 1e4 + 0.5) / 1e4 as weight
      from {placed} s join {placed} n on s.own = n.own and abs(n.pos - s.pos) <= 2""",
    placed=PLACED,
)
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = run_sql(spark, sf_dir, LINKS)
    return ops.neighbours(chunks, chunks.select("doc_id"))


ITEMS = "select q.item_id as question, d.doc_id, length(d.text) as n_chars from {benchmark} q join {documents} d on d.doc_id % 40 = q.item_id % 40"


@R.operator(
    "context_packing",
    """, ranked AS (select question, doc_id, n_chars, row_number() over (partition by question order by n_chars desc, doc_id) as pos from items),
      walk AS (select question, cast(0 as bigint) as pos, cast(null as bigint) as doc_id, cast(0 as bigint) as used, false as taken from (select distinct question from ranked) s
        union all select w.question, r.pos, r.doc_id, case when w.used + r.n_chars + 120 <= 28000 then w.used + r.n_chars + 120 else w.used end, w.used + r.n_chars + 120 <= 28000 from walk w join ranked r on w.question = r.question and r.pos = w.pos + 1)
      select question, cast(pos as int) as position, doc_id, used as used_chars from walk where taken""",
    items=ITEMS,
)
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pack_context(run_sql(spark, sf_dir, ITEMS), 28000, 120, "question", [F.col("n_chars").desc(), F.col("doc_id")])


R.oracles["context_packing"] = "WITH RECURSIVE items AS (" + ITEMS.replace("{documents}", "documents").replace("{benchmark}", "benchmark") + ") " + R.oracles["context_packing"].strip()

# Lookup, filters and domains of the collection
R.sql("chunks_by_request_order", "select r.pos, d.doc_id, d.lang from (select vec_id * 3 % 1000 as doc_id, vec_id as pos from {embeddings} where label is not null) r join {documents} d on r.doc_id = d.doc_id")
R.sql("domain_scan", "select doc_id, case when lower(trim(source)) in ('src1', 'src2', 'src3') then lower(trim(source)) else 'regulation' end as domain from (select doc_id, source from {documents} order by doc_id limit 5000) d where case when lower(trim(source)) in ('src1', 'src2', 'src3') then lower(trim(source)) else 'regulation' end in ('regulation', 'src1')")
R.sql("toc_exclusion", "select count(*) as chunks, sum(case when is_toc then 1 else 0 end) as left_out from (select doc_id % 83 = 0 as is_toc from {documents}) d".replace("sum(case when is_toc then 1 else 0 end)", "cast(sum(case when is_toc then 1 else 0 end) as bigint)"))


@R.operator("document_order", "select doc_id, cast(row_number() over (order by source, n_chars, doc_id) as bigint) as place from {documents}")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_view(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return placed(rows, [F.col("source"), F.col("n_chars"), F.col("doc_id")], "place").select("doc_id", "place")


QUERIES, ORACLE_SQL = R.queries, R.oracles
