"""Queries on the building graph: issues, listings, counts, hierarchy, lifecycle, anomaly features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.functions import text
from purlin.operators import graph as ops
from purlin.operators import issue_pass as passes
from purlin.operators.spatial import IGNORED_TYPE_PAIRS, ISSUES_SQL, clash_pairs, worst_issues
from purlin.plans import planner as plans
from purlin.plans.registry import Registry
from purlin.sources import graph_csv as csv
from purlin.sources.views import read_view, run_sql

R = Registry()
EDGE_TYPES = ["AGGREGATES", "CONTAINS", "BOUNDS", "PORT_OF"]


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clash_pairs(read_view(spark, sf_dir, "elements"))


WITH_ISSUES = {"frames": {"issues": issues}, "more": {"issues": ISSUES_SQL}}

R.sql("clash_pairs_classified", "select a_id, b_id, cross_file, issue, metric from {issues}", **WITH_ISSUES)
R.sql("clash_issue_counts", "select issue as issue_type, count(*) as issue_count from {issues} group by issue", **WITH_ISSUES)
R.sql(
    "issue_run_summary",
    """select count(*) as detected, sum(case when issue = 'CLASH' then 1 else 0 end) as clashes, sum(case when cross_file then 1 else 0 end) as cross_file,
      (select count(*) from {elements}) as checked, (select count(distinct storey_name) from {elements}) as storeys from {issues}""".replace("sum(case", "cast(sum(case").replace("end)", "end) as bigint)"),
    **WITH_ISSUES,
)
ENDS = "{issues} r join {elements} a on r.a_id = a.id join {elements} b on r.b_id = b.id"


@R.operator(
    "issues_by_storey_either_end",
    f"select r.issue as issue_type, count(*) as issue_count from {ENDS} where a.storey_name = '2-HIGH' or b.storey_name = '2-HIGH' group by r.issue",
    issues=ISSUES_SQL,
)
def issues_by_storey_either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read_view(spark, sf_dir, "elements").withColumn("on_storey", F.coalesce(F.col("storey_name") == "2-HIGH", F.lit(False)))
    found = passes.issue_counts(marked, ["on_storey"]).where("a_on_storey or b_on_storey")
    return found.groupBy(F.col("issue").alias("issue_type")).agg(F.sum("n").alias("issue_count"))


@R.operator(
    "typed_clash_listing",
    f"""select r.issue as issue_type, r.metric, a.name as element_a_name, a.id as element_a_id, b.name as element_b_name, b.id as element_b_id from {ENDS}
      where (a.ifc_type = 'IfcBeam' and b.ifc_type = 'IfcColumn') or (a.ifc_type = 'IfcColumn' and b.ifc_type = 'IfcBeam')
      order by r.metric desc nulls first, a.id, b.id limit 50""",
    issues=ISSUES_SQL,
)
def typed_clash_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.typed_issues(read_view(spark, sf_dir, "elements"), "IfcBeam", "IfcColumn", 50)
    return found.select(F.col("issue").alias("issue_type"), "metric", *[F.col(f"{x}_{c}").alias(f"element_{x}_{c}") for x in "ab" for c in ("name", "id")])


LISTING = f"""select r.issue as issue_type, r.metric, a.id as element_a_id, coalesce(a.ifc_guid, a.id) as element_a_guid, a.ifc_type as element_a_type,
        a.storey_name as element_a_storey, b.id as element_b_id, coalesce(b.ifc_guid, b.id) as element_b_guid, b.ifc_type as element_b_type,
        b.storey_name as element_b_storey, coalesce(r.cross_file, a.source_file_id <> b.source_file_id, false) as is_cross_file,
        case when coalesce(r.cross_file, a.source_file_id <> b.source_file_id, false) then 'CROSS-FILE' else 'INTRA-FILE' end as relation_scope
      from {ENDS}
      where r.issue = 'CLASH' and (a.storey_name in ('1-URGENT', '2-HIGH') or b.storey_name in ('1-URGENT', '2-HIGH'))
        and (a.ifc_type in ('IfcBeam', 'IfcColumn', 'IfcFlowSegment') or b.ifc_type in ('IfcBeam', 'IfcColumn', 'IfcFlowSegment'))
        and a.project_id = 'P' and b.project_id = 'P' and a.source_file_id in ('F0', 'F1') and b.source_file_id in ('F0', 'F1')
      order by r.metric desc nulls first, a.id, b.id limit 1000"""


@R.operator("issue_listing_scoped", LISTING, issues=ISSUES_SQL)
def issue_listing_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.issue_listing(
        read_view(spark, sf_dir, "elements"), issue="CLASH", storeys=["1-URGENT", "2-HIGH"], types=["IfcBeam", "IfcColumn", "IfcFlowSegment"], project="P", files=["F0", "F1"], limit=1000
    )


@R.operator(
    "issue_text_search",
    f"""select r.issue as issue_type, r.metric, a.id as element_a_id, b.id as element_b_id from {ENDS}
      where r.cross_file and lower(concat_ws('\n', r.issue, cast(r.metric as string), a.id, coalesce(a.ifc_guid, a.id), a.name, a.ifc_type, a.storey_name, a.source_file_id, b.id, coalesce(b.ifc_guid, b.id), b.name, b.ifc_type, b.storey_name, b.source_file_id)) like '%ifcflow%'""",
    issues=ISSUES_SQL,
)
def issue_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are sought in each element's own fields: neither an issue's kind nor its metric holds them, and no field's end joins the next."""
    fields = F.concat_ws("\n", "id", F.coalesce("ifc_guid", "id"), "name", "ifc_type", "storey_name", "source_file_id")
    found = passes.issue_rows(read_view(spark, sf_dir, "elements").withColumn("told", F.lower(fields).like("%ifcflow%")), among="told", only_cross=True)
    return found.select(F.col("issue").alias("issue_type"), "metric", F.col("a_id").alias("element_a_id"), F.col("b_id").alias("element_b_id"))


R.sql(
    "exact_type_counts",
    """select coalesce(cast(sum(case when ifc_type = 'IfcBeam' then 1 else 0 end) as bigint), 0) as ifc_type_0_count,
      coalesce(cast(sum(case when ifc_type = 'IfcSlab' then 1 else 0 end) as bigint), 0) as ifc_type_1_count,
      coalesce(cast(sum(case when ifc_type = 'IfcStair' then 1 else 0 end) as bigint), 0) as ifc_type_2_count from {elements}""",
)
TAGGED = "(regexp_extract(e.name, ':([0-9]+)$', 1) = '100042' or e.name like '%100042%')"


@R.operator(
    "element_by_tag_clashes",
    f"""select e.name as source_name, o.name as other_name, o.ifc_type as other_type, u.issue, u.metric, e.id as element_a_id, o.id as element_b_id
      from (select a_id as here, b_id as there, issue, metric from {{issues}} union all select b_id, a_id, issue, metric from {{issues}} where a_id <> b_id) u
      join {{elements}} e on u.here = e.id join {{elements}} o on u.there = o.id where {TAGGED.replace("100042", "1000")} order by e.id, o.id, u.issue limit 50""",
    issues=ISSUES_SQL,
)
def element_by_tag_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_view(spark, sf_dir, "elements").alias("e")
    found = ops.issues_around(elements, plans.element_match("1000")).orderBy("e_id", "o_id", "issue").limit(50)
    return found.select(F.col("e_name").alias("source_name"), F.col("o_name").alias("other_name"), F.col("o_ifc_type").alias("other_type"), "issue", "metric", F.col("e_id").alias("element_a_id"), F.col("o_id").alias("element_b_id"))


R.sql("distinct_storeys_and_types", "select distinct 'storey' as kind, storey_name as value from {elements} where storey_name is not null union all select distinct 'type', ifc_type from {elements}")
R.sql("node_and_edge_counts", "select 'node' as kind, type as name, count(*) as n from {nodes} group by type union all select 'edge', rel_type, count(*) from {edges} group by rel_type")
R.sql(
    "dangling_edges",
    """select e.rel_type, count(*) as raw_edges, count(distinct concat(e.source_id, '>', e.target_id)) as distinct_edges,
      count(case when s.id is null or t.id is null then 1 end) as dangling,
      count(distinct case when s.id is not null and t.id is not null then concat(e.source_id, '>', e.target_id) end) as loaded
      from {edges} e left join {nodes} s on e.source_id = s.id left join {nodes} t on e.target_id = t.id group by e.rel_type""",
)


@R.operator(
    "hierarchy_closure",
    """, walk AS (select id as root, id, 0 as depth from {nodes} where type = 'IfcProject'
      union all select w.root, e.target_id, w.depth + 1 from walk w join {edges} e on w.id = e.source_id where e.rel_type in ('AGGREGATES', 'CONTAINS'))
      select root, depth, count(distinct id) as descendants from walk group by root, depth""",
)
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_view(spark, sf_dir, "edges").where(F.col("rel_type").isin("AGGREGATES", "CONTAINS"))
    roots = read_view(spark, sf_dir, "nodes").where("type = 'IfcProject'")
    return ops.closure(edges, roots).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("descendants"))


R.oracles["hierarchy_closure"] = R.oracles["hierarchy_closure"].replace("WITH ", "WITH RECURSIVE ", 1).replace(") , walk", "), walk")


def scene_key(storey: F.Column) -> F.Column:
    """First 12 hexadecimal digits of the name's SHA-256; ``unassigned`` for blank or missing names."""
    name = F.trim(storey)
    return F.when(F.coalesce(name, F.lit("")) == "", "unassigned").otherwise(F.substring(F.sha2(name.cast("binary"), 256), 1, 12))


@R.operator(
    "scene_scope_elements",
    """select id, case when coalesce(trim(storey_name), '') = '' then 'unassigned' else substr(sha256(trim(storey_name)), 1, 12) end as scene_key,
      min_x as view_min_x, min_z as view_min_y, -max_y as view_min_z, max_x as view_max_x, max_z as view_max_y, -min_y as view_max_z
      from {elements} where coalesce(trim(storey_name), '') = '' or trim(storey_name) = '5-LOW'""",
)
def scene_scope_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["unassigned", "5-LOW"]
    boxes = read_view(spark, sf_dir, "elements").withColumn("scene_key", scene_key(F.col("storey_name")))
    keys = [w if w == "unassigned" else spark.range(1).select(scene_key(F.lit(w))).first()[0] for w in wanted]
    c = F.col
    return boxes.where(c("scene_key").isin(keys)).select(
        "id", "scene_key", c("min_x").alias("view_min_x"), c("min_z").alias("view_min_y"), (-c("max_y")).alias("view_min_z"), c("max_x").alias("view_max_x"), c("max_z").alias("view_max_y"), (-c("min_y")).alias("view_max_z")
    )


R.sql("scene_manifest", "select storey_name, count(*) as element_count, count(min_x) as with_box, min(min_z) as floor_z, max(max_z) as top_z from {elements} group by storey_name")


@R.operator(
    "endpoint_harvest",
    f"""select guid, id, ifc_type, storey_name from (select *, row_number() over (partition by guid order by metric desc, a_key, side) as rn from (
        select coalesce(a.ifc_guid, a.id) as guid, a.id, a.ifc_type, a.storey_name, r.metric, concat(a.id, b.id) as a_key, 0 as side from {ENDS}
        union all select coalesce(b.ifc_guid, b.id), b.id, b.ifc_type, b.storey_name, r.metric, concat(a.id, b.id), 1 from {ENDS}) h) k where rn = 1""",
    issues=ISSUES_SQL,
)
def endpoint_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.worst_ends(read_view(spark, sf_dir, "elements"), ["ifc_type", "storey_name"])


R.sql("elements_by_guid", "select id, coalesce(ifc_guid, id) as guid, ifc_type, name, storey_name from {elements} where coalesce(ifc_guid, id) in (select concat('G', cast(o_custkey % 500 as string), '-', cast(o_orderkey % 97 as string), '-', cast(o_orderkey % 5 as string)) from {orders} where o_orderkey % 101 = 7) order by ifc_type, name, id limit 100")
R.sql("element_listing", "select id, ifc_type, name, storey_name from {elements} order by ifc_type, name, id limit 500")
R.sql(
    "federation_intersection",
    "select storey_name from {elements} where storey_name is not null group by storey_name having count(distinct source_file_id) = (select count(distinct source_file_id) from {elements})",
)
@R.operator(
    "scope_delete_survivors",
    f"""select 'element' as kind, count(*) as before_n, count(case when source_file_id = 'F1' then 1 end) as deleted_n, count(case when source_file_id <> 'F1' then 1 end) as kept_n from {{elements}}
      union all select 'issue', count(*), count(case when a.source_file_id = 'F1' or b.source_file_id = 'F1' then 1 end),
        count(case when a.source_file_id <> 'F1' and b.source_file_id <> 'F1' then 1 end) from {ENDS}""",
    issues=ISSUES_SQL,
)
def scope_delete_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_view(spark, sf_dir, "elements")
    gone = elements.select(F.lit("element").alias("kind"), F.lit(1).cast("long").alias("n"), (F.col("source_file_id") == "F1").alias("a"), F.lit(None).cast("boolean").alias("b"), (F.col("source_file_id") != "F1").alias("kept"))
    a, b = (F.col(f"{x}_source_file_id") for x in "ab")
    cut = passes.issue_counts(elements, ["source_file_id"]).select(F.lit("issue").alias("kind"), "n", (a == "F1").alias("a"), (b == "F1").alias("b"), ((a != "F1") & (b != "F1")).alias("kept"))
    rows = gone.unionByName(cut).unionByName(spark.sql("select kind, 0L as n, false as a, false as b, false as kept from values ('element'), ('issue') v(kind)"))  # a row for empty tables too
    of = lambda when, name: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return rows.groupBy("kind").agg(F.sum("n").alias("before_n"), of(F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False)), "deleted_n"), of(F.col("kept"), "kept_n"))


DEGREES = """select n.id, coalesce(d.out_degree, 0) as out_degree, coalesce(d.in_degree, 0) as in_degree,
    coalesce(d.out_aggregates, 0) as out_aggregates, coalesce(d.in_aggregates, 0) as in_aggregates, coalesce(d.out_contains, 0) as out_contains, coalesce(d.in_contains, 0) as in_contains,
    coalesce(d.out_bounds, 0) as out_bounds, coalesce(d.in_bounds, 0) as in_bounds, coalesce(d.out_port_of, 0) as out_port_of, coalesce(d.in_port_of, 0) as in_port_of,
    coalesce(k.neighbours, 0) as neighbours, floor(case when coalesce(k.neighbours, 0) > 0 then m.s / k.neighbours else 0.0 end * 1e4 + 0.5) / 1e4 as neighbour_mean_degree
  from {nodes} n left join (select id, """ + ", ".join(
    f"cast(sum(case when rel_type = '{t}' and o = {o} then 1 else 0 end) as bigint) as {n}_{t.lower()}" for t in EDGE_TYPES for o, n in ((1, "out"), (0, "in"))
) + """, cast(sum(o) as bigint) as out_degree, cast(sum(1 - o) as bigint) as in_degree from {ends} group by id) d on n.id = d.id
  left join (select id, count(*) as neighbours from {near} group by id) k on n.id = k.id
  left join (select p.id, cast(sum(q.c) as double) as s from {near} p join (select id, count(*) as c from {near} group by id) q on p.other = q.id group by p.id) m on n.id = m.id"""
ENDS_SQL = {
    "kept": "select e.* from {edges} e join {nodes} s on e.source_id = s.id join {nodes} t on e.target_id = t.id",
    "ends": "select source_id as id, target_id as other, rel_type, 1 as o from {kept} union all select target_id, source_id, rel_type, 0 from {kept}",
    "near": "select distinct id, other from {ends} where id <> other",
}


@R.operator("degree_features", DEGREES, **ENDS_SQL)
def degree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.degree_features(read_view(spark, sf_dir, "nodes"), read_view(spark, sf_dir, "edges"), EDGE_TYPES)


SCORED = """select id, out_degree, in_degree, neighbours,
      (out_degree - avg(out_degree) over ()) / case when stddev_pop(out_degree) over () < 1e-6 then 1.0 else stddev_pop(out_degree) over () end as z_out,
      (in_degree - avg(in_degree) over ()) / case when stddev_pop(in_degree) over () < 1e-6 then 1.0 else stddev_pop(in_degree) over () end as z_in,
      (neighbours - avg(neighbours) over ()) / case when stddev_pop(neighbours) over () < 1e-6 then 1.0 else stddev_pop(neighbours) over () end as z_near from {degrees}"""
R3 = "floor(({x}) * 1e3 + 0.5) / 1e3"


def standardised(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """z-scores by population moments; a spread under 1e-6 counts as 1. One row of moments is joined to all."""
    moments = frame.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    wide = frame.join(F.broadcast(moments))  # one row
    spread = lambda c: F.when(F.col(f"__s_{c}") < 1e-6, 1.0).otherwise(F.col(f"__s_{c}"))
    return wide.select(*frame.columns, *[((F.col(c) - F.col(f"__m_{c}")) / spread(c)).alias(z) for c, z in columns.items()])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = degree_features(spark, sf_dir).select("id", "out_degree", "in_degree", "neighbours").persist()  # read by the moments and the scores
    return standardised(kept, {"out_degree": "z_out", "in_degree": "z_in", "neighbours": "z_near"})


ML = {"degrees": DEGREES, **ENDS_SQL, "scored": SCORED}


@R.operator("feature_standardization", "select id, " + ", ".join(f"{R3.format(x=c)} as {c}" for c in ("z_out", "z_in", "z_near")) + " from {scored}", **ML)
def feature_standardization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", *[F.expr(R3.format(x=c)).alias(c) for c in ("z_out", "z_in", "z_near")])


SCORE = "abs(z_out) + abs(z_in) + abs(z_near)"


@R.operator(
    "anomaly_threshold",
    f"""select {R3.format(x="t.p99")} as threshold, {R3.format(x="t.mean_score")} as mean_score, count(case when s.score >= t.p99 - 1e-9 then 1 end) as anomalies, count(*) as nodes
      from (select id, {SCORE} as score from {{scored}}) s, (select quantile_cont({SCORE}, 0.99) as p99, avg({SCORE}) as mean_score from {{scored}}) t group by t.p99, t.mean_score""",
    **ML,
)
def anomaly_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments are exact and known before the scores, so a node's score has the same bits in each pass over them. No nodes, no row."""
    columns = {"out_degree": "z_out", "in_degree": "z_in", "neighbours": "z_near"}
    kept = ops.degree_counts(read_view(spark, sf_dir, "nodes"), read_view(spark, sf_dir, "edges")).select(*columns).persist()  # read by the moments, the quantile and the counts
    moments = ops.whole_moments(kept, list(columns))
    z = lambda c: (F.col(c) - F.lit(moments[c][0])) / F.lit(1.0 if moments[c][1] < 1e-6 else moments[c][1]) if moments else F.lit(0.0)
    scores = kept.select(*[z(c).alias(n) for c, n in columns.items()]).select(F.expr(SCORE).alias("score"))
    limit = F.lit(ops.quantile(scores, "score", 0.99)).cast("double")
    found = scores.agg(F.avg("score").alias("mean"), F.count_if(F.col("score") >= limit - 1e-9).alias("anomalies"), F.count(F.lit(1)).alias("nodes")).where("nodes > 0")
    return found.withColumn("p99", limit).select(F.expr(R3.format(x="p99")).alias("threshold"), F.expr(R3.format(x="mean")).alias("mean_score"), "anomalies", "nodes")


@R.operator(
    "clash_anomaly_enrichment",
    """select r.a_id, r.b_id, r.issue, greatest(a.score, b.score) as max_score, floor((coalesce(a.score, 0.0) + coalesce(b.score, 0.0)) /
        case when (case when a.score is null then 0 else 1 end + case when b.score is null then 0 else 1 end) = 0 then 1 else (case when a.score is null then 0 else 1 end + case when b.score is null then 0 else 1 end) end * 1e4 + 0.5) / 1e4 as mean_score,
        coalesce(a.score >= 30.0, false) or coalesce(b.score >= 30.0, false) as is_anomaly
      from {issues} r left join {scores} a on r.a_id = a.id left join {scores} b on r.b_id = b.id""",
    issues=ISSUES_SQL,
    scores="select id, ord % 64 / 2.0 as score from {elements} where ord % 4 <> 0",
)
def clash_anomaly_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are joined to the elements and travel with their boxes; issues themselves aren't joined."""
    elements = read_view(spark, sf_dir, "elements")
    scores = elements.where("ord % 4 <> 0").select("id", (F.col("ord") % 64 / 2.0).alias("score"))
    found = passes.issue_rows(elements.join(scores, "id", "left"), ["score"])
    a, b, zero = F.col("a_score"), F.col("b_score"), F.lit(0.0)
    n = F.greatest(a.isNotNull().cast("int") + b.isNotNull().cast("int"), F.lit(1))
    mean = F.floor((F.coalesce(a, zero) + F.coalesce(b, zero)) / n * 1e4 + 0.5) / 1e4
    return found.select("a_id", "b_id", "issue", F.greatest(a, b).alias("max_score"), mean.alias("mean_score"), (F.coalesce(a >= 30.0, F.lit(False)) | F.coalesce(b >= 30.0, F.lit(False))).alias("is_anomaly"))


# Stored tables and their lifecycle
R.sql(
    "project_models",
    "select project_id, source_file_id as file_id, min(source_file_id) as filename, count(*) as elements, count(min_x) as with_box from {elements} group by project_id, source_file_id",
)
NEW = "select id, concat(name, ' v2') as name, ifc_type, storey_name from {elements} where ord % 5 = 0 union all select concat(id, '-new'), name, ifc_type, storey_name from {elements} where ord % 50 = 0"
OLD = "select id, name, ifc_type, storey_name from {elements} where ord % 3 <> 0"


@R.operator("upsert_elements", "select coalesce(n.id, o.id) as id, coalesce(n.name, o.name) as name, case when n.id is null then o.ifc_type else n.ifc_type end as ifc_type, case when n.id is null then o.storey_name else n.storey_name end as storey_name from {old} o full outer join {new} n on o.id = n.id", old=OLD, new=NEW)
def upsert_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_view(spark, sf_dir, "elements")
    return csv.upserted(spark.sql(OLD, elements=elements), spark.sql(NEW, elements=elements), ["id"])


KEPT_EDGES = "select distinct e.source_id, e.target_id, e.rel_type from {edges} e join {nodes} s on e.source_id = s.id join {nodes} t on e.target_id = t.id"


@R.operator("load_counts", "select (select count(*) from {nodes}) as nodes, count(*) as edges_raw, (select count(*) from {kept}) as edges_loaded, count(*) - (select count(*) from {kept}) as edges_skipped from {edges}", kept=KEPT_EDGES)
def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.load_counts(read_view(spark, sf_dir, "nodes"), read_view(spark, sf_dir, "edges"))


@R.operator("typed_edges", KEPT_EDGES)
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attached(read_view(spark, sf_dir, "edges"), read_view(spark, sf_dir, "nodes")).select("source_id", "target_id", "rel_type").dropDuplicates()


@R.operator("spatial_hierarchy_edges", "select rel_type, count(*) as n from {kept} where rel_type in ('AGGREGATES', 'CONTAINS') group by rel_type", kept=KEPT_EDGES)
def spatial_hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_edges(spark, sf_dir).where("rel_type in ('AGGREGATES', 'CONTAINS')").groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


STORED = "select concat('e', cast(l_orderkey % 700 as string)) as a_id, concat('e', cast(l_partkey % 700 as string)) as b_id, concat('F', cast(l_orderkey % 3 as string)) as a_file, concat('F', cast(l_partkey % 3 as string)) as b_file, 'CLASH' as issue, l_quantity as metric, l_orderkey * 10 + l_linenumber as ord, l_extendedprice as tie from {lineitem}"
FRESH = "select a_id, b_id, a_file, b_file, 'CLEARANCE_VIOLATION' as issue, metric, ord, tie from {stored} where ord % 4 = 0 and a_file = 'F1' and b_file = 'F1'"
LAST = "select a_id, b_id, a_file, b_file, issue, metric from (select *, row_number() over (partition by a_id, b_id order by ord desc, tie desc, metric desc) as rn from {fresh}) x where rn = 1"


@R.operator(
    "replace_issue_scope",
    "select a_id, b_id, a_file, b_file, issue, metric from {stored} where not (a_file = 'F1' or b_file = 'F1') union all select * from {last}",
    stored=STORED, fresh=FRESH, last=LAST,
)
def replace_issue_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.sql(STORED, lineitem=read_view(spark, sf_dir, "lineitem"))
    fresh = spark.sql(FRESH, stored=stored)
    return csv.replace_issues(stored, fresh, ["F1"], [F.col("ord").desc(), F.col("tie").desc(), F.col("metric").desc()]).select("a_id", "b_id", "a_file", "b_file", "issue", "metric")


@R.operator(
    "write_element_scores",
    "select e.id, case when s.id is not null then s.score when e.ord % 2 = 0 then 0.5 end as anomaly_score, case when s.id is not null then s.score >= 30.0 else e.ord % 2 = 0 end as is_anomaly from {elements} e left join {scores} s on e.id = s.id",
    scores="select id, ord % 64 / 2.0 as score from {elements} where ord % 4 <> 0",
)
def write_element_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_view(spark, sf_dir, "elements").select("id", "ord", F.when(F.col("ord") % 2 == 0, 0.5).alias("anomaly_score"), (F.col("ord") % 2 == 0).alias("is_anomaly"))
    scores = elements.where("ord % 4 <> 0").select("id", (F.col("ord") % 64 / 2.0).alias("score"))
    return csv.with_scores(elements, scores.withColumn("flag", F.col("score") >= 30.0)).select("id", "anomaly_score", "is_anomaly")


RUN_FILES = "select o_orderkey as run_id, case cast(o_custkey % 4 as int) when 0 then split('F0', ',') when 1 then split('F0,F1', ',') when 2 then split('F2', ',') else split('F1,F2', ',') end as file_ids from {orders}"


@R.operator(
    "delete_file_scope_counts",
    """select 'elements' as kind, count(*) as n from {elements} where source_file_id = 'F1' union all select 'runs', count(*) from {orders} where o_custkey % 4 in (1, 3) union all select 'projects', 0
      union all select 'kept_elements', count(*) from {elements} where source_file_id <> 'F1' or source_file_id is null union all select 'kept_runs', count(*) from {orders} where o_custkey % 4 in (0, 2)
      union all select 'kept_issues', count(*) from {issues} r join {elements} a on r.a_id = a.id join {elements} b on r.b_id = b.id where a.source_file_id <> 'F1' and b.source_file_id <> 'F1'""",
    issues=ISSUES_SQL,
)
def delete_file_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.sql(RUN_FILES, orders=read_view(spark, sf_dir, "orders"))
    elements, kept_issues, kept_runs, counts = csv.delete_file_scope(read_view(spark, sf_dir, "elements"), issues(spark, sf_dir), runs, ["F1"])
    size = lambda frame, kind: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return counts.unionByName(size(elements, "kept_elements")).unionByName(size(kept_runs, "kept_runs")).unionByName(size(kept_issues, "kept_issues"))


R.sql("orphan_materials", "select distinct m.raw_name from {material_uses} m left join (select distinct u.raw_name from {material_uses} u where cast(u.element_id as bigint) % 3 <> 0) k on m.raw_name = k.raw_name where k.raw_name is null")
R.sql("carbon_graph_scan", "select id, ifc_type, name from {nodes_named} where ifc_type not in ('IfcProject', 'IfcSite', 'IfcBuilding', 'IfcBuildingStorey')", frames={"nodes_named": lambda spark, sf: read_view(spark, sf, "nodes").selectExpr("id", "type as ifc_type", "concat('n', id) as name")}, more={"nodes_named": "select id, type as ifc_type, concat('n', id) as name from {nodes}"})
R.sql("semantic_type_whitelist", "select type as ifc_type, count(*) as n, type in ('IfcWall', 'IfcSpace', 'IfcFlowTerminal') as kept from {nodes} group by type")
R.sql("containment_storeys", "select n.id, s.id as storey_id, s.type as storey_type from {nodes} n left join {edges} e on n.id = e.target_id and e.rel_type = 'CONTAINS' left join {nodes} s on e.source_id = s.id where n.type = 'IfcWall'")
R.sql("element_type_histogram", "select ifc_type, n, cast(row_number() over (order by n desc, ifc_type) as int) as place from (select ifc_type, count(*) as n from {elements} group by ifc_type) t")
R.sql("upload_summary", "select source_file_id, count(distinct storey_name) as storeys, count(distinct ifc_type) as types, count(*) as elements from {elements} group by source_file_id")
R.sql("missing_boxes", "select n.id from {nodes} n left join (select concat('O', cast(ord as string)) as id from {elements} where min_x is not null) b on n.id = b.id where n.type = 'IfcWall' and b.id is null")
R.sql("element_page", "select id, ifc_type, name, (select count(*) from {elements}) > 200 as truncated from (select id, ifc_type, name from {elements} order by ifc_type, name, id limit 200) t")
R.sql("anomaly_highlight", "select id, score from (select id, ord % 997 / 8e0 as score from {elements}) s where score >= 100.0 order by score desc, id limit 250")


@R.operator(
    "issue_highlight",
    f"select r.metric, a.id as element_a_id, coalesce(a.ifc_guid, a.id) as element_a_guid, b.id as element_b_id, coalesce(b.ifc_guid, b.id) as element_b_guid from {ENDS} order by r.metric desc nulls first, a.id, b.id limit 250",
    issues=ISSUES_SQL,
)
def issue_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = worst_issues(read_view(spark, sf_dir, "elements"), 250, ["ifc_guid"])
    return worst.select("metric", *[c for x in "ab" for c in (F.col(f"{x}_id").alias(f"element_{x}_id"), F.coalesce(f"{x}_ifc_guid", f"{x}_id").alias(f"element_{x}_guid"))])


@R.operator(
    "issue_client_sorts",
    f"select a_id, b_id, metric, worst, source_place from (select r.a_id, r.b_id, r.metric, cast(row_number() over (order by coalesce(r.metric, -1e308) desc, r.a_id, r.b_id) as int) as worst, cast(row_number() over (order by a.source_file_id, b.source_file_id, r.a_id, r.b_id) as int) as source_place from {ENDS}) s where worst <= 300 or source_place <= 300",
    issues=ISSUES_SQL,
)
def issue_client_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 of both orders, worst first and by file: what stands before each of them is counted in one pass over all issues."""
    elements = read_view(spark, sf_dir, "elements")
    worst = worst_issues(elements, 300, ["source_file_id"]).select("a_id", "b_id", "metric", F.col("a_source_file_id").alias("file_a"), F.col("b_source_file_id").alias("file_b"))
    rows = [tuple(r) for r in worst.union(passes.first_by_source(elements, 300).select(worst.columns)).distinct().collect()]  # 600 at most
    places = passes.issue_places(elements, rows) if rows else {"metric": [], "source": []}
    found = [(*r[:3], w, p) for r, w, p in zip(rows, places["metric"], places["source"])]
    return spark.createDataFrame(found, "a_id string, b_id string, metric double, worst int, source_place int")


@R.operator("issues_by_type_filter", "select issue as issue_type, a_id, b_id, metric from {issues} where issue = 'CLEARANCE_VIOLATION' order by metric desc nulls first, a_id, b_id limit 500", issues=ISSUES_SQL)
def issues_by_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passes.first_issues(read_view(spark, sf_dir, "elements"), 500, issue="CLEARANCE_VIOLATION")
    return found.select(F.col("issue").alias("issue_type"), "a_id", "b_id", "metric")


@R.operator("run_summary_by_type", f"select a.ifc_type as type_a, b.ifc_type as type_b, r.issue, count(*) as n, cast(sum(case when r.cross_file then 1 else 0 end) as bigint) as cross_file from {ENDS} group by a.ifc_type, b.ifc_type, r.issue", issues=ISSUES_SQL)
def run_summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passes.issue_counts(read_view(spark, sf_dir, "elements"), ["ifc_type"])
    kinds = found.groupBy(F.col("a_ifc_type").alias("type_a"), F.col("b_ifc_type").alias("type_b"), "issue")
    return kinds.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("cross_file"), F.col("n")).otherwise(0)).alias("cross_file"))


R.sql("ignored_type_pairs", "select a.ifc_type as type_a, b.ifc_type as type_b from (select distinct ifc_type from {elements}) a, (select distinct ifc_type from {elements}) b where concat(least(a.ifc_type, b.ifc_type), '|', greatest(a.ifc_type, b.ifc_type)) in (" + ", ".join("'" + "|".join(sorted(p)) + "'" for p in IGNORED_TYPE_PAIRS) + ")")

# Questions answered by a plan
QUESTIONS = {
    "does IfcWall 101000 clash with any doors": "element_clashes",
    "which elements are clashing with 101000": "element_clashes",
    "how many IfcWall elements exist": "wall_count",
    "how many CLASH issues on storey 2-HIGH": "issues_by_type_on_storey",
    "count CLASH by type": "issues_by_type",
    "list CLASH pairs between IfcBeam and IfcColumn": "typed_clashes_with_listing",
    "how many IfcBeam and IfcSlab": "exact_ifc_type_counts",
    "how many elements have anomalyScore": "element_anomaly_property_counts",
}


@R.operator("question_plans", "select * from (values " + ", ".join(f"('{q}', '{i}')" for q, i in QUESTIONS.items()) + ") v(question, intent)")
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(q, plans.plan_question(q).intent) for q in QUESTIONS], "question string, intent string")


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    scored = read_view(spark, sf_dir, "elements").withColumns({"anomaly_score": F.when(F.col("ord") % 4 != 0, F.col("ord") % 997 / 8.0), "is_anomaly": F.col("ord") % 997 >= 900})
    elements = read_view(spark, sf_dir, "elements")
    return {"elements": scored, "issues": issues(spark, sf_dir), "typed_issues": lambda one, two, k: ops.typed_issues(elements, one, two, k), "issues_around": lambda match: ops.issues_around(elements.alias("e"), match)}


@R.operator(
    "question_element_clashes",
    f"""select e.name as source_name, o.name as other_name, o.ifc_type as other_type, u.issue, u.metric, e.id as element_a_id, o.id as element_b_id, coalesce(o.ifc_guid, o.id) as element_b_guid
      from (select a_id as here, b_id as there, issue, metric from {{issues}} union all select b_id, a_id, issue, metric from {{issues}} where a_id <> b_id) u
      join {{elements}} e on u.here = e.id join {{elements}} o on u.there = o.id where {TAGGED.replace("100042", "101000")} order by e.id, o.id, u.issue limit 50""",
    issues=ISSUES_SQL,
)
def question_element_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plans.validated(plans.plan_question("which elements are clashing with 101000"), _frames(spark, sf_dir))
    return found.select("source_name", "other_name", "other_type", "issue", "metric", "element_a_id", "element_b_id", "element_b_guid")


@R.operator("question_type_counts", "select cast(sum(case when ifc_type = 'IfcBeam' then 1 else 0 end) as bigint) as ifc_type_0_count, cast(sum(case when ifc_type = 'IfcSlab' then 1 else 0 end) as bigint) as ifc_type_1_count from {elements}")
def question_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.validated(plans.plan_question("how many IfcBeam and IfcSlab"), _frames(spark, sf_dir))


@R.operator("question_anomaly_counts", "select count(case when ord % 4 <> 0 then 1 end) as scored_count, count(case when ord % 997 >= 900 then 1 end) as anomaly_count from {elements}")
def question_anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.validated(plans.plan_question("how many elements have anomalyScore"), _frames(spark, sf_dir))


@R.operator("question_wall_count", "select count(*) as wall_count from {elements} where ifc_type = 'IfcWall'")
def question_wall_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.validated(plans.plan_question("how many IfcWall elements exist"), _frames(spark, sf_dir))


@R.operator(
    "question_typed_highlight",
    f"select a.id as element_a_id, b.id as element_b_id, a.storey_name as element_a_storey from {ENDS} where (a.ifc_type = 'IfcBeam' and b.ifc_type = 'IfcColumn') or (a.ifc_type = 'IfcColumn' and b.ifc_type = 'IfcBeam') order by r.metric desc nulls first, a.id, b.id limit 250",
    issues=ISSUES_SQL,
)
def question_typed_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.plan_question("list CLASH pairs between IfcBeam and IfcColumn").highlight(_frames(spark, sf_dir)).select("element_a_id", "element_b_id", "element_a_storey")


@R.operator(
    "answer_context_lines",
    "select cast(place as int) as place, concat('  ', cast(place as varchar), '. id=', id, ' | ifc_type=', ifc_type, ' | storey_name=', coalesce(storey_name, 'null')) as line from (select *, row_number() over (order by id) as place from {elements}) t where place <= 25",
)
def answer_context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.rendered(read_view(spark, sf_dir, "elements").select("id", "ifc_type", "storey_name"), [F.col("id")])


@R.operator("element_tags_and_guids", r"select id, nullif(regexp_extract(name, ':([0-9]+)$', 1), '') as tag, regexp_extract(id, '([^:]+)$', 1) as guid from {elements}")
def element_tags_and_guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_view(spark, sf_dir, "elements").select("id", text.tag_of(F.col("name")).alias("tag"), text.guid_of(F.col("id")).alias("guid"))


BOXES = """select id, (min_x + max_x) / 2 as center_x, (min_y + max_y) / 2 as center_y, (min_z + max_z) / 2 as center_z, max_x - min_x as extent_x, max_y - min_y as extent_y, max_z - min_z as extent_z,
    floor(ln(1 + (max_x - min_x) * (max_y - min_y) * (max_z - min_z)) * 1e6 + 0.5) / 1e6 as log_volume, 1.0e0 as has_bbox from {elements}"""


@R.operator("box_features", BOXES)
def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.box_features(read_view(spark, sf_dir, "elements"))
    return found.withColumn("log_volume", F.expr("floor(log_volume * 1e6 + 0.5) / 1e6"))


@R.operator(
    "one_hot_types",
    "select id, " + ", ".join(f"case when ifc_type = '{t}' then 1.0e0 else 0.0e0 end as type_{t}" for t in ("IfcBeam", "IfcColumn", "IfcDoor")) + ", case when ifc_type not in ('IfcBeam', 'IfcColumn', 'IfcDoor') then 1.0e0 else 0.0e0 end as type_UNKNOWN from {elements}",
)
def one_hot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = read_view(spark, sf_dir, "elements")
    return ops.one_hot(elements.select("id", "ifc_type"), "ifc_type", "type", ["IfcBeam", "IfcColumn", "IfcDoor"]).drop("ifc_type")


@R.operator(
    "score_ranking",
    "select id, score, cast(row_number() over (order by score desc, id) as bigint) as rank, score >= 120.0 as is_anomaly from (select id, ord % 997 / 8.0 as score from {elements}) s",
)
def score_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read_view(spark, sf_dir, "elements").select("id", (F.col("ord") % 997 / 8.0).alias("score"))
    return ops.ranked_scores(scores, 120.0).select("id", "score", "rank", "is_anomaly")


QUERIES, ORACLE_SQL = R.queries, R.oracles
