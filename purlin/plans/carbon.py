"""Queries of the embodied-carbon calculation. The SQL is written from the rules, not from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.operators import carbon as ops
from purlin.operators import carbon_report
from purlin.operators.carbon_runs import RunStore
from purlin.plans.registry import Registry
from purlin.sources import reports
from purlin.sources.store import Scratch, scratch
from purlin.sources.views import read_view

R = Registry()
UNIT = "replace(replace(lower(regexp_replace(factor_unit, '\\s+', '', 'g')), '³', '3'), '^', '')"
TYPE_OF = f"case {UNIT} when 'kgco2e/kg' then 'mass' when 'kgco2e/m3' then 'volume' when 'kgco2e/m2' then 'area' end"
NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def _name_rank() -> str:
    of = lambda names: "case " + " ".join(f"when lower(quantity_name) = '{n.lower()}' then {i}" for i, n in enumerate(names)) + f" else {len(names) + 1} end"
    return "case quantity_type " + " ".join(f"when '{k}' then {of(names)}" for k, names in ops.NAME_ORDER.items()) + " end"


MORE = {
    "fkeys": f"select factor_id, factor_value, factor_unit, {TYPE_OF} as factor_type, {NORM.format(x='name')} as key from (select *, unnest(list_concat([material_id, material_name], aliases)) as name from {{factors}} where enabled) x where name <> ''",
    "cand": f"select distinct u.id, u.element_id, k.factor_id, k.factor_type from {{material_uses}} u join {{fkeys}} k on {NORM.format(x='u.raw_name')} = k.key",
    "valid": "select * from {quantities} where normalized_value is not null and coalesce(error, '') = ''",
    "have": "select distinct element_id, quantity_type from {valid}",
    "one": "select id, count(*) as n, min(factor_id) as factor_id from {cand} group by id",
    "two": "select c.id, count(*) as n, min(c.factor_id) as factor_id from {cand} c join {have} h on c.element_id = h.element_id and c.factor_type = h.quantity_type group by c.id",
    "status": """select m.id, m.element_id, m.raw_name, m.component_type, m.layer_thickness_m, m.fraction,
        case when o.n is null then 'unmatched' when o.n = 1 then 'matched' when a.element_id is null then 'ambiguous' when t.n is null then 'unmatched' when t.n = 1 then 'matched' else 'ambiguous' end as mapping_status,
        case when o.n = 1 then o.factor_id when t.n = 1 then t.factor_id end as factor_id
      from {material_uses} m left join {one} o on m.id = o.id left join {two} t on m.id = t.id left join (select distinct element_id from {have}) a on m.element_id = a.element_id""",
    "ranked": f"select *, case when quantity_source = 'ifc_explicit' then 0 when quantity_source = 'geometry_derived' then 1 else 9 end as r1, case when association_level = 'occurrence' then 0 when association_level = 'type' then 1 else 9 end as r2, {_name_rank()} as r3 from {{valid}}",
    "placed": """select *, rank() over (partition by element_id, quantity_type order by r1, r2, r3) as peer, row_number() over (partition by element_id, quantity_type order by r1, r2, r3, lower(quantity_set_name), id) as first from {ranked}""",
    "picked": """select element_id, quantity_type, case when count(distinct round(normalized_value, 12)) = 1 then 'selected' else 'ambiguous_quantity' end as pick_status,
        case when count(distinct round(normalized_value, 12)) = 1 then max(case when first = 1 then normalized_value end) end as value,
        case when count(distinct round(normalized_value, 12)) = 1 then max(case when first = 1 then quantity_source end) end as source,
        case when count(distinct round(normalized_value, 12)) = 1 then max(case when first = 1 then id end) end as quantity_id from {placed} where peer = 1 group by element_id, quantity_type""",
    "sums": """select element_id, count(*) as use_count, case when bool_and(component_type = 'layer' and layer_thickness_m > 0) then cast(sum(cast(layer_thickness_m as decimal(30,12))) as double) end as thick,
        case when bool_and(component_type = 'constituent' and fraction >= 0) and sum(cast(fraction as decimal(30,12))) > 0 then cast(sum(cast(fraction as decimal(30,12))) as double) end as parts from {material_uses} group by element_id""",
    "shares": "select m.id, s.use_count, m.layer_thickness_m / s.thick as layer_share, m.fraction / s.parts as constituent_share from {material_uses} m join {sums} s on m.element_id = s.element_id",
    "joined": f"""select e.element_id, e.ifc_type, e.project_id, e.source_ifc_file, e.discipline, t.id as material_use_id, t.raw_name, case when t.raw_name is not null then {NORM.format(x='t.raw_name')} end as material_normalized, t.mapping_status, t.factor_id, f.factor_value, p.pick_status, p.value, p.source,
        case when s.use_count = 1 then 1.0 when f.factor_type = 'volume' and s.thick is not null then t.layer_thickness_m / s.thick else t.fraction / s.parts end as share
      from {{carbon_elements}} e left join {{status}} t on e.element_id = t.element_id left join (select factor_id, factor_value, {TYPE_OF} as factor_type from {{factors}}) f on t.factor_id = f.factor_id
      left join {{sums}} s on e.element_id = s.element_id left join {{picked}} p on e.element_id = p.element_id and p.quantity_type = f.factor_type""",
    "stated": """select *, case when material_use_id is null then 'missing_material' when mapping_status = 'ambiguous' then 'ambiguous_mapping' when mapping_status = 'unmatched' then 'unmatched_material' when pick_status is null then 'missing_quantity'
        when pick_status = 'ambiguous_quantity' then 'ambiguous_quantity' when share is null then 'missing_quantity' when source = 'ifc_explicit' and share = 1.0 then 'calculated_explicit' else 'calculated_estimate' end as calculation_status from {joined}""",
    "results": "select *, raw_name as material_raw, case when calculation_status like 'calculated%' then value * share * factor_value end as carbon_kgco2e from {stated}",
}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.calculate(*(read_view(spark, sf_dir, v) for v in ("carbon_elements", "material_uses", "quantities", "factors")))


def R6(c: str, name: str | None = None) -> str:
    return f"floor({c} * 1e6 + 0.5) / 1e6 as {name or c}"


def R4(c: str, name: str | None = None) -> str:
    return f"floor({c} * 1e4 + 0.5) / 1e4 as {name or c}"


@R.operator("factor_match_status", "select id, mapping_status, factor_id from {status}", **MORE)
def factor_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.match_factors(*(read_view(spark, sf_dir, v) for v in ("material_uses", "factors", "quantities")))
    return found.select("id", "mapping_status", "factor_id")


@R.operator("quantity_ranked_pick", "select element_id, quantity_type, pick_status, value, source, quantity_id from {picked}", **MORE)
def quantity_ranked_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pick_quantities(read_view(spark, sf_dir, "quantities"))


SHARES = "id, use_count, " + ", ".join(R6(c) for c in ("layer_share", "constituent_share"))


@R.operator("material_allocation_share", f"select {SHARES} from {{shares}}", **MORE)
def material_allocation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.allocation_shares(read_view(spark, sf_dir, "material_uses")).selectExpr("id", "use_count", *[R6(c) for c in ("layer_share", "constituent_share")])


OF = {"frames": {"results": results}, "more": MORE}
ROW = f"element_id, coalesce(material_use_id, '') as material_use_id, coalesce(mapping_status, 'unmatched') as mapping_status, factor_id, calculation_status, {R6('carbon_kgco2e')}"
R.sql("carbon_results_status", f"select {ROW} from {{results}}", **OF)
R.sql("data_quality_counts", "select calculation_status, count(*) as n, count(distinct element_id) as elements from {results} group by calculation_status", **OF)
R.sql("carbon_status_filter", f"select {ROW} from {{results}} where calculation_status = 'ambiguous_quantity' and ifc_type = 'IfcBeam'", **OF)
SUMMARY = {
    "total_evaluated_elements": "count(distinct element_id)",
    "elements_with_calculated_carbon": "count(distinct case when carbon_kgco2e is not null then element_id end)",
    "elements_not_evaluated": "count(distinct element_id) - count(distinct case when carbon_kgco2e is not null then element_id end)",
    "elements_with_explicit_quantities": "count(distinct case when calculation_status = 'calculated_explicit' then element_id end)",
    "elements_with_estimated_quantities": "count(distinct case when calculation_status = 'calculated_estimate' then element_id end)",
    "elements_missing_material": "count(distinct case when calculation_status = 'missing_material' then element_id end)",
    "elements_missing_quantity": "count(distinct case when calculation_status in ('missing_quantity', 'ambiguous_quantity') then element_id end)",
    "unmatched_materials": "count(distinct case when calculation_status = 'unmatched_material' then raw_name end)",
    "ambiguous_mappings": "count(case when calculation_status = 'ambiguous_mapping' then 1 end)",
    "explicit_quantity_results": "count(case when calculation_status = 'calculated_explicit' then 1 end)",
    "estimated_quantity_results": "count(case when calculation_status = 'calculated_estimate' then 1 end)",
}
TOTALS = {
    "calculated_carbon_kgco2e": "carbon_kgco2e",
    "explicit_carbon_kgco2e": "case when calculation_status = 'calculated_explicit' then carbon_kgco2e end",
    "estimated_carbon_kgco2e": "case when calculation_status = 'calculated_estimate' then carbon_kgco2e end",
}
RATIOS = {
    "element_coverage_ratio": "elements_with_calculated_carbon",
    "explicit_quantity_coverage_ratio": "elements_with_explicit_quantities",
    "estimated_quantity_coverage_ratio": "elements_with_estimated_quantities",
}
SUM = "cast(coalesce(sum(cast({c} as decimal(38,12))), 0) as double)"


@R.operator(
    "carbon_summary",
    "select "
    + ", ".join(SUMMARY)
    + ", "
    + ", ".join(R4(c) for c in TOTALS)
    + ", "
    + ", ".join(R6(f"(cast({c} as double) / total_evaluated_elements)", n) for n, c in RATIOS.items())
    + " from (select "
    + ", ".join(f"{e} as {n}" for n, e in SUMMARY.items())
    + ", "
    + ", ".join(f"{SUM.format(c=e)} as {n}" for n, e in TOTALS.items())
    + " from {results}) s",
    **MORE,
)
def carbon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(results(spark, sf_dir)).selectExpr(*SUMMARY, *[R4(c) for c in TOTALS], *[R6(c) for c in RATIOS])


@R.operator(
    "material_rollup",
    f"""select coalesce(nullif(material_normalized, ''), 'missing') as material_normalized, coalesce(mapping_status, 'unmatched') as mapping_status, factor_id, count(distinct element_id) as element_count,
      coalesce(array_to_string(list_sort(list(distinct raw_name) filter (raw_name <> '')), '; '), '') as raw_names, {R4(SUM.format(c="carbon_kgco2e"), "carbon_kgco2e")} from {{results}} group by 1, 2, 3""",
    **MORE,
)
def material_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.materials(results(spark, sf_dir))
    return found.selectExpr("material_normalized", "mapping_status", "factor_id", "element_count", "array_join(raw_names, '; ') as raw_names", R4("carbon_kgco2e"))


ORDER = "order by coalesce(nullif(carbon_kgco2e, 0), -1) desc, element_id, material_use_id"
R.sql("top_contributors", f"select {ROW} from (select * from {{results}} where carbon_kgco2e is not null {ORDER} limit 25) t", **OF)


@R.operator("carbon_results_page", f"select {ROW} from (select * from {{results}} where ifc_type = 'IfcSlab' {ORDER} limit 50 offset 100) t", **MORE)
def carbon_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.listed(results(spark, sf_dir), ifc_type="IfcSlab", limit=50, offset=100).selectExpr(*[x.strip() for x in ("element_id", "coalesce(material_use_id, '') as material_use_id", "mapping_status", "factor_id", "calculation_status", R6("carbon_kgco2e"))])


BY = [
    f"""select '{k}' as dimension, coalesce(nullif(cast({k} as string), ''), 'unknown') as key, {SUM.format(c="carbon_kgco2e")} as carbon_kgco2e, count(*) as result_count, count(carbon_kgco2e) as calculated_results,
        count(distinct element_id) as element_count, count(distinct case when carbon_kgco2e is not null then element_id end) as calculated_element_count,
        concat_ws(',', {", ".join(f"case when count(case when calculation_status = '{s}' then 1 end) > 0 then concat('{s}=', cast(count(case when calculation_status = '{s}' then 1 end) as string)) end" for s in sorted(ops.STATUSES))}) as statuses
        from {{results}} group by 2"""
    for k in ops.DIMENSIONS
]
DIMENSION_ROW = ["dimension", "key", R4("carbon_kgco2e"), "result_count", "calculated_results", "element_count", "calculated_element_count"]


@R.operator("carbon_by_dimension", f"select {', '.join(DIMENSION_ROW)}, {R6('(cast(calculated_element_count as double) / element_count)', 'element_coverage_ratio')}, statuses from ({' union all '.join(BY)}) b", **MORE)
def carbon_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.breakdown(results(spark, sf_dir))
    statuses = F.array_join(F.transform(F.array_sort(F.map_entries("calculation_status_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumn("statuses", statuses).selectExpr(*DIMENSION_ROW, R6("element_coverage_ratio"), "statuses")


@R.operator(
    "carbon_top_slices",
    f"select dimension, key, {R4('carbon_kgco2e')}, place from (select *, cast(row_number() over (partition by dimension order by carbon_kgco2e desc, key) as int) as place from ({' union all '.join(b for k, b in zip(ops.DIMENSIONS, BY) if k in ('source_ifc_file', 'discipline', 'ifc_type', 'material_normalized'))}) b) t where place <= 15",
    **MORE,
)
def carbon_top_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.breakdown(results(spark, sf_dir), ["source_ifc_file", "discipline", "ifc_type", "material_normalized"])
    return spark.sql(f"select dimension, key, {R4('carbon_kgco2e')}, place from (select *, row_number() over (partition by dimension order by carbon_kgco2e desc, key) as place from {{b}}) t where place <= 15", b=found)


R.sql("factor_citations", "select distinct factor_id, factor_value from {results} where factor_id is not null", **OF)


@R.operator(
    "factor_repository_status",
    "select count(*) as factor_count, count(case when enabled then 1 end) as enabled_factor_count, array_to_string(list_sort(list(distinct dataset_version)), ',') as versions, array_to_string(list_sort(list(distinct region) filter (enabled)), ',') as enabled_regions, bool_or(enabled) as ready from {factors}",
)
def factor_repository_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.factor_status(read_view(spark, sf_dir, "factors")).selectExpr("factor_count", "enabled_factor_count", "array_join(dataset_versions, ',') as versions", "array_join(enabled_regions, ',') as enabled_regions", "ready")


R.sql("factor_listing", "select factor_id, material_name, region, dataset_version from {factors} where lower(region) = lower('Eu') and dataset_version = 'v1'")


@R.operator(
    "factor_row_validation",
    """select cast(p_partkey as bigint) as line, 'f' || cast(p_partkey % 1500 as varchar) as factor_id,
      case when p_partkey >= 1500 then 'missing or duplicate factor_id' when p_size % 10 = 0 or p_partkey % 9 = 0 then 'invalid value, unit or year' when p_partkey % 8 = 0 then 'missing provenance' end as fault
      from {part} where p_partkey >= 1500 or p_size % 10 = 0 or p_partkey % 9 = 0 or p_partkey % 8 = 0""",
)
def factor_row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_view(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as bigint) as line", "concat('f', cast(p_partkey % 1500 as string)) as factor_id", "concat('M', p_partkey) as material_id", "p_name as material_name", "concat(p_brand, '|', p_type) as aliases", "'c' as category",
        "case when p_size % 10 = 0 then '-1' else cast(p_size as string) end as factor_value", "case when p_partkey % 9 = 0 then 'kg/kg' else 'kgCO2e/kg' end as factor_unit", "case when p_partkey % 8 = 0 then ' ' else 'EU' end as region",
        "'s' as source", "'1' as source_version", "'2020' as year", "'v1' as dataset_version", "'' as notes", "'Yes' as enabled",
    )
    return ops.checked_factors(raw)[1]


KNOWN = "select distinct element_id, quantity_type from {sound} where normalized_value is not null and coalesce(error, '') = ''"
EVIDENCE = {
    "limits": "select element_id, max_x * max_y * max_z as volume, 2 * (max_x * max_y + max_x * max_z + max_y * max_z) as area from {carbon_boxes} where max_z > 0",
    "sound": "select q.id, q.element_id, q.quantity_type, q.quantity_source, q.normalized_value, case when l.element_id is not null and q.quantity_type in ('volume', 'area') and q.normalized_value > greatest(100 * case when q.quantity_type = 'volume' then l.volume else l.area end, 1e-12) then 'implausible for the element''s bounds' else q.error end as error from {explicit} q left join {limits} l on q.element_id = l.element_id",
    "explicit": "select * from {quantities} where quantity_source = 'ifc_explicit'",
    "known": KNOWN,
    "made": """select element_id, 'volume' as quantity_type, max_x * max_y * max_z as normalized_value from {carbon_boxes} where max_z > 0 and ifc_type in ('IfcWall', 'IfcSlab', 'IfcBeam')
      union all select element_id, 'area', greatest(max_x * max_y, max_x * max_z, max_y * max_z) from {carbon_boxes} where max_z > 0 and ifc_type in ('IfcWall', 'IfcSlab', 'IfcCovering')
      union all select element_id, 'length', greatest(max_x, max_y, max_z) from {carbon_boxes} where max_z > 0 and ifc_type = 'IfcBeam'""",
    "derived": "select m.* from {made} m left join {known} k on m.element_id = k.element_id and m.quantity_type = k.quantity_type where k.element_id is null",
    "every": "select element_id, quantity_type, quantity_source, normalized_value, error from {sound} union all select element_id, quantity_type, 'geometry_derived', normalized_value, null from {derived}",
    "evidence": "select * from {every} union all select element_id, 'unknown', 'unavailable', null, 'no supported quantity is available' from {carbon_boxes} where element_id not in (select element_id from {every})",
}


@R.operator("quantity_evidence", f"select element_id, quantity_type, quantity_source, {R6('normalized_value')}, error from {{evidence}}", **EVIDENCE)
def quantity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = read_view(spark, sf_dir, "quantities").where("quantity_source = 'ifc_explicit'")
    return ops.evidence(read_view(spark, sf_dir, "carbon_boxes"), explicit).selectExpr("element_id", "quantity_type", "quantity_source", R6("normalized_value"), "error")


@R.operator(
    "leed_evidence_state",
    """select doc_id, case when doc_id % 2 = 0 or doc_id % 3 = 0 then 'insufficient_evidence' when doc_id % 5 = 0 then 'not_automatically_evaluable' when doc_id % 7 < 3 then 'satisfied_from_available_evidence' else 'not_satisfied_from_available_evidence' end as status from {documents}""",
)
def leed_evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read_view(spark, sf_dir, "documents").select("doc_id", ops.leed_state(d % 2 != 0, d % 3 != 0, F.when(d % 5 != 0, d % 7 < 3)).alias("status"))


RUNS = "select o_orderkey as run_id, o_orderdate as created, concat('P', cast(o_custkey % 4 as string)) as project_id, case cast(o_custkey % 4 as int) when 0 then 'F0' when 1 then 'F0|F1' when 2 then 'F2|F0' else 'F1|F2' end as files from {orders}"


@R.operator("run_scope_keys", """select run_id, sha256('["' || project_id || '","' || array_to_string(list_sort(split(files, '|')), '","') || '"]') as scope_key from {runs}""", runs=RUNS)
def run_scope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.sql(RUNS, orders=read_view(spark, sf_dir, "orders"))
    return runs.select("run_id", ops.scope_key(F.col("project_id"), F.split("files", r"\|")).alias("scope_key"))


R.sql(
    "latest_run_lookup",
    """select run_id, project_id from (select run_id, project_id, row_number() over (partition by project_id, files order by created desc, run_id desc) as rn from {runs} where files = 'F0|F1') r where rn = 1""",
    frames={"runs": lambda spark, sf: spark.sql(RUNS, orders=read_view(spark, sf, "orders"))},
    more={"runs": RUNS},
)


def stored_run(spark: SparkSession, sf_dir: str) -> tuple[RunStore, dict]:
    """A store with a run over all elements, after a run that died before its commit; and what is current then."""
    elements, uses, quantities, factors = (read_view(spark, sf_dir, v) for v in ("carbon_elements", "material_uses", "quantities", "factors"))
    store = RunStore(spark, scratch(spark, "runs"))
    store.store.stage("results", "run-r0", results(spark, sf_dir).limit(0))
    run = {"id": "r1", "scope_key": "all", "project_id": "P", "file_ids": ["F2", "F0", "F1"], "factor_dataset_hash": "h1"}
    store.persist(run, elements, uses, quantities, results(spark, sf_dir), factors)
    return store, store.run("P", ["F0", "F1", "F2"])


LINKED = f"element_id, coalesce(material_use_id, '') as material_use_id, calculation_status, {R6('carbon_kgco2e')}"


@R.operator("carbon_run_roundtrip", f"select {LINKED}, material_use_id is not null as has_use, factor_id is not null as has_factor, calculation_status like 'calculated%' as has_quantity from {{results}}", **MORE)
def carbon_run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the current run as stored, and which links they have."""
    store, run = stored_run(spark, sf_dir)
    return store.table(run, "results").selectExpr("element_id", "coalesce(material_use_id, '') as material_use_id", "calculation_status", R6("carbon_kgco2e"), "for_material_use is not null as has_use", "uses_factor is not null as has_factor", "uses_quantity is not null as has_quantity")


@R.operator(
    "carbon_run_tables",
    f"""select 'factors' as stored, count(distinct factor_id) as n from {{results}} union all select 'material_uses', count(*) from {{material_uses}} where element_id in (select element_id from {{carbon_elements}})
      union all select 'materials', count(distinct {NORM.format(x='raw_name')}) from {{material_uses}} where element_id in (select element_id from {{carbon_elements}})
      union all select 'quantities', count(*) from {{quantities}} where element_id in (select element_id from {{carbon_elements}}) union all select 'results', count(*) from {{results}}""",
    **MORE,
)
def carbon_run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the current run."""
    store, run = stored_run(spark, sf_dir)
    counts = [store.table(run, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("stored"), "n") for t in ("factors", "material_uses", "materials", "quantities", "results")]
    return reduce(DataFrame.unionByName, counts)


def _dimension(name: str, c: str) -> str:
    return f"select 'breakdown:{name}' as section, coalesce(nullif({c}, ''), 'unknown') as key, {SUM.format(c='carbon_kgco2e')} as value from {{results}} group by 2"


@R.operator(
    "carbon_report_csv",
    f"""select section, key, {R4('value')} from (
        {" union all ".join(_dimension(n, c) for n, c in carbon_report.DIMENSIONS.items())}
        union all select 'data_quality', k, cast(count(r.element_id) as double) from (select unnest({list(carbon_report.QUALITY)}) as k, unnest({list(carbon_report.QUALITY.values())}) as s) q left join {{results}} r on r.calculation_status = q.s group by k
        union all select 'summary', 'total_evaluated_elements', cast(count(distinct element_id) as double) from {{results}}
        union all select 'top_contributor', element_id, carbon_kgco2e from (select element_id, carbon_kgco2e from {{results}} where carbon_kgco2e is not null order by carbon_kgco2e desc, element_id, material_use_id limit 25) t) x""",
    **MORE,
)
def carbon_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the report over all results, as they stand in its CSV file."""
    path = scratch(spark, "report")
    stored = Scratch(spark, "results").freeze(results(spark, sf_dir))  # as a run's results are; every section reads them
    reports.write_csv(carbon_report.report_sections(stored, {"id": "r1"}), path, carbon_report.FIELDS)
    fields = "section string, " + ", ".join(f"{c} string" for c in carbon_report.FIELDS)
    lines = spark.read.schema(fields).option("escape", '"').csv([f"{path}/{p}" for p in reports.parts_in_order(spark, path)])
    kept = lines.where("section like 'breakdown:%' or section in ('data_quality', 'top_contributor') or (section = 'summary' and key = 'total_evaluated_elements')")
    return kept.select("section", F.coalesce("key", "element_id").alias("key"), F.coalesce("value", "kgco2e").cast("double").alias("value")).selectExpr("section", "key", R4("value"))


QUERIES, ORACLE_SQL = R.queries, R.oracles
