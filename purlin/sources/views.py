"""Building-information views over the input tables, as SQL that Spark and other engines read alike.

``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from purlin.session import TABLES, table

VIEWS: dict[str, str] = {
    "elements": """
        select concat('P::F', cast(o_custkey % 3 as string), '::', cast(o_orderkey as string)) as id, o_orderkey as ord,
          concat('G', cast(o_custkey % 500 as string), '-', cast(o_orderkey % 97 as string), '-', cast(o_orderkey % 5 as string)) as ifc_guid,
          concat('F', cast(o_custkey % 3 as string)) as source_file_id, 'P' as project_id,
          case cast(o_orderkey % 8 as int) when 0 then 'IfcBeam' when 1 then 'IfcWallStandardCase' when 2 then 'IfcSlab' when 3 then 'IfcDoor'
            when 4 then 'IfcColumn' when 5 then 'IfcRailing' when 6 then 'IfcFlowSegment' else 'IfcCovering' end as ifc_type,
          concat('Basic:', o_orderstatus, ':', cast(100000 + o_orderkey as string)) as name,
          case when o_orderkey % 11 = 0 then null else o_orderpriority end as storey_name,
          cast(o_custkey % 500 as double) * 0.5 as min_x, cast(o_orderkey % 97 as double) * 0.75 as min_y, cast(o_orderkey % 5 as double) * 3.0 as min_z,
          cast(o_custkey % 500 as double) * 0.5 + 0.25 * (1 + o_orderkey % 7) as max_x,
          cast(o_orderkey % 97 as double) * 0.75 + 0.25 * (1 + o_custkey % 5) as max_y,
          cast(o_orderkey % 5 as double) * 3.0 + 0.25 * (1 + o_orderkey % 3) as max_z
        from {orders} where o_orderkey % 13 <> 0""",
    "nodes": """
        select concat('R', cast(r_regionkey as string)) as id, 'IfcProject' as type from {region}
        union all select concat('N', cast(n_nationkey as string)), 'IfcSite' from {nation}
        union all select concat('C', cast(c_custkey as string)), 'IfcBuildingStorey' from {customer}
        union all select concat('S', cast(s_suppkey as string)), 'IfcFlowTerminal' from {supplier}
        union all select concat('P', cast(p_partkey as string)), 'IfcSpace' from {part} where p_partkey % 10 <> 0
        union all select concat('O', cast(o_orderkey as string)), 'IfcWall' from {orders}""",
    "edges": """
        select concat('R', cast(n_regionkey as string)) as source_id, concat('N', cast(n_nationkey as string)) as target_id, 'AGGREGATES' as rel_type from {nation}
        union all select concat('N', cast(c_nationkey as string)), concat('C', cast(c_custkey as string)), 'AGGREGATES' from {customer}
        union all select concat('C', cast(o_custkey as string)), concat('O', cast(o_orderkey as string)), 'CONTAINS' from {orders}
        union all select concat('P', cast(l_partkey as string)), concat('O', cast(l_orderkey as string)), 'BOUNDS' from {lineitem}
        union all select concat('S', cast(l_suppkey as string)), concat('O', cast(l_orderkey as string)), 'PORT_OF' from {lineitem}""",
    "carbon_elements": """
        select cast(o_orderkey as string) as element_id, concat('G', cast(o_orderkey as string)) as ifc_guid,
          case cast(o_orderkey % 4 as int) when 0 then 'IfcWall' when 1 then 'IfcSlab' when 2 then 'IfcBeam' else 'IfcCovering' end as ifc_type,
          concat('Basic:', o_orderstatus, ':', cast(100000 + o_orderkey as string)) as element_name, o_orderpriority as storey_name,
          concat('P', cast(o_custkey % 4 as string)) as project_id, concat('F', cast(o_custkey % 3 as string)) as source_file_id,
          concat('model-', cast(o_custkey % 3 as string), '.ifc') as source_ifc_file,
          case cast(o_orderkey % 5 as int) when 0 then null when 1 then '' when 2 then 'structure' else 'architecture' end as discipline
        from {orders}""",
    "carbon_boxes": """
        select cast(o_orderkey as string) as element_id,
          case cast(o_orderkey % 4 as int) when 0 then 'IfcWall' when 1 then 'IfcSlab' when 2 then 'IfcBeam' else 'IfcCovering' end as ifc_type,
          0e0 as min_x, 0e0 as min_y, 0e0 as min_z, 0.25e0 * (1 + o_orderkey % 7) as max_x, 0.25e0 * (1 + o_custkey % 5) as max_y,
          0.25e0 * (o_orderkey % 3) as max_z from {orders}""",
    # two factors of some parts: by name, and by an alias
    "factors": """
        select concat('f', cast(p_partkey as string)) as factor_id, concat('M-', cast(p_partkey as string)) as material_id,
          concat(p_name, ' ', p_brand, ' ', cast(p_partkey as string)) as material_name, split('', ';') as aliases, p_size + 0.25e0 as factor_value,
          case cast(p_partkey % 3 as int) when 0 then 'kgCO2e/kg' when 1 then 'kgCO2e / m³' else 'kgCO2e/m^2' end as factor_unit,
          case when p_partkey % 2 = 0 then 'EU' else 'eu' end as region, 'v1' as dataset_version, p_partkey % 11 <> 0 as enabled
        from {part} where p_partkey % 7 <> 0
        union all select concat('g', cast(p_partkey as string)), concat('N-', cast(p_partkey as string)), concat('Alt ', cast(p_partkey as string)),
          split(concat(upper(p_name), '-', p_brand, '/', cast(p_partkey as string), ';spare ', cast(p_partkey as string)), ';'), p_size + 1.5e0,
          case cast(p_partkey % 4 as int) when 0 then 'kgCO2e/kg' when 1 then 'kgCO2e/m3' else 'kgCO2e/m2' end, 'EU', 'v1', true
        from {part} where p_partkey % 5 = 0""",
    "material_uses": """
        select concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string),
            cast(cast(l_quantity as int) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
          cast(l_orderkey as string) as element_id, case when l_linenumber % 2 = 0 then upper(named) else named end as raw_name,
          case when l_linestatus = 'F' then 'layer' else 'constituent' end as component_type,
          l_tax as layer_thickness_m, l_discount as fraction
        from {lineitem} join (select p_partkey, concat(p_name, '_', p_brand, '/', cast(p_partkey as string)) as named from {part}) p on l_partkey = p_partkey""",
    "quantities": """
        select concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string),
            cast(cast(l_quantity as int) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)) as id,
          cast(l_orderkey as string) as element_id,
          case l_returnflag when 'A' then 'mass' when 'N' then 'volume' else 'area' end as quantity_type,
          case when l_linestatus = 'F' then 'ifc_explicit' else 'geometry_derived' end as quantity_source,
          case when l_linenumber % 2 = 0 then 'occurrence' else 'type' end as association_level,
          case l_returnflag when 'A' then case cast(l_linenumber % 3 as int) when 0 then 'NetWeight' when 1 then 'weight' else 'GrossWeight' end
            when 'N' then case cast(l_linenumber % 3 as int) when 0 then 'NetVolume' when 1 then 'Volume' else 'GrossVolume' end
            else case cast(l_linenumber % 4 as int) when 0 then 'NetArea' when 1 then 'NetSideArea' when 2 then 'GSA BIM Area' else 'Other' end end as quantity_name,
          case when l_suppkey % 2 = 0 then 'Qto_A' else 'qto_b' end as quantity_set_name,
          case when l_suppkey % 17 = 0 then null else l_quantity end as normalized_value, case when l_suppkey % 13 = 0 then 'unknown unit' end as error
        from {lineitem}""",
    # sections: a clause number for every document, three levels deep, from its id
    "sections": """
        select doc_id, concat('9-', cast(doc_id % 7 as string), '-', cast(doc_id % 5 as string), case when doc_id % 2 = 0 then concat('-', cast(doc_id % 3 as string)) else '' end) as section_id,
          source as document_id, length(text) as n_text
        from {documents}""",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(n for _, n, _, _ in string.Formatter().parse(sql) if n))


def read_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view by name; columns a query doesn't use are never read."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(sql, **{n: read_view(spark, sf_dir, n) for n in names_in(sql)})


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over tables and views; ``frames`` give further names."""
    return spark.sql(sql, **{n: frames[n] if n in frames else read_view(spark, sf_dir, n) for n in names_in(sql)})


def plain_sql(sql: str, **more: str) -> str:
    """One statement for another engine: views, and ``more``, become common table expressions."""
    known = {**VIEWS, **more}
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in names_in(text):
            if n in known and n not in needed:
                visit(known[n])
                needed.append(n)

    visit(sql)
    flat = lambda text: text.format(**{n: n for n in names_in(text)})
    head = ", ".join(f"{n} AS ({flat(known[n])})" for n in needed)
    return (f"WITH {head} " if head else "") + flat(sql)
