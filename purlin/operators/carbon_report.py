"""The report of a carbon run as sections. Assembly only: every figure comes from the run's results as they are."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purlin.operators import carbon as ops
from purlin.sources.reports import Section

# The report's fields, its dimensions, and what its data-quality figures are called, by state.
FIELDS = (
    "key", "value", "element_id", "ifc_guid", "ifc_type", "source_ifc_file", "discipline", "material", "quantity", "quantity_unit", "quantity_source",
    "factor_id", "factor", "factor_unit", "factor_source", "kgco2e", "assessment_status", "citation",
)
DIMENSIONS = {"material": "material_normalized", "ifc_type": "ifc_type", "discipline": "discipline", "source_ifc_file": "source_ifc_file"}
QUALITY = {
    "missing_material": "missing_material",
    "missing_quantity": "missing_quantity",
    "ambiguous_quantity": "ambiguous_quantity",
    "ambiguous_material_mapping": "ambiguous_mapping",
    "missing_carbon_factor": "unmatched_material",
    "unit_incompatibility": "incompatible_unit",
    "derived_or_estimated_quantity": "calculated_estimate",
}
FIGURES = (
    "calculated_carbon_kgco2e", "total_evaluated_elements", "elements_with_calculated_carbon", "elements_not_evaluated", "elements_with_explicit_quantities", "elements_with_estimated_quantities",
    "explicit_quantity_coverage_ratio", "estimated_quantity_coverage_ratio", "element_coverage_ratio", "unmatched_materials", "ambiguous_mappings",
)
TOP = 25


def _pairs(values: Mapping[str, Any], results: DataFrame) -> DataFrame:
    rows = [(i, k, None if v is None else str(v)) for i, (k, v) in enumerate(values.items())]
    return results.sparkSession.createDataFrame(rows, "place int, key string, value string")


def _turned(row: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(place, key, value) of one row's columns."""
    entries = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def report_sections(results: DataFrame, run: Mapping[str, Any], findings: DataFrame | None = None, limitations: tuple[str, ...] = ()) -> list[Section]:
    """The sections in the report's order. ``findings``: criterion, evidence, assessment_status, citation."""
    models = results.select(F.col("source_file_id").alias("key"), F.col("source_ifc_file").alias("value")).distinct() if "source_file_id" in results.columns else None
    columns = {name: c for name, c in DIMENSIONS.items() if c in results.columns}
    by = ops.breakdown(results, tuple(columns.values()))
    unit = ops.factor_quantity_type(F.col("factor_unit"))
    top = results.where("carbon_kgco2e is not null").orderBy(F.col("carbon_kgco2e").desc(), "element_id", "material_use_id").limit(TOP)
    top = top.select(
        *[c for c in ("element_id", "ifc_guid", "ifc_type", "source_ifc_file", "discipline") if c in results.columns],
        F.coalesce(F.nullif("material_raw", F.lit("")), "material_normalized").alias("material"),
        F.col("normalized_quantity").alias("quantity"),
        F.when(unit == "mass", "kg").when(unit == "volume", "m3").when(unit == "area", "m2").alias("quantity_unit"),
        "quantity_source",
        "factor_id",
        F.col("factor_value").alias("factor"),
        "factor_unit",
        F.col("carbon_kgco2e").alias("kgco2e"),
        F.monotonically_increasing_id().alias("place"),
    )
    cited = ops.citations(results).select(F.col("factor_id").alias("key"), "factor_id", F.col("factor_value").alias("factor"), "factor_unit")
    counts = results.groupBy().pivot("calculation_status", list(QUALITY.values())).count()
    quality = reduce(lambda f, kv: f.withColumnRenamed(kv[1], kv[0]), QUALITY.items(), counts).fillna(0)
    out = [Section("analysis", _pairs({"run_id": run.get("id"), **{k: v for k, v in run.items() if k not in ("id", "commit")}}, results), ["place"], ["key", "value"])]
    if models is not None:
        out.append(Section("selected_ifc_model", models, ["key", "value"]))
    out.append(Section("summary", _turned(ops.summary(results), FIGURES), ["place"], ["key", "value"]))
    out += [Section(f"breakdown:{name}", by.where(F.col("dimension") == c).select("key", F.col("carbon_kgco2e").alias("value")), ["key"]) for name, c in columns.items()]
    out.append(Section("top_contributor", top, ["place"], [c for c in top.columns if c != "place"]))
    out.append(Section("carbon_factor", cited, ["key"]))
    out.append(Section("data_quality", _turned(quality, tuple(QUALITY)), ["place"], ["key", "value"]))
    if findings is not None:
        out.append(Section("leed_oriented_finding", findings.select(F.col("criterion").alias("key"), F.col("evidence").alias("value"), "assessment_status", "citation"), ["key", "value"]))
    out.append(Section("limitation", _pairs(dict(enumerate(limitations)), results).select("place", "value"), ["place"], ["value"]))
    return out
