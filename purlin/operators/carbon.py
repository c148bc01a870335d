"""Embodied carbon: factors, their match with material names, quantity choice, allocation, states and summaries.

Tables: ``elements`` (element_id, ifc_type, project_id, source_file_id, source_ifc_file, discipline, ...), ``uses`` of materials
(id, element_id, raw_name, component_type, layer_thickness_m, fraction, and normalized_name if known), ``quantities``
(id, element_id, quantity_type, quantity_source, association_level, quantity_name, quantity_set_name, normalized_value, error)
and ``factors`` (see ``FACTOR_FIELDS``; aliases as an array).

An element's quantities shrink to one row in one aggregation, and so do a name's factors: at most one finding for each
dimension. What remains are equi-joins by name and by element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purlin.functions.text import normalise_material

# The dimension of each factor unit, and the order in which quantity names are preferred.
FACTOR_UNIT_TYPE = {
    "kgco2e/kg": "mass",
    "kgco₂e/kg": "mass",
    "kgco2e/m3": "volume",
    "kgco₂e/m3": "volume",
    "kgco2e/m^3": "volume",
    "kgco2e/m2": "area",
    "kgco₂e/m2": "area",
    "kgco2e/m^2": "area",
}
NAME_ORDER = {
    "mass": ("NetWeight", "Weight", "GrossWeight"),
    "volume": ("NetVolume", "Volume", "GrossVolume"),
    "area": ("NetArea", "Area", "NetSurfaceArea", "NetSideArea", "GrossArea", "GrossSurfaceArea", "GrossFootprintArea", "GSA BIM Area"),
    "length": ("Length", "Height", "Width", "Depth", "Perimeter"),
}
SPATIAL_TYPES = ("IfcProject", "IfcSite", "IfcBuilding", "IfcBuildingStorey")
BOUND_TYPES = {
    "volume": ("IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcBeam", "IfcColumn"),
    "area": ("IfcWall", "IfcWallStandardCase", "IfcSlab", "IfcCovering", "IfcRoof"),
    "length": ("IfcBeam", "IfcColumn", "IfcFlowSegment"),
}
FACTOR_FIELDS = ("factor_id", "material_id", "material_name", "aliases", "category", "factor_value", "factor_unit", "region", "source", "source_version", "year", "dataset_version", "notes", "enabled")
CANONICAL = {"mass": "kg", "volume": "m3", "area": "m2", "length": "m"}
STATUSES = ("missing_material", "ambiguous_mapping", "unmatched_material", "missing_quantity", "ambiguous_quantity", "incompatible_unit", "calculated_explicit", "calculated_estimate")
DIMENSIONS = ("project_id", "source_ifc_file", "discipline", "ifc_type", "material_normalized", "element_id")
KINDS = ("mass", "volume", "area")  # of factors


def factor_quantity_type(unit: Column) -> Column:
    """Dimension of a factor's unit; null if it isn't known."""
    plain = F.lower(F.translate(F.regexp_replace(unit, r"\s+", ""), "³²", "32"))
    out = F.lit(None).cast("string")
    for text, kind in FACTOR_UNIT_TYPE.items():
        out = F.when(plain == text, kind).otherwise(out)
    return out


def checked_factors(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factors, faults) of a table of texts with FACTOR_FIELDS and ``line``; blank rows don't count.

    A fault is a missing or repeated id, a value that is no finite number of at least zero, an unknown unit, a year that
    is no number, or missing provenance. ``load_factors`` refuses a table with any.
    """
    trimmed = raw.select("line", *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in FACTOR_FIELDS])
    trimmed = trimmed.where(F.concat(*FACTOR_FIELDS) != "")
    value = F.expr("try_cast(factor_value as double)")
    kind = factor_quantity_type(F.col("factor_unit"))
    first = trimmed.groupBy("factor_id").agg(F.min("line").alias("__first"))
    rows = trimmed.join(first, "factor_id")
    numbers = value.isNull() | F.isnan(value) | (value < 0) | (value == F.lit(float("inf"))) | kind.isNull() | ((F.col("year") != "") & F.expr("try_cast(year as int)").isNull())
    lacking = F.lit(False)
    for c in ("material_id", "material_name", "category", "region", "source", "source_version", "dataset_version"):
        lacking = lacking | (F.col(c) == "")
    fault = F.when((F.col("factor_id") == "") | (F.col("line") != F.col("__first")), "missing or duplicate factor_id").when(numbers, "invalid value, unit or year").when(lacking, "missing provenance")
    rows = rows.withColumns({"fault": fault, "value": value, "quantity_type": kind})
    aliases = F.filter(F.transform(F.split("aliases", r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    fine = rows.where("fault is null").select(
        "factor_id", "material_id", "material_name", aliases.alias("aliases"), "category", F.col("value").alias("factor_value"), "factor_unit", "quantity_type", "region", "source", "source_version",
        F.expr("try_cast(nullif(year, '') as int)").alias("year"), "dataset_version", "notes", F.lower("enabled").isin("1", "true", "yes", "enabled").alias("enabled"),
    )
    return fine, rows.where("fault is not null").select("line", "factor_id", "fault")


def factor_status(factors: DataFrame) -> DataFrame:
    """One row: counts, and the distinct versions and regions of enabled factors, sorted."""
    on = lambda c: F.sort_array(F.collect_set(F.when(F.col("enabled"), F.col(c))))
    return factors.agg(
        F.count(F.lit(1)).alias("factor_count"), F.count(F.when(F.col("enabled"), 1)).alias("enabled_factor_count"), F.sort_array(F.collect_set("dataset_version")).alias("dataset_versions"),
        on("dataset_version").alias("enabled_dataset_versions"), on("region").alias("enabled_regions"), F.coalesce(F.bool_or("enabled"), F.lit(False)).alias("ready"),
    )


def chosen(available: list[str], wanted: str | None, what: str, fold: bool = False) -> str | None:
    """The version or region to use: the wanted one, the only one, None where there is none; several are an error."""
    if wanted:
        found = [a for a in available if a == wanted or (fold and a.casefold() == wanted.casefold())]
        if not found:
            raise LookupError(f"factor_{what}_unavailable: {wanted}")
        return found[0]
    if len(available) > 1:
        raise LookupError(f"factor_{what}_required: {', '.join(available)}")
    return available[0] if available else None


def factor_index(factors: DataFrame, region: str | None = None, dataset_version: str | None = None) -> DataFrame:
    """(key, n, f, and n_<kind>, f_<kind> for each dimension): how many factors go by a name, and the one where it is one.

    Names are a factor's material id, its name and its aliases, normalised. One row a name, whatever number of factors.
    """
    on = factors.where("enabled")
    if region:
        on = on.where(F.lower("region") == region.lower())
    if dataset_version:
        on = on.where(F.col("dataset_version") == dataset_version)
    kind = F.col("quantity_type") if "quantity_type" in factors.columns else factor_quantity_type(F.col("factor_unit"))
    extra = [c for c in ("region", "source", "source_version", "year", "dataset_version") if c in factors.columns]
    names = F.array_distinct(F.transform(F.concat(F.array("material_id", "material_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit(""))))
    factor = F.struct("factor_id", F.col("factor_value").cast("double").alias("factor_value"), "factor_unit", kind.alias("factor_type"), *extra)
    named = on.select(F.explode(names).alias("name"), factor.alias("f")).where("name <> ''")
    named = named.select(normalise_material(F.col("name")).alias("key"), "f").groupBy("key", "f.factor_id").agg(F.min("f").alias("f"))  # a factor counts once a name
    each = []
    for k in KINDS:
        own = F.col("f.factor_type") == k
        each += [F.count(F.when(own, 1)).alias(f"n_{k}"), F.min(F.when(own, F.col("f"))).alias(f"f_{k}")]
    return named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"), *each)


def picked_quantities(quantities: DataFrame) -> DataFrame:
    """(element_id, q_<dimension>, has): for each dimension the pick of an element's quantities, and which there are.

    A pick has status (selected or ambiguous_quantity) and the best-ranked quantity: explicit before derived, of the
    occurrence before of the type, then by name, set and id. If quantities of the best rank differ, none is selected.
    """
    q = quantities.where("normalized_value is not null and coalesce(error, '') = ''")
    source = F.when(F.col("quantity_source") == "ifc_explicit", 0).when(F.col("quantity_source") == "geometry_derived", 1).otherwise(9)
    level = F.when(F.col("association_level") == "occurrence", 0).when(F.col("association_level") == "type", 1).otherwise(9)
    out = []
    value = F.col("normalized_value").cast("double")
    for kind, names in NAME_ORDER.items():
        place = F.lit(len(names) + 1)
        for i, n in reversed(list(enumerate(names))):
            place = F.when(F.lower("quantity_name") == n.lower(), i).otherwise(place)
        rank = (source * 1000 + level * 100 + place).cast("int")
        own = F.col("quantity_type") == kind
        best = F.min(F.when(own, F.struct(rank.alias("rank"), F.lower("quantity_set_name").alias("set"), "id", value.alias("value"), F.col("quantity_source").alias("source"))))
        low = F.min(F.when(own, F.struct(rank.alias("rank"), F.round(value, 12).alias("v"))))
        high = F.max(F.when(own, F.struct((-rank).alias("rank"), F.round(value, 12).alias("v"))))
        agreed = low["v"] == high["v"]
        pick = F.struct(F.when(agreed, "selected").otherwise("ambiguous_quantity").alias("status"), F.when(agreed, best["value"]).alias("value"), F.when(agreed, best["source"]).alias("source"), F.when(agreed, best["id"]).alias("id"))
        out.append(F.when(low.isNotNull(), pick).alias(f"q_{kind}"))
    return q.groupBy("element_id").agg(*out)


def pick_quantities(quantities: DataFrame) -> DataFrame:
    """The same as rows: (element_id, quantity_type, pick_status, value, source, quantity_id)."""
    wide = picked_quantities(quantities)
    long = wide.select("element_id", F.explode(F.array(*[F.struct(F.lit(k).alias("quantity_type"), F.col(f"q_{k}").alias("q")) for k in NAME_ORDER])).alias("x"))
    return long.where("x.q is not null").select("element_id", "x.quantity_type", F.col("x.q.status").alias("pick_status"), F.col("x.q.value").alias("value"), F.col("x.q.source").alias("source"), F.col("x.q.id").alias("quantity_id"))


def element_materials(uses: DataFrame) -> DataFrame:
    """(element_id, use_count, thick, parts): the sums that shares are taken of; null where not all uses support them."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    layer = (F.col("component_type") == "layer") & finite("layer_thickness_m") & (F.col("layer_thickness_m") > 0)
    part = (F.col("component_type") == "constituent") & finite("fraction") & (F.col("fraction") >= 0)
    total = lambda c: F.sum(F.col(c).cast("decimal(30,12)")).cast("double")
    sums = uses.groupBy("element_id").agg(
        F.count(F.lit(1)).alias("use_count"), F.bool_and(F.coalesce(layer, F.lit(False))).alias("l"), F.bool_and(F.coalesce(part, F.lit(False))).alias("p"), total("layer_thickness_m").alias("t"), total("fraction").alias("f")
    )
    return sums.select("element_id", "use_count", F.when(F.col("l"), F.col("t")).alias("thick"), F.when(F.col("p") & (F.col("f") > 0), F.col("f")).alias("parts"))


def allocation_shares(uses: DataFrame) -> DataFrame:
    """``uses`` with layer_share, constituent_share and use_count of the element; a share is null where unsupported."""
    joined = uses.join(element_materials(uses), "element_id")
    return joined.withColumns({"layer_share": F.col("layer_thickness_m") / F.col("thick"), "constituent_share": F.col("fraction") / F.col("parts")}).drop("thick", "parts")


def _matched(rows: DataFrame) -> DataFrame:
    """mapping_status and the factor, of rows with an index's columns and picks ``q_...``.

    A name with several factors is tried again with those alone whose dimension the element has a quantity of.
    """
    have = [F.col(f"q_{k}").isNotNull() for k in KINDS]
    any_quantity = have[0] | have[1] | have[2] | F.col("q_length").isNotNull()
    again = sum((F.when(h, F.coalesce(f"n_{k}", F.lit(0))).otherwise(0) for k, h in zip(KINDS, have, strict=True)), F.lit(0))
    retry = (F.col("n") > 1) & any_quantity
    n = F.when(retry, again).otherwise(F.coalesce("n", F.lit(0)))
    second = F.coalesce(*[F.when(h & (F.col(f"n_{k}") == 1), F.col(f"f_{k}")) for k, h in zip(KINDS, have, strict=True)])
    status = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched")
    return rows.withColumns({"mapping_status": status, "factor": F.when(n == 1, F.when(retry, second).otherwise(F.col("f")))})


def keyed(uses: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("normalized_name", F.lit("")), F.col("raw_name")) if "normalized_name" in uses.columns else F.col("raw_name")
    return uses.withColumn("key", normalise_material(name))


def match_factors(uses: DataFrame, factors: DataFrame, quantities: DataFrame, region: str | None = None, dataset_version: str | None = None) -> DataFrame:
    """``uses`` with mapping_status and the factor's id, value, unit and type (null unless matched)."""
    rows = keyed(uses).join(factor_index(factors, region, dataset_version), "key", "left").join(picked_quantities(quantities), "element_id", "left")
    return _matched(rows).select(*uses.columns, "mapping_status", "factor.factor_id", "factor.factor_value", "factor.factor_unit", "factor.factor_type")


def calculate(elements: DataFrame, uses: DataFrame, quantities: DataFrame, factors: DataFrame, run_id: str = "run", region: str | None = None, dataset_version: str | None = None) -> DataFrame:
    """One row per element and material use (one without material where an element has none): mapping, state, share,
    quantity and carbon in kgCO2e, by the states' fixed order.

    Quantity times factor isn't rounded. Elements are looked at once; uses of unknown elements don't count.
    """
    named = keyed(uses).join(factor_index(factors, region, dataset_version), "key", "left").withColumnRenamed("id", "material_use_id")
    rows = elements.join(named, "element_id", "left").join(element_materials(uses), "element_id", "left").join(picked_quantities(quantities), "element_id", "left")
    rows = _matched(rows)
    kind = F.col("factor.factor_type")
    pick = F.coalesce(*[F.when(kind == k, F.col(f"q_{k}")) for k in NAME_ORDER])
    rows = rows.withColumns({"pick": pick, "factor_type": kind})
    layered = F.when(kind == "volume", F.col("layer_thickness_m") / F.col("thick"))
    share = F.when(F.col("use_count") == 1, 1.0).otherwise(F.coalesce(layered, F.col("fraction") / F.col("parts")))
    note = F.when(F.col("use_count") == 1, "whole_element_single_material").when(layered.isNotNull(), "layer_thickness_ratio").when(F.col("parts").isNotNull(), "authored_constituent_fraction").otherwise("unsupported_multi_material_allocation")
    rows = rows.withColumns({"share": share, "note": note})
    no_use = F.col("material_use_id").isNull()
    status = (
        F.when(no_use, "missing_material")
        .when(F.col("mapping_status") == "ambiguous", "ambiguous_mapping")
        .when(F.col("mapping_status") == "unmatched", "unmatched_material")
        .when(F.col("pick").isNull(), "missing_quantity")
        .when(F.col("pick.status") == "ambiguous_quantity", "ambiguous_quantity")
        .when(~F.coalesce(factor_quantity_type(F.col("factor.factor_unit")) == kind, F.lit(False)), "incompatible_unit")
        .when(F.col("share").isNull(), "missing_quantity")
        .when((F.col("pick.source") == "ifc_explicit") & (F.col("share") == 1.0), "calculated_explicit")
        .otherwise("calculated_estimate")
    )
    rows = rows.withColumn("calculation_status", status)
    done = F.col("calculation_status").like("calculated%")
    amount = F.when(done, F.col("pick.value") * F.col("share"))
    chosen_factor = [F.col(f"factor.{c}").alias(c) for c in ("factor_id", "factor_value", "factor_unit")]
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "element_id", F.coalesce("material_use_id", F.lit("missing"))), 256).alias("id"),
        F.lit(run_id).alias("run_id"),
        *[c for c in elements.columns],
        "material_use_id",
        F.col("raw_name").alias("material_raw"),
        F.col("key").alias("material_normalized"),
        F.when(no_use, "unmatched").otherwise(F.col("mapping_status")).alias("mapping_status"),
        *chosen_factor,
        F.when(done, F.col("factor_type")).alias("quantity_type"),
        F.when(done, F.col("pick.source")).otherwise("unavailable").alias("quantity_source"),
        F.when(done, F.col("pick.id")).alias("quantity_evidence_id"),
        F.when(done, F.col("share")).alias("allocation_share"),
        amount.alias("normalized_quantity"),
        (amount * F.col("factor.factor_value")).alias("carbon_kgco2e"),
        "calculation_status",
        F.when(done | (F.col("pick").isNotNull() & F.col("share").isNull()), F.col("note")).otherwise("").alias("calculation_note"),
    )


def total(value: Column | str) -> Column:
    """Sum of carbon that doesn't depend on the order of rows; 0 of nothing."""
    return F.coalesce(F.sum((F.col(value) if isinstance(value, str) else value).cast("decimal(38,12)")), F.lit(0)).cast("double")


def breakdown(results: DataFrame, keys: tuple[str, ...] | list[str] = DIMENSIONS) -> DataFrame:
    """Carbon, counts, coverage and a map of states by each of ``keys`` separately, in one pass of grouping sets.

    Missing keys are ``unknown``; missing carbon isn't zero but left out.
    """
    named = results.select(*[F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("unknown")).alias(f"k_{k}") for k in keys], F.col("element_id").alias("element"), "carbon_kgco2e", "calculation_status")
    have = F.col("carbon_kgco2e").isNotNull()
    grouped = named.groupingSets([[F.col(f"k_{k}")] for k in keys], *[F.col(f"k_{k}") for k in keys]).agg(
        total("carbon_kgco2e").alias("carbon_kgco2e"),
        F.count(F.lit(1)).alias("result_count"),
        F.count("carbon_kgco2e").alias("calculated_results"),
        F.count_distinct("element").alias("element_count"),
        F.count_distinct(F.when(have, F.col("element"))).alias("calculated_element_count"),
        *[F.count(F.when(F.col("calculation_status") == s, 1)).alias(f"s_{s}") for s in STATUSES],
        *[F.grouping(f"k_{k}").alias(f"__{k}") for k in keys],
    )
    dimension = F.coalesce(*[F.when(F.col(f"__{k}") == 0, F.lit(k)) for k in keys])
    key = F.coalesce(*[F.when(F.col(f"__{k}") == 0, F.col(f"k_{k}")) for k in keys])
    states = F.map_filter(F.create_map(*[x for s in sorted(STATUSES) for x in (F.lit(s), F.col(f"s_{s}"))]), lambda _, n: n > 0)
    return grouped.select(
        dimension.alias("dimension"), key.alias("key"), "carbon_kgco2e", "result_count", "calculated_results", "element_count", "calculated_element_count",
        (F.col("calculated_element_count") / F.col("element_count")).alias("element_coverage_ratio"), states.alias("calculation_status_counts"),
    )


def summary(results: DataFrame) -> DataFrame:
    """The run's scalar figures, one row."""
    status = F.col("calculation_status")
    elements_where = lambda c: F.count_distinct(F.when(c, F.col("element_id")))
    have = F.col("carbon_kgco2e").isNotNull()
    explicit, estimate = status == "calculated_explicit", status == "calculated_estimate"
    row = results.agg(
        F.count_distinct("element_id").alias("total_evaluated_elements"),
        elements_where(have).alias("elements_with_calculated_carbon"),
        elements_where(explicit).alias("elements_with_explicit_quantities"),
        elements_where(estimate).alias("elements_with_estimated_quantities"),
        elements_where(status == "missing_material").alias("elements_missing_material"),
        elements_where(status.isin("missing_quantity", "ambiguous_quantity")).alias("elements_missing_quantity"),
        F.count_distinct(F.when((status == "unmatched_material") & (F.col("material_raw") != ""), F.col("material_raw"))).alias("unmatched_materials"),
        F.count(F.when(status == "ambiguous_mapping", 1)).alias("ambiguous_mappings"),
        F.count(F.when(explicit, 1)).alias("explicit_quantity_results"),
        F.count(F.when(estimate, 1)).alias("estimated_quantity_results"),
        total("carbon_kgco2e").alias("calculated_carbon_kgco2e"),
        total(F.when(explicit, F.col("carbon_kgco2e"))).alias("explicit_carbon_kgco2e"),
        total(F.when(estimate, F.col("carbon_kgco2e"))).alias("estimated_carbon_kgco2e"),
    )
    ratio = lambda c: F.when(F.col("total_evaluated_elements") > 0, F.col(c) / F.col("total_evaluated_elements")).otherwise(0.0)
    return row.withColumns(
        {
            "elements_not_evaluated": F.col("total_evaluated_elements") - F.col("elements_with_calculated_carbon"),
            "element_coverage_ratio": ratio("elements_with_calculated_carbon"),
            "explicit_quantity_coverage_ratio": ratio("elements_with_explicit_quantities"),
            "estimated_quantity_coverage_ratio": ratio("elements_with_estimated_quantities"),
        }
    )


def materials(results: DataFrame) -> DataFrame:
    """By normalised name, mapping and factor: distinct elements, sorted distinct raw names, carbon."""
    name = F.coalesce(F.nullif("material_normalized", F.lit("")), F.lit("missing"))
    return results.groupBy(name.alias("material_normalized"), "mapping_status", "factor_id").agg(
        F.count_distinct("element_id").alias("element_count"), F.sort_array(F.collect_set(F.nullif("material_raw", F.lit("")))).alias("raw_names"), total("carbon_kgco2e").alias("carbon_kgco2e")
    )


def listed(results: DataFrame, status: str | None = None, ifc_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of results, most carbon first; missing carbon and zero come last, ties by element."""
    rows = results if status is None else results.where(F.col("calculation_status") == status)
    rows = rows if ifc_type is None else rows.where(F.col("ifc_type") == ifc_type)
    return rows.orderBy(F.coalesce(F.nullif("carbon_kgco2e", F.lit(0.0)), F.lit(-1.0)).desc(), "element_id", "material_use_id").offset(offset).limit(limit)


def citations(results: DataFrame) -> DataFrame:
    """The distinct factors of the results, by id."""
    return results.where("factor_id is not null").select("factor_id", "factor_value", "factor_unit").distinct()


def derived_quantities(boxes: DataFrame, explicit: DataFrame) -> DataFrame:
    """Envelope estimates (element_id, quantity_type, normalized_value, ...) for dimensions an element has no sound explicit
    quantity of, and whose type of element allows it. ``boxes``: element_id, ifc_type and the box's six columns."""
    d = {a: F.abs(F.col(f"max_{a}") - F.col(f"min_{a}")) for a in "xyz"}
    fine = (d["x"] > 0) & (d["y"] > 0) & (d["z"] > 0)
    ways = {
        "volume": (d["x"] * d["y"] * d["z"], "aabb_envelope_volume"),
        "area": (F.greatest(d["x"] * d["y"], d["x"] * d["z"], d["y"] * d["z"]), "aabb_max_face_area"),
        "length": (F.greatest(d["x"], d["y"], d["z"]), "aabb_max_extent"),
    }
    made = [F.when(F.col("ifc_type").isin(list(BOUND_TYPES[k])), F.struct(F.lit(k).alias("quantity_type"), v.alias("normalized_value"), F.lit(CANONICAL[k]).alias("normalized_unit"), F.lit(m).alias("derivation_method"))) for k, (v, m) in ways.items()]
    rows = boxes.where(fine).select("element_id", F.explode(F.array_compact(F.array(*made))).alias("q")).select("element_id", "q.*")
    known = explicit.where("normalized_value is not null and coalesce(error, '') = ''").select("element_id", "quantity_type").distinct()
    left = rows.join(known, ["element_id", "quantity_type"], "left_anti")
    return left.withColumns({"quantity_source": F.lit("geometry_derived"), "quality": F.lit("low"), "quantity_name": F.concat(F.lit("Derived "), "quantity_type"), "error": F.lit(None).cast("string")})


def implausible(boxes: DataFrame, explicit: DataFrame, times: float = 100.0) -> DataFrame:
    """``explicit`` with an error where a value exceeds ``times`` the envelope of its element's box."""
    d = {a: F.abs(F.col(f"max_{a}") - F.col(f"min_{a}")) for a in "xyz"}
    limits = boxes.where((d["x"] > 0) & (d["y"] > 0) & (d["z"] > 0)).select(
        "element_id", (d["x"] * d["y"] * d["z"]).alias("l_volume"), (2 * (d["x"] * d["y"] + d["x"] * d["z"] + d["y"] * d["z"])).alias("l_area"), (4 * (d["x"] + d["y"] + d["z"])).alias("l_length")
    )
    limit = F.coalesce(*[F.when(F.col("quantity_type") == k, F.col(f"l_{k}")) for k in ("volume", "area", "length")])
    far = F.coalesce(F.col("normalized_value") > F.greatest(limit * times, F.lit(1e-12)), F.lit(False))
    rows = explicit.join(limits, "element_id", "left")
    return rows.withColumn("error", F.when(far & limit.isNotNull(), "implausible for the element's bounds").otherwise(F.col("error"))).select(*explicit.columns)


def evidence(boxes: DataFrame, explicit: DataFrame, derive: bool = True) -> DataFrame:
    """All quantities of elements: explicit ones, checked; derived ones; and a placeholder where there is neither."""
    sound = implausible(boxes, explicit)
    every = sound.unionByName(derived_quantities(boxes, sound), allowMissingColumns=True) if derive else sound
    bare = boxes.select("element_id").join(every.select("element_id").distinct(), "element_id", "left_anti")
    none = bare.select("element_id", F.lit("unknown").alias("quantity_type"), F.lit("unavailable").alias("quantity_source"), F.lit("missing").alias("quality"), F.lit("no supported quantity is available").alias("error"))
    return every.unionByName(none, allowMissingColumns=True)


def leed_state(bim: Column, documents: Column, outcome: Column) -> Column:
    """What may be said of a requirement: from both kinds of evidence and a named evaluator's outcome (null: none)."""
    return (
        F.when(~(F.coalesce(bim, F.lit(False)) & F.coalesce(documents, F.lit(False))), "insufficient_evidence")
        .when(outcome.isNull(), "not_automatically_evaluable")
        .when(outcome, "satisfied_from_available_evidence")
        .otherwise("not_satisfied_from_available_evidence")
    )


def scope_key(project: Column, files: Column) -> Column:
    """SHA-256 of the compact JSON list of the project and its sorted files. Ids hold no characters that JSON escapes."""
    quoted = F.transform(F.concat(F.array(project), F.sort_array(files)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.sha2(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), 256)
