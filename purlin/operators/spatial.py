"""Clash and clearance detection: an interval self-join of 3-D boxes on a hierarchical grid.

Each box lives on the grid level whose cells are at least as wide as the box with its clearance, so it covers at most
two cells an axis there, and also on every coarser level that is in use. Pairs meet on the coarser of their two
levels, in exactly one owner cell, so no distinct is needed; slabs as wide as the building cost a few coarse cells
instead of thousands of fine ones. The join is an equi-join on (level, cell), which may be split where skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLEARANCE = 0.25  # metres
AXES = ("x", "y", "z")
MIN_LEVEL, MAX_LEVEL = -4, 30
FEW = 20_000  # elements that are sent to every task
ALL_AT_ONCE, SHARES = 50_000, (1 / 256, 1 / 16)  # boxes up to which all are joined at once; else shares of the largest to begin with
ROUNDING = 1e-4  # metrics are rounded to four places

# Pairs of types that are never an issue with each other.
IGNORED_TYPE_PAIRS = (
    ("IfcWallStandardCase", "IfcWallStandardCase"),
    ("IfcSpace", "IfcSpace"),
    ("IfcRailing", "IfcWallStandardCase"),
    ("IfcRailing", "IfcStair"),
    ("IfcRailing", "IfcSlab"),
    ("IfcRailing", "IfcRailing"),
    ("IfcDoor", "IfcWallStandardCase"),
    ("IfcDoor", "IfcSlab"),
    ("IfcDoor", "IfcDoor"),
    ("IfcCovering", "IfcWallStandardCase"),
    ("IfcCovering", "IfcCovering"),
    ("IfcSlab", "IfcWallStandardCase"),
    ("IfcStair", "IfcWallStandardCase"),
    ("IfcSlab", "IfcStair"),
)


def rounded(value: Column, digits: int = 4) -> Column:
    """Half up to ``digits`` decimals, by the expression that other engines evaluate alike."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def ignored(a: Column, b: Column) -> Column:
    """Whether the two types are never an issue with each other; order doesn't matter."""
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return pair.isin(["|".join(sorted(p)) for p in IGNORED_TYPE_PAIRS])


def gap(axis: str) -> Column:
    """Distance between the boxes a and b along an axis; negative where they overlap."""
    lo, hi = f"min_{axis}", f"max_{axis}"
    return F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")) - F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}"))


def classify(gaps: list[Column], clearance: float) -> tuple[Column, Column]:
    """(issue, metric): overlap on all axes is a CLASH by volume, else a distance under ``clearance`` a violation."""
    overlap = gaps[0] < 0
    volume = -gaps[0]
    for g in gaps[1:]:
        overlap, volume = overlap & (g < 0), volume * -g
    apart = [F.greatest(g, F.lit(0.0)) for g in gaps]
    distance = F.sqrt(sum((d * d for d in apart[1:]), apart[0] * apart[0]))
    issue = F.when(overlap, "CLASH").when(distance < clearance, "CLEARANCE_VIOLATION")
    return issue, rounded(F.when(overlap, volume).otherwise(distance))


def _level(clearance: float) -> Column:
    width = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]) + 2 * clearance
    return F.least(F.greatest(F.ceil(F.log2(width)), F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL)).cast("int")


def _cells(boxes: DataFrame, margin: float, role: str) -> DataFrame:
    """A row for every cell of its grid level ``at`` that a box, widened by ``margin``, touches."""
    size = F.pow(F.lit(2.0), F.col("at"))
    out = boxes
    for a in AXES:
        low, high = F.floor((F.col(f"min_{a}") - margin) / size), F.floor((F.col(f"max_{a}") + margin) / size)
        out = out.withColumn(f"{role}_{a}", low).withColumn(f"cell_{a}", F.explode(F.sequence(low, high)))
    return out


def in_scope(elements: DataFrame, project: str | None = None, files: list[str] | None = None) -> DataFrame:
    """Elements with a box, of a project and of files; None or an empty list means all."""
    rows = elements.where(F.col("min_x").isNotNull())
    rows = rows if project is None else rows.where(F.col("project_id") == project)
    return rows.where(F.col("source_file_id").isin(list(files))) if files else rows


def _small(boxes: DataFrame, levels: list[int], clearance: float) -> DataFrame:
    """Rows of boxes as the smaller of a pair: on their own level and every coarser one of ``levels``."""
    on_all = boxes.withColumn("at", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("level"))))
    return _cells(on_all, clearance, "s")


def _large(boxes: DataFrame) -> DataFrame:
    return _cells(boxes.withColumn("at", F.col("level")), 0.0, "l")


def _met(small: DataFrame, large: DataFrame, clearance: float, carry: list[str]) -> DataFrame:
    """Issues of a smaller with a larger box, each pair once."""
    small, large = small.alias("a"), large.alias("b")
    keys = (F.col("a.at") == F.col("b.at")) & (F.col("a.cell_x") == F.col("b.cell_x")) & (F.col("a.cell_y") == F.col("b.cell_y")) & (F.col("a.cell_z") == F.col("b.cell_z"))
    owner = F.lit(True)
    near = F.lit(True)
    for x in AXES:
        owner = owner & (F.col(f"a.cell_{x}") == F.greatest(F.col(f"a.s_{x}"), F.col(f"b.l_{x}")))
        near = near & (gap(x) < clearance)
    once = (F.col("a.level") < F.col("b.level")) | (F.col("a.id") < F.col("b.id"))
    copies = F.coalesce((F.col("a.ifc_guid") != "") & (F.col("a.ifc_guid") == F.col("b.ifc_guid")), F.lit(False)) & ~F.col("a.source_file_id").eqNullSafe(F.col("b.source_file_id"))
    wanted = owner & near & once & ~copies & ~ignored(F.col("a.ifc_type"), F.col("b.ifc_type"))
    issue, metric = classify([gap(x) for x in AXES], clearance)
    named = lambda x: F.coalesce(F.col(f"{x}.source_file_id"), F.lit("")) != ""
    crossing = F.coalesce(named("a") & named("b") & (F.col("a.source_file_id") != F.col("b.source_file_id")), F.lit(False))
    first = (F.col("a.min_x") < F.col("b.min_x")) | ((F.col("a.min_x") == F.col("b.min_x")) & (F.col("a.id") < F.col("b.id")))
    return (
        small.join(large, keys & wanted)
        .select(
            F.when(first, F.col("a.id")).otherwise(F.col("b.id")).alias("a_id"),
            F.when(first, F.col("b.id")).otherwise(F.col("a.id")).alias("b_id"),
            crossing.alias("cross_file"),
            issue.alias("issue"),
            metric.alias("metric"),
            *[F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{end}_{c}") for c in carry for end, x, y in (("a", "a", "b"), ("b", "b", "a"))],
        )
        .where(F.col("issue").isNotNull())
    )


def clash_pairs(elements: DataFrame, clearance: float = CLEARANCE, carry: list[str] | None = None, among: Column | None = None) -> DataFrame:
    """(a_id, b_id, cross_file, issue, metric) of all issues; a is the box that begins first on x, then by id.

    Boxes without coordinates, equal guids (unless empty) of different files, and ignored type pairs give no issue.
    Columns ``carry`` of both elements come with an issue as a_... and b_..., so it needs no join with its elements.
    ``among``, a condition on elements, keeps the issues that have such an element at either end; the others' boxes meet these
    alone, without a shuffle where there are at most FEW of them.
    """
    carry = list(carry or [])
    columns = list(dict.fromkeys(["id", "ifc_guid", "ifc_type", "source_file_id", *[f"{m}_{a}" for a in AXES for m in ("min", "max")], *carry]))
    hit = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    boxes = elements.where(F.col("min_x").isNotNull()).withColumn("__hit", hit).select(*columns, "__hit").withColumn("level", _level(clearance))
    counts = {(r["level"], r["__hit"]): r["n"] for r in boxes.groupBy("level", "__hit").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 70 rows
    levels = sorted({level for level, _ in counts}) or [0]
    if among is None:
        return _met(_small(boxes, levels, clearance), _large(boxes), clearance, carry)
    few = sum(n for (_, hit), n in counts.items() if hit) <= FEW
    sent = F.broadcast if few else lambda frame: frame
    hits, rest = boxes.where("__hit"), boxes.where("not __hit")
    hit_levels = sorted({level for level, hit in counts if hit}) or [0]
    return _met(sent(_small(hits, levels, clearance)), _large(boxes), clearance, carry).unionByName(_met(_small(rest, hit_levels, clearance), sent(_large(hits)), clearance, carry))


def worst_issues(elements: DataFrame, k: int, carry: list[str] | None = None, wanted: Column | None = None, only_clashes: bool = False, clearance: float = CLEARANCE) -> DataFrame:
    """The k issues of largest metric, ties by a_id and b_id, of those that fit ``wanted``, a condition on ``clash_pairs``' columns.

    Two boxes overlap by no more than the smaller one's volume. So the k-th metric t among some large boxes bounds what matters:
    no box under t is part of the answer, unless a violation, whose metric is under ``clearance``, can be. Where the large boxes
    have less than k issues, or none of use, more of them are taken, in the end all.
    """
    boxes = elements.where(F.col("min_x").isNotNull())
    volume = F.lit(1.0)
    for x in AXES:
        volume = volume * (F.col(f"max_{x}") - F.col(f"min_{x}"))

    def first(rows: DataFrame) -> DataFrame:
        found = clash_pairs(rows, clearance, carry)
        found = found.where(F.col("issue") == "CLASH") if only_clashes else found
        found = found if wanted is None else found.where(wanted)
        return found.orderBy(F.col("metric").desc_nulls_first(), "a_id", "b_id").limit(k)

    least = lambda v: boxes.where(F.coalesce(volume >= v, F.lit(True)))
    known = boxes.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(volume, [1 - s for s in SHARES], 10_000).alias("cuts")).first()
    for cut in (known["cuts"] or []) if known["n"] > ALL_AT_ONCE else []:
        t = first(least(cut)).agg(F.count("metric").alias("n"), F.min("metric").alias("t")).first()
        if t["n"] == k and (only_clashes or t["t"] - ROUNDING > clearance):
            return first(least(min(cut, t["t"] - ROUNDING)))
    return first(boxes)


# The same issues by a plain theta join, for engines without the grid.
ISSUES_SQL = """
    select a_id, b_id, cross_file, case when g1 < 0 and g2 < 0 and g3 < 0 then 'CLASH' else 'CLEARANCE_VIOLATION' end as issue,
      floor(case when g1 < 0 and g2 < 0 and g3 < 0 then -g1 * g2 * g3 else d end * 10000.0 + 0.5) / 10000.0 as metric
    from (select *, sqrt(greatest(g1, 0.0) * greatest(g1, 0.0) + greatest(g2, 0.0) * greatest(g2, 0.0) + greatest(g3, 0.0) * greatest(g3, 0.0)) as d
      from (select a.id as a_id, b.id as b_id, coalesce(a.source_file_id <> '' and b.source_file_id <> '' and a.source_file_id <> b.source_file_id, false) as cross_file,
          greatest(a.min_x, b.min_x) - least(a.max_x, b.max_x) as g1,
          greatest(a.min_y, b.min_y) - least(a.max_y, b.max_y) as g2,
          greatest(a.min_z, b.min_z) - least(a.max_z, b.max_z) as g3
        from {elements} a join {elements} b
          on a.min_z <= b.max_z + 0.25 and b.min_z <= a.max_z + 0.25 and b.min_x < a.max_x + 0.25
          and (a.min_x < b.min_x or (a.min_x = b.min_x and a.id < b.id))
          and a.min_y < b.max_y + 0.25 and b.min_y < a.max_y + 0.25
        where not (coalesce(a.ifc_guid <> '' and a.ifc_guid = b.ifc_guid, false) and a.source_file_id is distinct from b.source_file_id)
          and concat(least(a.ifc_type, b.ifc_type), '|', greatest(a.ifc_type, b.ifc_type)) not in (""" + ", ".join("'" + "|".join(sorted(p)) + "'" for p in IGNORED_TYPE_PAIRS) + """)) g) h
    where (g1 < 0 and g2 < 0 and g3 < 0) or d < 0.25"""
