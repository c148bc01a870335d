"""Typed-edge graph operators on ``nodes`` and ``edges`` DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purlin.operators.spatial import clash_pairs, in_scope, worst_issues


def both_directions(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every edge from either end: (here, there, ...); a loop appears once."""
    turned = edges.where(F.col(a) != F.col(b)).withColumn("__t", F.col(a)).withColumn(a, F.col(b)).withColumn(b, F.col("__t")).drop("__t")
    return edges.unionByName(turned)


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, F.col("target_id") == ids.id, "left_semi")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of all that directed edges lead to, at the least depth; of any depth, and cycles end.

    A level holds only what no earlier one did; the pairs found so far are cut off from their history by a checkpoint every
    few levels (where ``spark.checkpoint.dir`` names a shared folder).
    """
    links = edges.select("source_id", F.col("target_id").alias("next_id")).distinct()
    level = roots.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0))
    found, depth = level, 0
    reliable = roots.sparkSession.conf.get("spark.checkpoint.dir", None)
    while True:
        depth += 1
        ahead = level.join(links, level.id == links.source_id).select("root", F.col("next_id").alias("id")).distinct()
        level = ahead.join(found.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth))
        level = level.checkpoint() if reliable else level.persist()
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def degree_features(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """In- and out-degree, per type too, distinct neighbours, and the neighbours' mean of those.

    Edges are brought to their existing ends once; degrees and neighbours both read that.
    """
    ends = attached(edges, nodes).persist()
    ends = ends.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "rel_type", F.lit(1).alias("out")).unionByName(
        ends.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "rel_type", F.lit(0).alias("out"))
    )
    per_type = [F.sum(F.when((F.col("rel_type") == t) & (F.col("out") == o), 1).otherwise(0)).alias(f"{n}_{t.lower()}") for t in types for o, n in ((1, "out"), (0, "in"))]
    degree = ends.groupBy("id").agg(F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"), *per_type)
    pairs = ends.where("id != other").select("id", "other").distinct()
    near = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
    around = pairs.join(near.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("neighbours").alias("__s"))
    joined = nodes.select("id").join(degree, "id", "left").join(near, "id", "left").join(around, "id", "left")
    counts = [c for c in joined.columns if c not in ("id", "__s")]
    filled = joined.select("id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], "__s")
    mean = F.when(F.col("neighbours") > 0, F.col("__s") / F.col("neighbours")).otherwise(0.0)
    return filled.withColumn("neighbour_mean_degree", F.floor(mean * 10000.0 + 0.5) / F.lit(10000.0)).drop("__s")


def degree_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree and distinct neighbours alone, as in ``degree_features``: edges meet once by their pair of ends, whichever
    way they go, then both ends of a pair are summed."""
    a, b = F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    pairs = attached(edges, nodes).select(a, b, (F.col("source_id") <= F.col("target_id")).cast("long").alias("ab")).groupBy("a", "b")
    pairs = pairs.agg(F.sum("ab").alias("ab"), F.sum(1 - F.col("ab")).alias("ba"))
    end = lambda *x: F.struct(*[F.expr(v).alias(n) for v, n in zip(x, ("id", "out_degree", "in_degree", "neighbours"), strict=True)])
    loop = F.array(end("a", "ab", "ab", "0L"))
    ends = pairs.select(F.inline(F.when(F.col("a") == F.col("b"), loop).otherwise(F.array(end("a", "ab", "ba", "1L"), end("b", "ba", "ab", "1L")))))
    counts = ["out_degree", "in_degree", "neighbours"]
    degree = ends.groupBy("id").agg(*[F.sum(c).alias(c) for c in counts])
    return nodes.select("id").join(degree, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


def issue_listing(
    elements: DataFrame,
    issue: str | None = None,
    storeys: list[str] | None = None,
    types: list[str] | None = None,
    project: str | None = None,
    files: list[str] | None = None,
    limit: int = 1000,
) -> DataFrame:
    """The worst issues with both ends' identity. Project and files hold for both ends, so they are applied before the
    join; storeys and types for either end. An empty filter means all."""
    either = lambda c, values: F.coalesce(F.col(f"a_{c}").isin(values), F.lit(False)) | F.coalesce(F.col(f"b_{c}").isin(values), F.lit(False))
    wanted = F.col("issue") == issue if issue else F.lit(True)
    if storeys:
        wanted = wanted & either("storey_name", storeys)
    if types:
        wanted = wanted & either("ifc_type", types)
    worst = worst_issues(in_scope(elements, project, files), limit, ["ifc_guid", "ifc_type", "storey_name", "source_file_id"], wanted, only_clashes=issue == "CLASH")
    crossing = F.coalesce("cross_file", F.col("a_source_file_id") != F.col("b_source_file_id"), F.lit(False))
    of = lambda x: [F.col(f"{x}_id").alias(f"element_{x}_id"), F.coalesce(f"{x}_ifc_guid", f"{x}_id").alias(f"element_{x}_guid"), F.col(f"{x}_ifc_type").alias(f"element_{x}_type"), F.col(f"{x}_storey_name").alias(f"element_{x}_storey")]
    return worst.select(F.col("issue").alias("issue_type"), "metric", *of("a"), *of("b"), crossing.alias("is_cross_file"), F.when(crossing, "CROSS-FILE").otherwise("INTRA-FILE").alias("relation_scope"))


def typed_issues(elements: DataFrame, one: str, two: str, k: int) -> DataFrame:
    """The k worst issues between two types, with both ends' identity as a_... and b_...; elements of other types aren't joined."""
    wanted = ((F.col("a_ifc_type") == one) & (F.col("b_ifc_type") == two)) | ((F.col("a_ifc_type") == two) & (F.col("b_ifc_type") == one))
    return worst_issues(elements.where(F.col("ifc_type").isin(one, two)), k, ["ifc_guid", "name", "ifc_type", "storey_name"], wanted)


def issues_around(elements: DataFrame, match: Column) -> DataFrame:
    """Issues of the elements that ``match``, from each such end: issue, metric, and id, ifc_guid, name, ifc_type and storey_name of
    this end as e_... and of the other as o_...."""
    columns = ["ifc_guid", "name", "ifc_type", "storey_name"]
    marked = elements.withColumn("__match", F.coalesce(match, F.lit(False)))
    found = clash_pairs(marked, carry=[*columns, "__match"], among=F.col("__match"))
    ends = lambda x, y: F.struct(*[F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in ((x, "e"), (y, "o")) for c in ("id", *columns)], F.col(f"{x}___match").alias("match"))
    turned = found.select("issue", "metric", F.explode(F.when(F.col("a_id") != F.col("b_id"), F.array(ends("a", "b"), ends("b", "a"))).otherwise(F.array(ends("a", "b")))).alias("x"))
    return turned.select("issue", "metric", "x.*").where("match").drop("match")


def load_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, raw edges, edges that load (both ends exist, each once) and edges that don't."""
    loaded = attached(edges, nodes).select("source_id", "target_id", "rel_type").dropDuplicates()
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias(name))
    rows = count(nodes, "nodes").crossJoin(count(edges, "edges_raw")).crossJoin(count(loaded, "edges_loaded"))  # single rows
    return rows.withColumn("edges_skipped", F.col("edges_raw") - F.col("edges_loaded"))


def box_features(elements: DataFrame) -> DataFrame:
    """Center and extent on each axis, log1p of the volume, and whether there is a box; zeros where there is none."""
    have = F.lit(True)
    for a in "xyz":
        have = have & F.col(f"min_{a}").isNotNull() & F.col(f"max_{a}").isNotNull()
    or_zero = lambda c: F.when(have, c).otherwise(0.0)
    extent = {a: F.greatest(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(0.0)) for a in "xyz"}
    return elements.select(
        "id",
        *[or_zero((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"center_{a}") for a in "xyz"],
        *[or_zero(extent[a]).alias(f"extent_{a}") for a in "xyz"],
        or_zero(F.log1p(extent["x"] * extent["y"] * extent["z"])).alias("log_volume"),
        have.cast("double").alias("has_bbox"),
    )


def vocabulary(frame: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The distinct values of a categorical column, sorted: types or storeys, of which there are few."""
    found = [r[0] for r in frame.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values: no vocabulary")
    return sorted(found)


def one_hot(frame: DataFrame, column: str, prefix: str, values: list[str]) -> DataFrame:
    """A column a value, and one for what the vocabulary doesn't hold (null too)."""
    known = F.coalesce(F.col(column).isin(values), F.lit(False))
    flags = {f"{prefix}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("double") for v in values}
    return frame.withColumns(flags | {f"{prefix}_UNKNOWN": (~known).cast("double")})


def feature_matrix(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Degree and box features of every node in a fixed order of columns. ``nodes`` with the box's six columns."""
    degrees = degree_features(nodes, edges, types)
    return degrees.join(box_features(nodes), "id")


def ranked_scores(scores: DataFrame, threshold: float, blocks: int = 64) -> DataFrame:
    """``scores`` with a rank (largest first, ties by id) and whether they reach the threshold.

    Ranks come from sorted ranges: each range is counted, then numbered from where the ones before it end, so no task sees
    all rows. An empty table keeps its columns.
    """
    parts = scores.repartitionByRange(blocks, F.col("score").desc(), F.col("id")).withColumn("__part", F.spark_partition_id())
    numbered = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(F.col("score").desc(), F.col("id"))))
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # ``blocks`` rows
    out = numbered.join(F.broadcast(before), "__part")
    return out.withColumn("rank", F.col("__n") + F.col("__before")).withColumn("is_anomaly", F.col("score") >= threshold).drop("__part", "__n", "__size", "__before")


def placed(frame: DataFrame, order: list[Column], name: str, blocks: int = 64) -> DataFrame:
    """``frame`` with each row's place in a total order, from 1: sorted ranges are counted, then numbered, so no task sees all rows."""
    parts = frame.repartitionByRange(blocks, *order).withColumn("__part", F.spark_partition_id())
    numbered = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # ``blocks`` rows
    return numbered.join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + F.col("__before")).drop("__part", "__n", "__size", "__before")


def combined(graphs: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one: ids are set apart by the graph's name. At least one graph."""
    apart = lambda c, g: F.concat(F.lit(f"{g}::"), F.col(c)).alias(c)
    nodes = [n.withColumn("id", apart("id", g)).withColumn("graph_id", F.lit(g)) for g, n, _ in graphs]
    edges = [e.withColumn("source_id", apart("source_id", g)).withColumn("target_id", apart("target_id", g)).withColumn("graph_id", F.lit(g)) for g, _, e in graphs]
    one = lambda frames: frames[0] if len(frames) == 1 else one(frames[:-2] + [frames[-2].unionByName(frames[-1], allowMissingColumns=True)])
    return one(nodes), one(edges)


def quantile(values: DataFrame, column: str, q: float, blocks: int = 256) -> float | None:
    """The exact, interpolated quantile: values are cut into ranges by an approximate sketch, counted, and only the range
    that holds the wanted places is sorted. None without values.

    One pass counts the values below, within and above the range, so none is counted twice or missed where values differ by
    their last bits from pass to pass (sums of doubles depend on the order in which tasks end).
    """
    known = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    cuts = sorted(set(known.approxQuantile("v", [max(0.0, q - 2 / blocks), min(1.0, q + 2 / blocks)], 0.5 / blocks)))
    if not cuts:  # no values, or none that the sketch takes
        return known.agg(F.percentile("v", q)).first()[0]
    within = F.when(F.col("v") < cuts[0], float("-inf")).when(F.col("v") > cuts[-1], float("inf")).otherwise(F.col("v"))
    runs = known.groupBy(within.alias("v")).agg(F.count(F.lit(1)).alias("c")).persist()
    total = runs.agg(F.sum("c")).first()[0]
    place = q * (total - 1)
    low, high = int(place), min(int(place) + 1, total - 1)
    at, out = 0, {}
    for v, c in runs.orderBy("v").toLocalIterator():
        for k in (low, high):
            if at <= k < at + c and cuts[0] <= v <= cuts[-1]:
                out[k] = v
        at += c
        if at > high:
            break
    runs.unpersist()
    if low not in out or high not in out:  # beyond the sketch's error: sort all
        return known.agg(F.percentile("v", q)).first()[0]
    return out[low] + (out[high] - out[low]) * (place - low)


def whole_moments(frame: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of columns of whole numbers, from exact sums: the same bits in whatever order rows come.
    Rows of equal values are counted first. Empty without rows."""
    kinds = frame.groupBy(*columns).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("__n"))
    value = lambda c: F.col(c).cast("decimal(19,0)")
    sums = [F.sum(v).cast("decimal(38,0)") for c in columns for v in (value(c) * F.col("__n"), value(c) * value(c) * F.col("__n"))]
    n, *found = kinds.agg(F.sum("__n"), *sums).first()
    if n is None:
        return {}
    n, found = int(n), [int(x) for x in found]
    return {c: (s / n, math.sqrt((n * s2 - s * s) / (n * n))) for c, s, s2 in zip(columns, found[::2], found[1::2], strict=True)}
