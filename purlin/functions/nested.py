"""Nested values: numbers by key from JSON of any depth, rounding at any depth, boxes from flat vertex arrays, records with two spellings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.sources.store import Scratch


def harvested(rows: DataFrame, json: str, ids: list[str], words: tuple[str, ...]) -> DataFrame:
    """(ids, path, key, value): every number in a JSON text whose key, or that of the list it is in, has all the words.

    The texts are parsed once to variants; each round opens the objects and lists of one more depth of all rows at once, and ends
    when none is left. ``path`` holds the places on the way, so sorting by it gives the document's order. Keys are compared
    without case. Numbers in strings count; null, malformed and scalar documents give nothing.
    """
    tables = Scratch(rows.sparkSession, "harvest")
    level = rows.select(*ids, F.array().cast("array<int>").alias("path"), F.lit("").alias("key"), F.try_parse_json(json).alias("v"))
    found = None
    while True:
        kind = F.schema_of_variant("v")
        level = tables.freeze(level.withColumn("nested", F.coalesce(kind.like("OBJECT%") | kind.like("ARRAY%"), F.lit(False))))
        hit = ~F.col("nested")
        for w in words:
            hit = hit & F.contains(F.lower("key"), F.lit(w.lower()))
        text = F.expr("try_variant_get(v, '$', 'string')")
        value = F.when(F.schema_of_variant("v") != "BOOLEAN", text.try_cast("double"))
        leaves = level.where(hit).select(*ids, "path", "key", value.alias("value")).where("value is not null")
        found = leaves if found is None else found.unionByName(leaves)
        nested = level.where("nested")
        if nested.isEmpty():
            return found
        level = _below(nested, ids)


def _below(nested: DataFrame, ids: list[str]) -> DataFrame:
    named = nested.select(*ids, "path", F.col("key").alias("above"), "v")
    return named.sparkSession.sql(
        "select {ids}, concat(path, array(e.pos)) as path, coalesce(e.key, above) as key, e.value as v from {{nested}}, lateral variant_explode(v) as e".format(ids=", ".join(f"`{c}`" for c in ids)),
        nested=named,
    )


def rounded(value: Column, kind: T.DataType, digits: int = 9) -> Column:
    """Every floating number in a nested value rounded, half to even; all else as it is."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.bround(value, digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rounded(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[rounded(value[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rounded(x, kind.valueType, digits))
    return value


def vertex_box(vertices: Column) -> Column:
    """struct(min_x, ..., max_z, fault) of a flat array x, y, z, x, ...: one pass over the array.

    Null without vertices. A length that is no multiple of three, or a vertex that isn't finite, is a fault without a box.
    """
    n = F.coalesce(F.size(vertices), F.lit(0))
    axes = "xyz"
    none = F.lit(None).cast("double")
    start = F.struct(*[none.alias(f"{m}_{a}") for m in ("min", "max") for a in axes], F.lit(True).alias("finite"))

    def fold(acc: Column, i: Column) -> Column:
        at = {a: F.get(vertices, 3 * i + k).cast("double") for k, a in enumerate(axes)}
        finite = acc["finite"]
        for v in at.values():
            finite = finite & F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
        least = [F.least(acc[f"min_{a}"], v).alias(f"min_{a}") for a, v in at.items()]
        most = [F.greatest(acc[f"max_{a}"], v).alias(f"max_{a}") for a, v in at.items()]
        return F.struct(*least, *most, finite.alias("finite"))

    box = F.aggregate(F.sequence(F.lit(0), F.greatest((n / 3).cast("int"), F.lit(1)) - 1), start, fold)
    names = [f"{m}_{a}" for m in ("min", "max") for a in axes]
    bad = F.struct(*[none.alias(c) for c in names], F.lit("malformed vertices").alias("fault"))
    good = F.when(box["finite"], F.struct(*[box[c].alias(c) for c in names], F.lit(None).cast("string").alias("fault"))).otherwise(bad)
    return F.when(n <= 0, None).when(n % 3 != 0, bad).otherwise(good)


def camel(name: str) -> str:
    """storey_name as storeyName."""
    return re.sub("_([a-z0-9])", lambda m: m[1].upper(), name)


def canonical(frame: DataFrame, schema: T.StructType, also: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Records whose columns are in snake or camel case, or under other names of ``also``, with the schema's columns.

    Of several spellings the first that isn't null counts, in the order snake case, camel case, other names; what is in none is null.
    """
    out = []
    for f in schema.fields:
        names = [n for n in dict.fromkeys((f.name, camel(f.name), *(also or {}).get(f.name, ()))) if n in frame.columns]
        value = F.coalesce(*[F.col(f"`{n}`").cast(f.dataType) for n in names]) if names else F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
    return frame.select(*out)
