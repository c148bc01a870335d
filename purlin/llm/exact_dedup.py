"""Exact deduplication by content sort, in DataFrame operations alone.

Splitters sampled from the leading characters and the digest of the normalised text range-partition the rows
(``repartitionByRange``); an external sort places equal texts next to each other; the window operator compares each
text in full with its neighbour and hands every row of a run its keeper and its size. One shuffle of the texts.

A text with more than a quarter of a partition's fair share of rows is hot. Those texts are found first by an exact
count per digest with map-side combining (at most four a partition can exist, which bounds the broadcast), and their
rows get a salt made from the id, so a run of any length is spread over the partitions. One row of each hot text goes along
with every salt: a run is compared with it in full like with any neighbour, and takes the whole text's keeper and size only if equal.

Defined results: null text counts as empty; null ids lose to others; of rows with equal text and equal id one row
is kept; an empty table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purlin.llm.common import freeze, numbered, partitions, renamed_back

HEAD = 24


def _runs(rows: DataFrame, id_: str, text: Column, keep: str) -> DataFrame:
    """``rows`` with __keep, __size, __kept and __sha."""
    best, order = (F.max, F.col(id_).desc_nulls_last()) if keep == "largest" else (F.min, F.col(id_).asc_nulls_last())
    parts = partitions(rows.sparkSession)
    total = rows.count()
    hot_rows = max(16, total // (4 * parts))
    rows = rows.withColumn("__sha", F.sha2(text.cast("binary"), 256))
    hot = freeze(
        rows.groupBy("__sha")
        .agg(F.count(F.lit(1)).alias("__hot_size"), best(id_).alias("__hot_keep"))
        .where(F.col("__hot_size") > hot_rows),
        "hot",
    )
    rows = rows.withColumn("__text", text)
    one = rows.join(F.broadcast(hot.select("__sha")), "__sha", "left_semi").groupBy("__sha").agg(F.first("__text").alias("__text"))
    one = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("__salt"), F.lit(True).alias("__one"))
    rows = rows.join(F.broadcast(hot), "__sha", "left")
    salt = F.when(F.col("__hot_size").isNotNull(), F.pmod(F.xxhash64(id_), F.lit(parts))).otherwise(F.lit(0))
    rows = rows.withColumns({"__salt": salt, "__one": F.lit(False)}).unionByName(one, allowMissingColumns=True)
    rows = rows.withColumn("__head", F.substring("__text", 1, HEAD))
    text = F.col("__text")
    dealt = rows.repartitionByRange("__head", "__sha", "__salt")
    run = Window.partitionBy("__head", "__sha", "__salt", text)
    ordered = run.orderBy("__one", order)
    return (
        dealt.withColumns(
            {
                "__rank": F.row_number().over(ordered),
                "__first": F.first(id_).over(ordered),
                "__len": F.count(F.when(~F.col("__one"), 1)).over(run),
                "__equal": F.max("__one").over(run),
            }
        )
        .where(~F.col("__one"))
        .withColumns(
            {
                "__keep": F.when(F.col("__equal"), F.col("__hot_keep")).otherwise(F.col("__first")),
                "__size": F.when(F.col("__equal"), F.col("__hot_size")).otherwise(F.col("__len")),
            }
        )
        .withColumn("__kept", (F.col("__rank") == 1) & F.col(id_).eqNullSafe(F.col("__keep")))
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to what is compared (default: unchanged). ``keep``: smallest or largest id.
    """
    rows, names = numbered(docs, [id_col, text_col])
    text = F.coalesce(F.col(names[text_col]), F.lit(""))
    text = normalise(text) if normalise else text
    return _runs(rows, names[id_col], text, keep).select(
        F.col(names[id_col]).alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").cast("long").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; columns unchanged."""
    rows, names = numbered(docs)
    text = F.coalesce(F.col(names[text_col]), F.lit(""))
    text = normalise(text) if normalise else text
    return _runs(rows, names[id_col], text, keep).where("__kept").select(*renamed_back(names))
