"""Bounded samples of labelled rows to fit models on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purlin.llm.common import freeze, quoted

PER_CLASS = 3000  # rows of each label value that reach the driver, whatever the corpus holds
MOST_CHARS = 24_000_000  # characters of a sample that reach the driver, whole texts of any length


def within(rows: DataFrame, text: str, order: list[str], group: str, most_chars: int, name: str) -> DataFrame:
    """Of a bounded table of texts those that fit together into ``most_chars``.

    Texts are taken in ``order``, each group up to its equal share of the characters; what is left then goes to those that didn't
    fit, in order. The table is frozen; ids and lengths alone reach the driver for it.
    """
    held = freeze(rows.withColumn("__row", F.monotonically_increasing_id()), name)
    sizes = held.select(group, "__row", *order, F.length(text).alias("__chars")).collect()
    groups: dict[object, int] = dict.fromkeys((r[group] for r in sizes), 0)
    share = most_chars // max(1, len(groups))
    chosen, passed = [], []
    for r in sorted(sizes, key=lambda r: tuple((r[c] is not None, r[c]) for c in order)):
        fits = groups[r[group]] + r["__chars"] <= share
        groups[r[group]] += r["__chars"] if fits else 0
        (chosen if fits else passed).append((r["__row"], r["__chars"]))
    left = most_chars - sum(groups.values())
    for row, chars in passed:
        if chars <= left:
            chosen.append((row, chars))
            left -= chars
    return held.join(F.broadcast(held.sparkSession.createDataFrame([c[:1] for c in chosen], "__row long")), "__row").drop("__row")  # a row of the bounded table each


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    allowed: Column,
    per_class: int = PER_CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_chars: int = MOST_CHARS,
) -> tuple[list[str], list[int], float]:
    """Texts, their 0/1 labels, and the log odds of label 1 among all allowed labelled rows.

    ``allowed``: a condition over ``__id``, the labels' id. Each class gives the rows with the smallest hashes of the
    id, so the sample doesn't depend on how the tables are split. Null labels and ids aren't used. What reaches the driver is
    bounded: at most ``4 * per_class`` texts, of ``most_chars`` characters together.
    """
    known = labels.select(quoted(id_col).alias("__id"), quoted(label_col).cast("int").alias("__y"))
    known = known.where(allowed).where("__id is not null and __y in (0, 1)")
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("__id", F.lit(17)), F.col("__id")]
    chosen = [known.where(F.col("__y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])  # 2 * per_class rows at most
    texts = docs.select(quoted(id_col).alias("__id"), F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    rows = texts.join(F.broadcast(ids), "__id").select("__id", "__text", "__y")
    # ids may be repeated: the first two rows of each by a total order, so that the sample is always the same
    turn = F.row_number().over(Window.partitionBy("__id", "__y").orderBy(F.xxhash64("__text"), F.length("__text")))
    rows = rows.withColumns({"__turn": turn, "__hash": F.xxhash64("__id", F.lit(17))}).where("__turn <= 2")
    rows = within(rows, "__text", ["__hash", "__id", "__turn"], "__y", most_chars, "labelled").select("__id", "__text", "__y").collect()
    rows.sort(key=lambda r: (r["__id"], r["__text"], r["__y"]))
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)
    return [r["__text"] for r in rows], [r["__y"] for r in rows], math.log(prior)


def not_held_out(modulus: int, remainder: int) -> Column:
    """Condition over ``__id``: crc32 of the id as text leaves another remainder."""
    return F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(modulus)) != remainder
