"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked until the cells' weights meet the target marginals; a
cell's weight over its tokens is the probability with which its documents are drawn, by a hash of the id.

A topic is one of ``2 ** topic_bits`` cells of a random projection of the hashed vector of the longer words, so
documents with one vocabulary share a topic; no model is needed. The annotated rows are frozen once. Cells are
summed with map-side combining. Every source and language has its own marginal. Up to ``DRIVER_CELLS`` cells are raked
on the driver; more are raked by the same steps as group sums and joins, and only one row a round reaches it.

Defined results: null source or language counts as empty text, a category of its own; null text has no tokens and is
drawn like the rest of its cell (surely, where no row of the cell has tokens); rows with one id are drawn alike if they are
of one cell, repeated rows always, null ids among themselves too; an empty table gives an empty result; very long texts are
read whole; columns pass through, and where one is named topic, n_tokens, weight, probability or sampled, the operator's own
gets ``mix_`` before its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.llm import vectors
from purlin.llm.common import Memo, discard, freeze, numbered, renamed_back, ship, uniform

TOPIC_BITS = 3
DRIVER_CELLS = 100_000  # for speed only: the weights are the same either way
ROUNDS = 500
LONG_WORD = 6


def _annotate(seed: int, bits: int, text_at: int, carried: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = vectors.projection(bits, seed)
        weights = 1 << np.arange(bits)
        memo = Memo(lambda w: vectors.word_bucket(w) if len(w) >= LONG_WORD else -1)
        for batch in batches:
            topics, counts = [], []
            for text in batch.column(text_at):
                words = (text.as_py() or "").split()
                at = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                topics.append(int(((vectors.project(at[at >= 0], matrix) > 0) * weights).sum()))
                counts.append(len(words))
            kept = [i for i in range(batch.num_columns) if carried or i != text_at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(topics, pa.int32()), pa.array(counts, pa.int64())],
                [batch.schema.names[i] for i in kept] + ["__topic", "__tokens"],
            )

    return run


def rake(tokens: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights per cell: marginals proportional to ``targets`` and summing to ``budget``, none above its tokens.

    Where a cap makes a target unreachable the weights come as near as the caps allow.
    """
    weight = tokens * (budget / max(tokens.sum(), 1e-300))
    for _ in range(rounds):
        before = weight
        for at, target in zip(index, targets, strict=True):
            have = np.bincount(at, weight, len(target))
            weight = weight * np.divide(target * budget, have, out=np.zeros_like(have), where=have > 0)[at]
        weight = np.minimum(weight, tokens)
        if np.allclose(weight, before, rtol=1e-10, atol=0):
            break
    return weight


def flattened(shares: Mapping[str, float], power: float = 0.5) -> dict[str, float]:
    """Shares raised to ``power``: small categories gain, large ones lose."""
    raised = {k: v**power for k, v in shares.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def _raked(cells: list, given: Mapping[str, Mapping[str, float]], keep_fraction: float) -> list[tuple]:
    axes = [sorted({r[i] for r in cells}) for i in range(3)]
    places = [{k: i for i, k in enumerate(axis)} for axis in axes]
    index = [np.array([place[r[i]] for r in cells], np.int64) for i, place in enumerate(places)]
    tokens = np.array([r["t"] for r in cells], np.float64)
    shares = []
    for axis, at, kind in zip(axes, index, ("source", "lang", "topic"), strict=True):
        now = dict(zip(axis, np.bincount(at, tokens, len(axis)).tolist(), strict=True))
        goal = given.get(kind) or flattened(now)
        shares.append(np.array([goal.get(k, 0.0) for k in axis]) / (sum(goal.get(k, 0.0) for k in axis) or 1.0))
    weight = rake(tokens, index, shares, keep_fraction * tokens.sum()) if len(tokens) else tokens
    return [(r["s"], r["l"], r["t_"], float(w), float(w / t)) for r, w, t in zip(cells, weight, tokens, strict=True)]


def rake_cells(cells: DataFrame, given: Mapping[str, Mapping[str, float]], keep_fraction: float, rounds: int = ROUNDS) -> DataFrame:
    """``rake`` of any number of cells (s, l, t_, t), without a collect of them: s, l, t_, w, p."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("t")).first()[0])
    budget = keep_fraction * total
    now = cells.withColumn("w", F.col("t") * F.lit(budget / total))
    for axis, kind in (("s", "source"), ("l", "lang"), ("t_", "topic")):
        sums = cells.groupBy(axis).agg(F.sum("t").cast("double").alias("v"))
        if given.get(kind):
            rows = [(k, float(v)) for k, v in given[kind].items()]
            goal = spark.createDataFrame(rows, f"{axis} {cells.schema[axis].dataType.simpleString()}, g double")
            goal = sums.join(goal, axis, "left").select(axis, F.coalesce("g", F.lit(0.0)).alias("g"))
        else:
            goal = sums.select(axis, F.sqrt("v").alias("g"))
        goal = freeze(goal, f"goal-{axis}")
        whole = goal.agg(F.sum("g")).first()[0] or 1.0
        now = now.join(goal.select(axis, (F.col("g") / F.lit(whole) * F.lit(budget)).alias(f"g_{axis}")), axis)
    now = freeze(now, "rake")
    for _ in range(rounds):
        step = now.withColumn("old", F.col("w"))
        for axis in ("s", "l", "t_"):
            have = step.groupBy(axis).agg(F.sum("w").alias("have"))
            moved = step.join(have, axis).withColumn("w", F.when(F.col("have") > 0, F.col("w") * (F.col(f"g_{axis}") / F.col("have"))).otherwise(F.lit(0.0))).drop("have")
            moved, last = freeze(moved, "rake"), step
            discard(last)
            step = moved
        capped = freeze(step.withColumn("w", F.least("w", F.col("t").cast("double"))), "rake")
        discard(step, now)
        now = capped
        if not now.where(F.abs(F.col("w") - F.col("old")) > 1e-10 * F.abs("old")).limit(1).count():
            break
        kept = freeze(now.drop("old"), "rake")
        discard(now)
        now = kept
    return now.select("s", "l", "t_", "w", (F.col("w") / F.col("t")).alias("p"))


def mix(
    docs: DataFrame,
    keep_fraction: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    targets: Mapping[str, Mapping[str, float]] | None = None,
    carry: list[str] | None = None,
    seed: int = 5,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with topic, n_tokens, weight, probability, sampled.

    ``targets`` may give shares for "source", "lang" and "topic"; a missing one is the square-root flattened share.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = list(docs.columns) if carry is None else list(carry)
    needed = list(dict.fromkeys([*wanted, id_col, source_col, lang_col, text_col]))
    rows, names = numbered(docs, needed)
    keep_text = text_col in wanted
    fields = [f for f in rows.schema.fields if keep_text or f.name != names[text_col]]
    out = T.StructType(fields + [T.StructField("__topic", T.IntegerType()), T.StructField("__tokens", T.LongType())])
    noted = freeze(rows.mapInArrow(_annotate(seed, TOPIC_BITS, needed.index(text_col), keep_text), out), "mixing")
    source = F.coalesce(F.col(names[source_col]).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(names[lang_col]).cast("string"), F.lit(""))
    cells = noted.groupBy(source.alias("s"), lang.alias("l"), F.col("__topic").alias("t_")).agg(F.sum("__tokens").alias("__t"))
    cells = freeze(cells, "cells")
    cells = cells.where("__t > 0").withColumnRenamed("__t", "t")
    given = targets or {}
    if few := cells.count() <= DRIVER_CELLS:
        table = spark.createDataFrame(_raked(cells.collect(), given, keep_fraction), "s string, l string, t_ int, w double, p double")
    else:
        table = rake_cells(cells, given, keep_fraction)
    table = table.toDF("__s", "__l", "__t_", "__w", "__p")
    keyed = noted.withColumns({"__s": source, "__l": lang})
    on = (F.col("a.__s") == F.col("b.__s")) & (F.col("a.__l") == F.col("b.__l")) & (F.col("a.__topic") == F.col("b.__t_"))
    joined = keyed.alias("a").join((F.broadcast(table) if few else table).alias("b"), on, "left")
    probability = F.coalesce("b.__p", F.lit(1.0))
    return joined.select(
        *[F.col(f"a.{names[c]}").alias(c) for c in wanted],
        F.col("a.__topic").alias("topic" if "topic" not in wanted else "mix_topic"),
        F.col("a.__tokens").alias("n_tokens" if "n_tokens" not in wanted else "mix_n_tokens"),
        F.coalesce("b.__w", F.lit(0.0)).alias("weight" if "weight" not in wanted else "mix_weight"),
        probability.alias("probability" if "probability" not in wanted else "mix_probability"),
        (uniform(F.col(f"a.{names[id_col]}"), seed) < probability).alias("sampled" if "sampled" not in wanted else "mix_sampled"),
    )


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws; columns unchanged."""
    rows, names = numbered(docs)
    columns = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang"}
    renamed = {k: names[options.pop(k, v)] for k, v in columns.items()}
    return mix(rows, **renamed, **options).where("sampled").select(*renamed_back(names))
