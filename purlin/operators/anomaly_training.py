"""Training of the graph autoencoder by full-batch gradients that stay distributed, and what a trained model is used for.

Nodes and edges never leave the executors. Edges are stored once, as they are: a sum over neighbours is taken along them one
direction after the other, each of which is written before the next begins, so only one direction's shuffle is on disk at a time.
The first convolution's neighbour sums don't depend on the weights, so they are taken once; an epoch then is two passes of messages
along the edges (latent vectors forward, their gradients back), one over the links, and two Arrow passes over the nodes that turn rows into sums of the parameters' size. Those sums are added up in two
levels; the driver holds parameters alone and takes Adam's step. Sums over edges combine on the map side, so a storey that half
of all elements hang on is no hot key there. Dropout is a hash of node, unit and epoch, the same in every pass.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.operators.anomaly import Weights, _columns, scores
from purlin.operators.graph import quantile, ranked_scores
from purlin.sources.store import Files, Scratch, shuffles_released

LAYERS = [f.name for f in fields(Weights)]
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Config:
    seed: int = 42
    epochs: int = 100
    rate: float = 1e-3
    decay: float = 1e-5
    hidden: int = 64
    latent: int = 16
    dropout: float = 0.1
    alpha: float = 0.7
    beta: float = 0.3
    negative_ratio: float = 1.0
    percentile: float = 99.0


def initial(inputs: int, config: Config) -> Weights:
    """Uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(config.seed)

    def layer(out: int, into: int) -> tuple[np.ndarray, np.ndarray]:
        reach = 1 / math.sqrt(into)
        return rng.uniform(-reach, reach, (out, into)), rng.uniform(-reach, reach, out)

    return Weights(layer(config.hidden, inputs), layer(config.latent, config.hidden), layer(config.hidden, config.latent), layer(inputs, config.hidden))


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([part.ravel() for name in LAYERS for part in getattr(weights, name)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = [], 0
    for name in LAYERS:
        pair = []
        for part in getattr(like, name):
            pair.append(values[at : at + part.size].reshape(part.shape))
            at += part.size
        out.append(tuple(pair))
    return Weights(*out)


def exact_non_edges(nodes: DataFrame, edges: DataFrame, wanted: int, seed: int = 42) -> DataFrame:
    """``wanted`` ordered pairs without an edge either way, or all there are if they are fewer; none twice, the same for a seed.

    Each node draws as many partners as are needed on average and a few more, by place in a numbering of the nodes; draws
    that hit an edge, the node itself or an earlier draw are dropped, and further rounds are drawn until enough are there. Ranks over
    a hash, counted by range, cut to the exact number.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).where("source_id != target_id").distinct()
    most = n * (n - 1) - both.count()
    wanted = min(wanted, max(0, most))
    if wanted <= 0:
        return nodes.select(F.col("id").alias("source_id"), F.col("id").alias("target_id")).where("false")
    placed = ranked_scores(ids.withColumn("score", F.lit(0.0)), 1.0).select("id", (F.col("rank") - 1).alias("place"))
    dense = 2 * wanted > most
    draws = n if dense else max(2, -(-2 * wanted // n))
    while True:
        place = F.col("k") if dense else F.pmod(F.xxhash64("source_id", "k", F.lit(seed)), F.lit(n))
        drawn = ids.withColumnRenamed("id", "source_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("source_id", place.cast("long").alias("place"))
        pairs = drawn.join(placed, "place").select("source_id", F.col("id").alias("target_id")).where("source_id != target_id").distinct().join(both, ["source_id", "target_id"], "left_anti")
        if dense or pairs.count() >= wanted:
            break
        draws = 2 * draws
        dense = draws >= n  # nearly all pairs are wanted: take them in turn
        draws = min(draws, n)
    scored = pairs.select(F.concat_ws("\x01", "source_id", "target_id").alias("id"), F.shiftrightunsigned(F.xxhash64("source_id", "target_id", F.lit(seed)), 11).cast("double").alias("score"), "source_id", "target_id")
    return ranked_scores(scored, 0.0).where(F.col("rank") <= wanted).select("source_id", "target_id")


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) if columns else np.zeros((batch.num_rows, 0))


def _lists(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _kept(marks: np.ndarray, units: int, epoch: int, dropout: float) -> np.ndarray:
    """Factors of dropout for each node and unit."""
    if not dropout:
        return np.ones((len(marks), units))
    x = marks.astype(np.uint64)[:, None] + (np.arange(units, dtype=np.uint64) + np.uint64(units * epoch)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(11)).astype(np.float64) / (1 << 53) >= dropout) / (1 - dropout)


def _hidden(batch: pa.RecordBatch, weights: Weights, epoch: int, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(neighbour sums, self weights, slope of the hidden layer, hidden layer)."""
    m, s = _lists(batch, "m"), batch.column("s").to_numpy()
    before = m @ weights.conv1[0].T + s[:, None] * weights.conv1[1]
    slope = (before > 0) * _kept(batch.column("mark").to_numpy(), before.shape[1], epoch, dropout)
    return m, s, slope, before * slope


class Trainer:
    """``nodes``: id and the feature columns; ``edges``: source_id, target_id, both ends among the nodes."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, features: list[str], config: Config = Config(), negatives: DataFrame | None = None):
        self.spark, self.features, self.config = nodes.sparkSession, features, config
        self.tables = Scratch(self.spark, "training")
        freeze = self.tables.freeze
        self.edges = freeze(edges.select("source_id", "target_id"))
        ends = self.edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
        root = 1 / F.sqrt(1 + F.coalesce("d", F.lit(0)))  # of a node's degree, its loop included
        values = [F.col(c).cast("double") for c in features]
        rows = freeze(nodes.join(ends, "id", "left").select("id", F.array(*values).alias("x"), root.alias("root"), F.xxhash64("id", F.lit(config.seed)).alias("mark")))
        names = _columns("x", len(features))
        sums = self._spread(rows.select("id", "root", *[F.col("x")[i].alias(c) for i, c in enumerate(names)], F.lit(1.0).alias("s")), [*names, "s"])
        self.nodes = freeze(rows.join(sums.select("id", F.array(*names).cast("array<double>").alias("m"), "s"), "id"))
        self.tables.drop(rows, sums)
        edges = self.edges
        n_pos = edges.count()
        if negatives is None:
            negatives = exact_non_edges(nodes, edges, int(n_pos * config.negative_ratio), config.seed)
        negatives = freeze(negatives.select("source_id", "target_id"))
        self.n, n_neg = self.nodes.count(), negatives.count()
        if not self.n:
            raise ValueError("an empty graph can't be trained on")
        terms = (n_pos > 0) + (n_neg > 0)
        share = {1.0: 1 / (terms * n_pos) if n_pos else 0.0, 0.0: 1 / (terms * n_neg) if n_neg else 0.0}
        pairs = edges.select("source_id", "target_id", F.lit(1.0).alias("y")).unionByName(negatives.withColumn("y", F.lit(0.0)))
        self.pairs = pairs.withColumn("share", F.when(F.col("y") == 1.0, share[1.0]).otherwise(share[0.0]))

    def _spread(self, sent: DataFrame, columns: list[str]) -> DataFrame:
        """(id, columns): sums over the neighbours and the node itself, weighted by ``root`` of both; ``sent``: id, root, columns."""
        freeze = self.tables.freeze
        sent = freeze(sent.select("id", "root", *[(F.col(c) * F.col("root")).alias(c) for c in columns]))
        got = []
        for here, there in (("source_id", "target_id"), ("target_id", "source_id")):
            met = self.edges.join(sent.select(F.col("id").alias(here), *columns), here)
            got.append(freeze(met.groupBy(F.col(there).alias("id")).agg(*[F.sum(c).alias(c) for c in columns])))
        every = sent.unionByName(got[0], allowMissingColumns=True).unionByName(got[1], allowMissingColumns=True)
        total = every.groupBy("id").agg(F.max("root").alias("root"), *[F.sum(c).alias(c) for c in columns])
        out = freeze(total.select("id", *[(F.col(c) * F.col("root")).alias(c) for c in columns]))
        self.tables.drop(sent, *got)
        return out

    def _link_losses(self, z: DataFrame, latent: list[str]) -> DataFrame:
        """The pairs with both ends' latent vectors, the logit and their part of the loss."""
        root = math.sqrt(len(latent))
        rows = self.pairs
        for end, prefix in (("source_id", "a"), ("target_id", "b")):
            rows = rows.join(z.select(F.col("id").alias(end), *[F.col(c).alias(prefix + c) for c in latent]), end)
        rows = rows.withColumn("logit", sum((F.col("a" + c) * F.col("b" + c) for c in latent), F.lit(0.0)) / root)
        loss = F.greatest(F.col("logit"), F.lit(0.0)) - F.col("logit") * F.col("y") + F.log1p(F.exp(-F.abs("logit")))
        return rows.withColumn("loss", loss * F.col("share"))

    def _links(self, z: DataFrame, latent: list[str]) -> DataFrame:
        """(id, g0, g1, ..., loss): the links' loss and its gradient by the latent vectors of both ends."""
        root = math.sqrt(len(latent))
        rows = self._link_losses(z, latent).withColumns({"slope": self.config.beta * F.col("share") * (1 / (1 + F.exp(-F.col("logit"))) - F.col("y")) / root})
        ends = [
            F.struct(F.col(end).alias("id"), *[(F.col("slope") * F.col(other + c)).alias(c) for c in latent], (F.col("loss") if end == "source_id" else F.lit(0.0)).alias("loss"))
            for end, other in (("source_id", "b"), ("target_id", "a"))
        ]
        found = rows.select(F.explode(F.array(*ends)).alias("e")).select("e.*").groupBy("id")
        return found.agg(*[F.sum(c).alias(f"g{c}") for c in latent], F.sum("loss").alias("loss"))

    def _latent(self, weights: Weights, epoch: int) -> DataFrame:
        """(id, z0, z1, ...) of every node."""
        config = self.config
        latent = _columns("z", config.latent)

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    *_, h = _hidden(batch, weights, epoch, config.dropout)
                    p = h @ weights.conv2[0].T + weights.conv2[1]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), *[pa.array(c) for c in p.T]], ["id", "root", *latent])

        vectors = T.StructType([self.nodes.schema["id"], *[T.StructField(c, T.DoubleType()) for c in ("root", *latent)]])
        return self._spread(self.nodes.select("id", "root", "m", "s", "mark").mapInArrow(forward, vectors), latent)

    def _loss(self, feature: float, structural: float) -> dict[str, float]:
        return {"loss": self.config.alpha * feature + self.config.beta * structural, "feature_loss": feature, "structural_loss": structural}

    def loss(self, weights: Weights, epoch: int = 1) -> dict[str, float]:
        """The loss's parts alone: what ``gradient`` goes through forward, without the way back."""
        latent, cells = _columns("z", self.config.latent), self.n * len(self.features)
        z = self._latent(weights, epoch)

        def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    d = np.maximum(_matrix(batch, latent) @ weights.dec1[0].T + weights.dec1[1], 0)
                    total += float(((d @ weights.dec2[0].T + weights.dec2[1] - _lists(batch, "x")) ** 2).sum()) / cells
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["loss"])

        with shuffles_released(self.spark):
            feature = self.nodes.select("id", "x").join(z, "id").mapInArrow(errors, "loss double").agg(F.sum("loss")).first()[0]
            structural = self._link_losses(z, latent).agg(F.sum("loss")).first()[0] or 0.0
        self.tables.drop(z)
        return self._loss(feature, structural)

    def gradient(self, weights: Weights, epoch: int = 1) -> tuple[dict[str, float], Weights]:
        """The loss's parts, and the gradient of the loss by every parameter."""
        config, tables = self.config, self.tables
        latent = _columns("z", config.latent)
        id_field = self.nodes.schema["id"]
        n, inputs = self.n, len(self.features)
        z = self._latent(weights, epoch)
        links = tables.freeze(self._links(z, latent))

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros(len(flat(weights))), 0.0
            none = [pa.nulls(1, pa.list_(pa.float64()))]
            for batch in batches:
                if not batch.num_rows:
                    continue
                zs, x, g = _matrix(batch, latent), _lists(batch, "x"), _matrix(batch, [f"g{c}" for c in latent])
                before = zs @ weights.dec1[0].T + weights.dec1[1]
                d = np.maximum(before, 0)
                error = d @ weights.dec2[0].T + weights.dec2[1] - x
                loss += float((error**2).sum()) / (n * inputs)
                dr = 2 * config.alpha * error / (n * inputs)
                dd = (dr @ weights.dec2[0]) * (before > 0)
                zero = [np.zeros_like(p) for name in ("conv1", "conv2") for p in getattr(weights, name)]
                total += np.concatenate([p.ravel() for p in (*zero, dd.T @ zs, dd.sum(0), dr.T @ d, dr.sum(0))])
                dz = dd @ weights.dec1[0] + g
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), *[pa.array(c) for c in dz.T], pa.nulls(batch.num_rows, pa.list_(pa.float64()))], ["id", "root", *latent, "sums"])
            empty = [pa.nulls(1, vectors_arrow[0]), *[pa.nulls(1, pa.float64()) for _ in ("root", *latent)]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([[loss, *total]], none[0].type)], ["id", "root", *latent, "sums"])

        from pyspark.sql.pandas.types import to_arrow_type

        vectors_arrow = [to_arrow_type(id_field.dataType)]
        held = self.nodes.select("id", "root", "x").join(z, "id").join(links.drop("loss"), "id", "left").fillna(0.0, [f"g{c}" for c in latent])
        decoded = tables.freeze(held.mapInArrow(decode, T.StructType([T.StructField("id", id_field.dataType), *[T.StructField(c, T.DoubleType()) for c in ("root", *latent)], T.StructField("sums", T.ArrayType(T.DoubleType()))])))
        back = self._spread(decoded.where("sums is null").select("id", "root", *latent), latent)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(flat(weights)))
            for batch in batches:
                if batch.num_rows:
                    m, s, slope, h = _hidden(batch, weights, epoch, config.dropout)
                    dp = _matrix(batch, latent)
                    dh = (dp @ weights.conv2[0]) * slope
                    zero = [np.zeros_like(p) for name in ("dec1", "dec2") for p in getattr(weights, name)]
                    total += np.concatenate([p.ravel() for p in (dh.T @ m, s @ dh, dp.T @ h, dp.sum(0), *zero)])
            yield pa.RecordBatch.from_arrays([pa.array([[0.0, *total]], pa.list_(pa.float64()))], ["sums"])

        encoded = self.nodes.select("id", "m", "s", "mark").join(back, "id").mapInArrow(encode, "sums array<double>")
        total = summed(decoded.where("sums is not null").select("sums").unionByName(encoded))
        structural = links.agg(F.sum("loss")).first()[0] or 0.0
        tables.drop(z, links, decoded, back)
        return self._loss(float(total[0]), structural), shaped(total[1:], weights)

    def train(self, weights: Weights | None = None, log: Callable[[dict[str, float]], None] | None = None) -> tuple[Weights, list[dict[str, float]]]:
        """Adam over all epochs: the weights, and each epoch's loss."""
        config = self.config
        like = weights or initial(len(self.features), config)
        now, first, second, history = flat(like), 0.0, 0.0, []
        for epoch in range(1, config.epochs + 1):
            loss, slope = self.gradient(shaped(now, like), epoch)
            g = flat(slope) + config.decay * now
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            now = now - config.rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
            history.append(loss | {"epoch": epoch})
            if log:
                log(history[-1])
        return shaped(now, like), history


def summed(rows: DataFrame) -> np.ndarray:
    """The sum of arrays of one length, one a task, in two levels; the driver gets as many as the root of their number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _lists(batch, "sums").sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartition(max(1, math.isqrt(tasks))).mapInArrow(add, "sums array<double>").collect()
    return np.sum([r["sums"] for r in sorted(parts, key=lambda r: r["sums"][0])], axis=0)


def calibrated(scored: DataFrame, percentile: float) -> dict[str, float]:
    """Mean, population deviation and the exact percentile of the scores."""
    row = scored.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.avg("feature_error").alias("f"), F.avg("link_error").alias("l")).first()
    return {"score_mean": row["m"], "score_std": row["s"], "threshold_percentile": percentile, "threshold": quantile(scored, "score", percentile / 100), "feature_error_mean": row["f"], "structural_error_mean": row["l"]}


def save_checkpoint(spark: SparkSession, folder: str, name: str, weights: Weights, features: list[str], config: Config, history: list[dict[str, float]], calibration: dict[str, float]) -> None:
    """One JSON file, in place of an earlier one of that name."""
    files = Files(spark, folder)
    text = json.dumps({"schema_version": SCHEMA_VERSION, "features": features, "config": asdict(config), "weights": {k: [p.tolist() for p in getattr(weights, k)] for k in LAYERS}, "history": history, "calibration": calibration})
    files.delete(name)
    files.create(name, text)


def load_checkpoint(spark: SparkSession, folder: str, name: str, features: list[str] | None = None) -> dict[str, Any]:
    """The checkpoint with its ``Weights``; a missing one, another schema or other features are an error."""
    if not Files(spark, folder).exists(name):
        raise FileNotFoundError(f"no checkpoint {folder}/{name}")
    found = json.loads(spark.read.option("wholetext", True).text(f"{folder}/{name}").first()[0])
    if found.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"unsupported checkpoint schema: {found.get('schema_version')}")
    if features is not None and found["features"] != features:
        raise ValueError("the checkpoint was trained on other features")
    config = Config(**found["config"])
    weights = Weights(*[tuple(np.array(p) for p in found["weights"][k]) for k in LAYERS])
    for name_, shape in zip(LAYERS, ((config.hidden, len(found["features"])), (config.latent, config.hidden), (config.hidden, config.latent), (len(found["features"]), config.hidden)), strict=True):
        if getattr(weights, name_)[0].shape != shape:
            raise ValueError(f"layer {name_} doesn't fit its configuration")
    return found | {"config": config, "weights": weights}


def score_graph(nodes: DataFrame, edges: DataFrame, checkpoint: dict[str, Any]) -> DataFrame:
    """id, score, feature_error, link_error, rank, is_anomaly by a loaded checkpoint; an empty graph keeps the columns."""
    config, weights, features = checkpoint["config"], checkpoint["weights"], checkpoint["features"]
    wanted = max(int(edges.count() * config.negative_ratio), nodes.count())
    found = scores(nodes, edges, features, weights, exact_non_edges(nodes, edges, wanted, config.seed), config.alpha, config.beta)
    return ranked_scores(found, checkpoint["calibration"].get("threshold", math.inf))


def scored_or_rules(issues: DataFrame, nodes: DataFrame, edges: DataFrame, folder: str, name: str, features: list[str], enabled: bool = True) -> tuple[DataFrame, str]:
    """(issues, status): issues (a_id, b_id, ...) with both ends' scores where the optional model works, else without them.

    ``disabled``: not asked for; ``degraded``: the checkpoint is missing or doesn't fit, or scoring failed, with a warning; ``scored``.
    The model never blocks what the rules found.
    """
    bare = issues.withColumns({c: F.lit(None).cast("double") for c in ("score_a", "score_b", "combined_score")})
    if not enabled:
        return bare, "disabled"
    try:
        found = score_graph(nodes, edges, load_checkpoint(issues.sparkSession, folder, name, features)).select("id", "score")
        found = Scratch(issues.sparkSession, "scores").freeze(found)  # a failure shows here, not in who reads the issues
    except Exception as e:  # whatever it is, the rules' result stands
        warnings.warn(f"anomaly scores are left out: {e}", RuntimeWarning, stacklevel=2)
        return bare, "degraded"
    out = issues
    for end in "ab":
        out = out.join(found.select(F.col("id").alias(f"{end}_id"), F.col("score").alias(f"score_{end}")), f"{end}_id", "left")
    return out.withColumn("combined_score", F.greatest("score_a", "score_b")).select(bare.columns), "scored"
