import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from purlin.operators import anomaly_training as at

N, INPUTS = 9, 3
EDGES = [(0, 1), (1, 2), (1, 2), (3, 4), (4, 5), (0, 5), (5, 6), (7, 8)]
NEGATIVE = [(0, 4), (2, 6), (8, 1)]
CONFIG = at.Config(hidden=4, latent=2, dropout=0.0, epochs=4, rate=0.05)
X = np.random.default_rng(3).normal(size=(N, INPUTS))
FEATURES = ["f0", "f1", "f2"]


def frames(spark):
    nodes = spark.createDataFrame([(f"n{i}", *map(float, X[i])) for i in range(N)], "id string, f0 double, f1 double, f2 double").repartition(3)
    pairs = lambda rows: spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in rows], "source_id string, target_id string").repartition(2)
    return nodes, pairs(EDGES), pairs(NEGATIVE)


def loss_of(w, alpha=0.7, beta=0.3):
    """The loss in plain numpy, over whole matrices."""
    a = np.eye(N)
    for i, j in EDGES:
        a[i, j] += 1
        a[j, i] += 1
    a /= np.sqrt(np.outer(a.sum(1), a.sum(1)))
    z = a @ (np.maximum(a @ (X @ w.conv1[0].T + w.conv1[1]), 0) @ w.conv2[0].T + w.conv2[1])
    back = np.maximum(z @ w.dec1[0].T + w.dec1[1], 0) @ w.dec2[0].T + w.dec2[1]
    terms = []
    for pairs, y in ((EDGES, 1), (NEGATIVE, 0)):
        logits = np.array([z[i] @ z[j] for i, j in pairs]) / math.sqrt(z.shape[1])
        terms.append(np.mean(np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))))
    return alpha * ((back - X) ** 2).mean() + beta * np.mean(terms)


def test_gradient_equals_finite_differences(spark):
    nodes, edges, negatives = frames(spark)
    trainer = at.Trainer(nodes, edges, FEATURES, CONFIG, negatives)
    weights = at.initial(INPUTS, CONFIG)
    loss, slope = trainer.gradient(weights)
    assert math.isclose(loss["loss"], loss_of(weights), rel_tol=1e-9)
    now, step = at.flat(weights), 1e-6
    for i, g in enumerate(at.flat(slope)):
        up, down = now.copy(), now.copy()
        up[i] += step
        down[i] -= step
        assert math.isclose(g, (loss_of(at.shaped(up, weights)) - loss_of(at.shaped(down, weights))) / (2 * step), rel_tol=1e-4, abs_tol=1e-7)


def test_loss_alone_leaves_no_shuffle_files_of_the_edges(spark):
    """The loss is the gradient's; edges are stored once, and no write leaves its shuffles."""
    from purlin.sources.store import CLEANUP

    before, written = spark.conf.get(CLEANUP, "false"), []
    trainer = at.Trainer(*frames(spark)[:2], FEATURES, CONFIG, frames(spark)[2])
    freeze = trainer.tables.freeze
    trainer.tables.freeze = lambda frame: written.append(frame) or freeze(frame)
    weights = at.initial(INPUTS, CONFIG)
    loss = trainer.loss(weights)
    assert math.isclose(loss["loss"], loss_of(weights), rel_tol=1e-9) and len(written) == 4  # sent, each direction, the sums
    assert trainer.gradient(weights)[0].keys() == loss.keys() and math.isclose(trainer.gradient(weights)[0]["loss"], loss["loss"], rel_tol=1e-12)
    assert spark.conf.get(CLEANUP, "false") == before


def test_training_lowers_the_loss_and_is_repeatable(spark, tmp_path):
    nodes, edges, _ = frames(spark)
    config = at.Config(hidden=4, latent=2, dropout=0.1, epochs=4, rate=0.05)
    runs = [at.Trainer(nodes.repartition(k), edges, FEATURES, config).train() for k in (1, 3)]
    assert np.allclose(at.flat(runs[0][0]), at.flat(runs[1][0]), atol=1e-12)
    history = runs[0][1]
    assert [h["epoch"] for h in history] == [1, 2, 3, 4] and loss_of(runs[0][0]) < loss_of(at.initial(INPUTS, config))

    at.save_checkpoint(spark, f"{tmp_path}", "m.json", runs[0][0], FEATURES, config, history, {"threshold": 0.0})
    found = at.load_checkpoint(spark, f"{tmp_path}", "m.json", FEATURES)
    assert np.array_equal(at.flat(found["weights"]), at.flat(runs[0][0])) and found["config"] == config
    scored = at.score_graph(nodes, edges, found)
    rows = scored.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, N + 1)) and all(r.is_anomaly for r in rows)
    numbers = at.calibrated(scored, 50.0)
    assert math.isclose(numbers["threshold"], float(np.median([r.score for r in rows]))) and math.isclose(numbers["score_mean"], float(np.mean([r.score for r in rows])))

    issues = spark.createDataFrame([("n0", "n1", "CLASH"), ("n2", "elsewhere", "CLASH")], "a_id string, b_id string, issue string")
    out, status = at.scored_or_rules(issues, nodes, edges, f"{tmp_path}", "m.json", FEATURES)
    by = {r.id: r.score for r in rows}
    got = {r.a_id: r for r in out.collect()}
    assert status == "scored" and got["n0"].combined_score == max(by["n0"], by["n1"]) and got["n2"].score_b is None
    for features, name in ((["f0"], "m.json"), (FEATURES, "none.json")):
        with pytest.warns(RuntimeWarning):
            out, status = at.scored_or_rules(issues, nodes, edges, f"{tmp_path}", name, features)
        assert status == "degraded" and out.count() == 2 and out.where("combined_score is not null").isEmpty()
    with pytest.warns(RuntimeWarning):
        _, status = at.scored_or_rules(issues, nodes.drop("f2"), edges, f"{tmp_path}", "m.json", FEATURES)
    assert status == "degraded"
    assert at.scored_or_rules(issues, nodes, edges, f"{tmp_path}", "m.json", FEATURES, enabled=False)[1] == "disabled"


@pytest.mark.parametrize("wanted", [0, 5, 20, 52, 57, 1000])
def test_exact_number_of_non_edges(spark, wanted):
    nodes, edges, _ = frames(spark)
    got = [tuple(r) for r in at.exact_non_edges(nodes, edges, wanted).collect()]
    linked = {(f"n{a}", f"n{b}") for a, b in EDGES} | {(f"n{b}", f"n{a}") for a, b in EDGES}
    assert len(got) == len(set(got)) == min(wanted, N * (N - 1) - len(linked))
    assert not linked & set(got) and all(a != b for a, b in got)
    assert sorted(got) == sorted(tuple(r) for r in at.exact_non_edges(nodes.repartition(2), edges, wanted).collect())


def test_empty_graph(spark):
    nodes, edges, _ = frames(spark)
    with pytest.raises(ValueError):
        at.Trainer(nodes.where("false"), edges.where("false"), FEATURES, CONFIG)
    assert at.exact_non_edges(nodes.where(F.col("id") == "n0"), edges.where("false"), 5).count() == 0
