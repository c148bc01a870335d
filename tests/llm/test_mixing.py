import numpy as np

from purlin.llm import mixing
from purlin.llm.mixing import mix, rake, sample_mix


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    index = [np.repeat([0, 1, 2], 8), np.tile(np.repeat([0, 1], 4), 3), np.tile([0, 1, 2, 3], 6)]
    tokens = rng.uniform(50, 500, 24)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.25] * 4)]
    budget = 0.2 * tokens.sum()
    weight = rake(tokens, index, targets, budget)
    for at, target in zip(index, targets, strict=True):
        assert np.allclose(np.bincount(at, weight) / budget, target, atol=1e-6)
    # brute force: plain loops give the same weights
    slow = tokens * 0.2
    for _ in range(400):
        for at, target in zip(index, targets, strict=True):
            for k, t in enumerate(target):
                slow[at == k] *= t * budget / slow[at == k].sum()
    assert np.allclose(weight, slow)


def test_rake_never_exceeds_what_exists():
    weight = rake(np.array([10.0, 1000.0]), [np.array([0, 1])], [np.array([0.5, 0.5])], 600.0)
    assert weight[0] == 10.0 and weight[1] <= 1000


def test_probabilities_and_edges(docs_of):
    rows = [(i, f"word{i} longerword{i % 9} anotherword" * (1 + i % 5), ("en", "de", None)[i % 3], f"s{min(i % 7, 3)}") for i in range(600)]
    rows += [(1000, None, "en", "s0"), (None, "x y", "en", None), (1001, "", "xx", "s9")]
    got = mix(docs_of(rows), keep_fraction=0.5).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.probability <= 1 for r in got)
    cells = {}
    for r in got:
        cells.setdefault((r.source, r.lang, r.topic), set()).add(round(r.probability, 12))
    assert all(len(v) == 1 for v in cells.values())
    expected = sum(r.n_tokens * r.probability for r in got)
    assert abs(expected / sum(r.n_tokens for r in got) - 0.5) < 0.02
    assert mix(docs_of([])).collect() == []


def test_targets_and_sample(docs_of):
    docs = docs_of([(i, "aaa bbb ccc ddd", "en", "a" if i % 4 else "b") for i in range(2000)])
    got = mix(docs, keep_fraction=0.3, targets={"source": {"a": 0.5, "b": 0.5}}).collect()
    share = {s: sum(r.n_tokens * r.probability for r in got if r.source == s) for s in "ab"}
    assert abs(share["a"] / sum(share.values()) - 0.5) < 1e-6
    kept = sample_mix(docs, keep_fraction=0.3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in mix(docs, keep_fraction=0.3).collect() if r.sampled}


def tail_rows():
    """One language and one source with most of the tokens, forty of each with one per cent or less."""
    text = " ".join(f"word{k}" for k in range(20))
    rows = [(i, text, "big", "hot") for i in range(600)]
    return rows + [(1000 + i, text, f"l{i % 40:02}", f"s{i % 40:02}") for i in range(400)]


def test_small_categories_have_marginals_of_their_own(docs_of):
    got = mix(docs_of(tail_rows()), keep_fraction=0.1).collect()
    kept = {g: sum(r.n_tokens * r.probability for r in got if r.lang == g) for g in {r.lang for r in got}}
    small = sum(v for g, v in kept.items() if g != "big") / sum(kept.values())
    assert abs(small - 40 * 0.1 / (40 * 0.1 + 0.6**0.5)) < 1e-6  # 84 %, not the 45 % of one pooled language
    given = {"lang": {"big": 0.5, "l07": 0.3, "l08": 0.2}, "source": {"hot": 0.5, "s07": 0.3, "s08": 0.2}}
    got = mix(docs_of(tail_rows()), keep_fraction=0.01, targets=given).collect()
    kept = {g: sum(r.n_tokens * r.probability for r in got if r.lang == g) for g in {r.lang for r in got}}
    assert all(abs(kept[g] / sum(kept.values()) - given["lang"].get(g, 0)) < 1e-6 for g in kept)


def test_raking_by_joins_gives_the_same_weights(spark):
    rng = np.random.default_rng(4)
    cells = [(s, g, t, int(rng.integers(5, 900))) for s in ("a", "b", "c") for g in ("en", "") for t in range(3) if rng.random() > 0.2]
    frame = spark.createDataFrame(cells, "s string, l string, t_ int, t long")
    tokens = np.array([c[3] for c in cells], float)
    for given in ({}, {"source": {"a": 0.6, "b": 0.3, "c": 0.1}}):
        axes = [sorted({c[i] for c in cells}) for i in range(3)]
        index = [np.array([axes[i].index(c[i]) for c in cells]) for i in range(3)]
        shares = []
        for axis, at, kind in zip(axes, index, ("source", "lang", "topic"), strict=True):
            goal = np.array([given[kind][k] for k in axis]) if kind in given else np.sqrt(np.bincount(at, tokens))
            shares.append(goal / goal.sum())
        want = rake(tokens, index, shares, 0.2 * tokens.sum(), rounds=4)
        got = {(r.s, r.l, r.t_): r.w for r in mixing.rake_cells(frame, given, 0.2, rounds=4).collect()}
        assert all(abs(got[c[:3]] - w) < 1e-6 * w for c, w in zip(cells, want, strict=True))


def test_many_cells_go_by_joins(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "rake_cells", lambda cells, given, keep: cells.selectExpr("s", "l", "t_", "cast(t as double) as w", "1.0D as p"))
    got = mix(docs_of([(1, "a b"), (2, "c")])).collect()
    assert [r.probability for r in got] == [1.0, 1.0]


def test_repeated_rows_long_texts_and_clashing_names(docs_of):
    rows = [(i, f"word{i} anotherword{i % 3}") for i in range(40)] + [(1, "word1 anotherword1"), (None, "a b"), (None, "a b"), (50, "longest " * 100_000)]
    docs = docs_of(rows)
    docs = docs.withColumns({c: docs.doc_id for c in ("topic", "n_tokens", "weight", "probability", "sampled", "__topic", "s", "t")})
    got = mix(docs, keep_fraction=0.5)
    assert got.columns == [*docs.columns, *[f"mix_{c}" for c in ("topic", "n_tokens", "weight", "probability", "sampled")]]
    found = got.collect()
    assert len(found) == len(rows) and max(r.mix_n_tokens for r in found) == 100_000
    assert len({r.mix_sampled for r in found if r.doc_id == 1}) == 1 and len({r.mix_sampled for r in found if r.doc_id is None}) == 1
    assert sample_mix(docs).columns == docs.columns
    # brute force: topics and draws, from the same cells
    cells = {}
    for r in found:
        key = ((r.source or ""), (r.lang or ""), r.mix_topic)
        cells[key] = cells.get(key, 0) + r.mix_n_tokens
    order = sorted(cells)
    tokens = np.array([cells[k] for k in order], float)
    axes = [sorted({k[i] for k in order}) for i in range(3)]
    index = [np.array([axes[i].index(k[i]) for k in order]) for i in range(3)]
    shares = [np.sqrt(np.bincount(at, tokens)) for at in index]
    weight = rake(tokens, index, [s / s.sum() for s in shares], 0.5 * tokens.sum())
    for r in found:
        assert abs(r.mix_probability - (weight / tokens)[order.index(((r.source or ""), (r.lang or ""), r.mix_topic))]) < 1e-9
