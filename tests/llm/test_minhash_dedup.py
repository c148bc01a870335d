import random
from collections import Counter

import numpy as np
import pytest

from purlin.llm import minhash_dedup as m
from purlin.llm.components import components


def kmers(text):
    return m.shingles(m.word_hashes()(text)[0])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    a, b = kmers(a).tolist(), kmers(b).tolist()
    if not a or not b:
        return float(len(a) == len(b))
    c = lcs(a, b)
    return c / (len(a) + len(b) - c)


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"new{rng.random()}" if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append("in")
    return out


def test_alignment_equals_plain_lcs_where_similar():
    rng = random.Random(4)
    for n in (1, 4, 5, 9, 60, 200):
        for share in (0, 0.01, 0.03, 0.08, 0.5):
            words = [f"w{rng.randrange(30 if n > 100 else 500)}" for _ in range(n)]
            a, b = " ".join(words), " ".join(edited(rng, words, share))
            got, want = m.aligned(kmers(a), kmers(b)), similarity(a, b)
            assert got <= want + 1e-12
            if want >= m.SIMILAR:
                assert got == pytest.approx(want)


def test_labelled_occurrences_are_distinct():
    x = np.array([5, 7, 5, 5, 7, 9], np.uint64)
    got = m.labelled(x)
    assert len(set(got.tolist())) == 6 and got[0] == 5 and got[1] == 7
    assert np.array_equal(np.sort(got), np.sort(m.labelled(x[::-1].copy())))


def corpus(seed, groups=25, each=6):
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 12, 18, 40, 150, 400]))]
        shared = [f"common{k}" for k in range(12)]
        for k in range(each):
            text = edited(rng, words, rng.choice([0, 0, 0.01, 0.02, 0.05, 0.2]))
            rows.append((n, " ".join(text + shared if k % 2 else text)))
            n += 1
    rows += [(n, None), (n + 1, "  "), (n + 2, "Word"), (n + 3, "word "), (n + 4, "a b c " * 3000), (n + 5, "a b c " * 3000 + "d")]
    return rows


def brute(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            s_, t_ = (s or "").lower().split(), (t or "").lower().split()
            if s_ == t_:
                near = True
            elif min(len(s_), len(t_)) < 0.7 * max(len(s_), len(t_)):
                near = False
            elif len(s_) > 2000:
                near = m.aligned(kmers(s), kmers(t)) >= m.SIMILAR
            else:
                near = similarity(s or "", t or "") >= m.SIMILAR
            if near:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force(docs_of):
    rows = corpus(7)
    classes, links = m.near_duplicates(docs_of(rows))
    got = {r.doc_id: r.class_id for r in classes.collect()}
    assert got == brute(rows)
    assert all(r.similarity >= m.SIMILAR for r in links.collect())


def test_large_group_of_near_copies(docs_of):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(edited(rng, words, 0.01))) for i in range(150)] + [(900 + i, f"other text number {i} with some words") for i in range(30)]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(docs_of(rows))[0].collect()}
    assert got == brute(rows)
    assert Counter(got.values()).most_common(1)[0][1] > 100


def test_null_ids_repeated_rows_and_empty(docs_of):
    text = "one two three four five six seven eight"
    got = m.near_duplicates(docs_of([(None, text), (5, text), (5, text), (6, text)]))[0].collect()
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in got), key=repr) == sorted([(None, None, True), (5, 5, True), (5, 5, True), (6, 5, False)], key=repr)
    assert m.near_duplicates(docs_of([]))[0].collect() == []


def test_drop_near_copies(docs_of):
    docs = docs_of([(3, "a b c d e f g h i j k l m n o p q r s t u v w x y"), (1, "a b c d e f g h i j k l m n o p q r s t u v w x z"), (2, "something else")])
    kept = m.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 502)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 502: 500}
