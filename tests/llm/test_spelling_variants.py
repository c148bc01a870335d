import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from purlin.llm import spelling_variants as sv
from purlin.llm.queries import op11_spelling_variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else 0) for w in counts)


def collected(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def made_up(seed, n, letters="abÿ", sizes=(7, 8, 9, 10)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)}
    return {w: rng.choice([2, 2, 3, 25, 400, 5000]) for w in sorted(words)}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 5, "shard_chars": 300}])
def test_equals_comparing_all_pairs(spark, sizes):
    counts = made_up(3, 700) | {"aaaaaaa": 2, "aaaaaaaa": 30, "aaaaaaaaa": 300, "baaaaaaa": 30}
    assert collected(sv.group_variants(frame(spark, counts), **sizes)) == brute(counts)


def test_long_words_and_few_words(spark):
    long = "x" * 300 + "y" * 200
    counts = {long: 2, long + "z": 30, long[:77] + "q" + long[77:]: 4, long[:-1] + "k": 2, "abcdefg": 2, "abcdefh": 20}
    assert collected(sv.group_variants(frame(spark, counts), bucket_rows=2)) == brute(counts)
    assert collected(sv.group_variants(frame(spark, {"abcdefg": 2}))) == [("abcdefg", "", "abcdefg", 2, 0, 0)]
    assert collected(sv.group_variants(frame(spark, {}))) == []


def test_chains_of_forms(spark):
    counts = {"aaaaaaa"[:i] + "bbbbbbbbb"[i:]: 2 * 10**i for i in range(7)}
    got = collected(sv.group_variants(frame(spark, counts)))
    assert got == brute(counts) and len({r[2] for r in got}) == 1


def words_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    words = [w.upper() if i % 5 == 0 else w for i, w in enumerate(made_up(8, 120, "aeéÀ", (6, 7, 8)))]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words[: 20 if i % 2 else 120], k=30)) + "x×÷1") for i in range(150)]
    rows += [(None, words[0] * 3), (7, None), (8, ""), (9, "Ab" * 30_000 + " 12 " + "Ab" * 30_000)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(words_of(rows))
    assert len(want) > 100 and any(r[1] for r in want)
    assert collected(op11_spelling_variants(spark, str(tmp_path))) == want


def test_empty_documents(spark, docs_of):
    assert sv.variants_of(docs_of([])).collect() == []


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        b, e, low, high = (rng.integers(0, n + 1, 50) for _ in range(4))
        which, value = sv.WaveletTree(values).report(b, e, low, high)
        got = sorted(zip(which.tolist(), value.tolist()))
        want = sorted((q, int(v)) for q in range(50) for v in values[b[q] : e[q]] if low[q] <= v < high[q])
        assert got == want
