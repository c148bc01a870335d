import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from purlin.llm import lm_scoring as lm
from purlin.llm.common import id_crc
from purlin.llm.queries import op13_lm_scoring


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w] + [None]  # None: the end


def brute(rows, held, order=lm.ORDER, priors=lm.PRIORS):
    """{row: (n_tokens, n_known, N, base_score, score)} by counting n-grams in one dict."""
    seen, n = Counter(), 0
    for i, text in rows:
        if not held(i):
            own = tokens_of(text)
            n += len(own)
            padded = ["<s>", *own]
            for k in range(1, order + 1):
                for at in range(len(padded) - k + 1):
                    seen[tuple(padded[at : at + k])] += 1
    known = sum(len(g) == 1 and g != ("<s>",) for g in seen)

    def p(context, w):
        if not context:
            return (seen[w,] + priors[0]) / (n + priors[0] * (known + 1))
        k = priors[len(context)]
        return (seen[(*context, w)] + k * p(context[1:], w)) / (seen[context] + k)

    out = []
    for i, text in rows:
        own = tokens_of(text)
        padded = ["<s>", *own]
        score = sum(math.log10(p(tuple(padded[max(0, at - order + 1) : at]), padded[at])) for at in range(1, len(padded)))
        base = sum(math.log10((seen[w,] + 1) / (n + known + 1)) for w in own)
        out.append((i, held(i), len(own), sum(seen[w,] > 0 for w in own), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def collected(frame):
    return sorted(((r[0], r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in frame.collect()), key=repr)


def crc_held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False


TEXTS = ["The cat sat.", "the CAT sat.\tThe cat\x0bran", None, "", " \n ", "É é x the cat", "dog dog dog dog", "the cat sat."] + [f"the cat {w} on the {v}" for w in "abcd" for v in "xyz"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block_chars,shard_keys", [(1 << 20, 2_000_000), (30, 7)])
def test_equals_counting_in_one_dict(docs_of, order, block_chars, shard_keys):
    rows = list(enumerate(TEXTS * 2)) + [(None, "the end")]
    priors = (0.5, 5.0, 7.0, 9.0)
    got = lm.score_texts(docs_of(rows), held_out=id_crc(F.col("id")) % 7 == 2, order=order, priors=priors, block_chars=block_chars, shard_keys=shard_keys)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert collected(got) == brute(rows, crc_held, order, priors)


def test_query_over_a_table(spark, docs_of, tmp_path):
    rows = [(i, f"{TEXTS[i % len(TEXTS)] or ''} w{i % 11} w{i % 5}") for i in range(120)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert collected(op13_lm_scoring(spark, str(tmp_path))) == brute(rows, crc_held)


def test_probabilities_of_a_context_sum_to_one():
    tokens, lengths = np.array([1, 2, 1, 3, 0, 1, 1, 0]), np.array([5, 3])
    grams = lm.Grams(tokens, lengths, 4, 3)
    totals = grams.counts(np.ones(8, bool), 2)
    automaton = lm.Automaton(grams, totals, 8, 4, (1.0, 2.0, 3.0))
    number = [None, {(w,): w for w in range(4)} | {("s",): 4}]
    for k in (2, 3):
        number.append({(*{v: u for u, v in number[k - 1].items()}[c], w): j for j, (c, w) in enumerate(zip(grams.context[k].tolist(), grams.word[k].tolist()))})
    for context in [(), *number[1], *number[2]]:
        if 0 in context:  # nothing follows an end
            continue
        total = 0.0
        for w in [*range(4), None]:  # None: an unknown word
            cost, at = 0.0, context
            while True:
                weight = automaton.arc[len(at) + 1][number[len(at) + 1][(*at, w)]] if (*at, w) in number[len(at) + 1] else 1.0
                if weight <= 0 or not at:
                    break
                cost += automaton.fall[len(at)][number[len(at)][at]]
                at = at[1:]
            total += 10 ** (cost + (weight if weight <= 0 else automaton.unknown))
        assert math.isclose(total, 1.0, rel_tol=1e-9), context


def test_nothing_to_learn_from_empty_tables_and_long_texts(docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS[:4])]
    assert {r[5] for r in collected(lm.score_texts(docs_of(rows), held_out=F.lit(True)))} == {0.0}
    assert lm.score_texts(docs_of([]), held_out=F.lit(False)).collect() == []
    long = [(1, "word " * 100_000 + "end"), (2, "x" * 100_000), (2, "x" * 100_000)]
    assert collected(lm.score_texts(docs_of(long), held_out=F.lit(False), block_chars=1000)) == brute(long, lambda i: False)


def test_packed_numbers():
    for values in ([], [0], [0] * 9, [1, 255, 256], [1 << 63, 5], list(range(1000))):
        for there, back in ((lm.packed, lm.unpacked), (lm.bits, lm.unbits)):
            assert back(there(np.array(values, np.uint64))).tolist() == values


def test_distinct_numbers_and_places():
    rng = np.random.default_rng(1)
    for codes in (np.zeros(0, np.int64), np.zeros(3, np.int64), rng.integers(0, 50, 1000), rng.integers(0, 1 << 62, 100), np.array([1 << 62, 0, 1 << 62])):
        for got, wanted in zip(lm.numbered(codes), np.unique(codes, return_inverse=True), strict=True):
            assert got.tolist() == wanted.tolist()


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_all_texts_at_once_follow_the_arcs(order):
    """Each word's arc and falls, taken one word after another from the state before."""
    rng = np.random.default_rng(order)
    lengths = rng.integers(1, 9, 60)
    ends = np.cumsum(lengths) - 1
    tokens = rng.integers(1, 7, int(lengths.sum()))
    tokens[ends] = 0
    grams = lm.Grams(tokens, lengths, 7, order)
    learned = np.arange(60) % 3 > 0
    totals = grams.counts(np.repeat(learned, lengths), int(learned.sum()))
    model = lm.Automaton(grams, totals, int(lengths[learned].sum()), int(np.count_nonzero(totals[0][:7])), (1.0, 3.0, 2.0, 5.0))
    first, wanted = ends - lengths + 1, []
    for low, end in zip(first, ends, strict=True):
        total, before, k = 0.0, model.start, len(model.start) + 1
        for i in range(low, end + 1):
            now = [at[i] for at in grams.at[1:]]
            while model.arc[k][now[k - 1]] > 0.0 and k > 1:
                k -= 1
                total += model.fall[k][before[k - 1]]
            weight = model.arc[k][now[k - 1]]
            total += model.unknown if weight > 0.0 else weight
            k = min(k + (weight <= 0.0), order)
            before = now
        wanted.append(total)
    assert np.allclose(model.scores(grams.at, first), wanted, rtol=1e-12)
