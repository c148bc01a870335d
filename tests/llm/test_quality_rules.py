import math
import re
from collections import Counter

import pytest

from purlin.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [None, "", " \t\n", "a b c d e f g h i j k", "x y z v w " * 3 + "tail", "a a a a a a a a a a a a", "line one\nline one\n\n  \nline two\nline one ", "# * $ % & | < > é #", "word " * 30_000, "a\x0bb\x0cc\rd e f", "one two three four five one two three four five six"]


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_equal_brute_force(spark, docs_of):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in q.quality_rules(docs_of(rows), labels_of(spark, [])).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert r.kept == (not r.base_failed)
    assert q.quality_rules(docs_of([]), labels_of(spark, [])).collect() == []


def test_binomial_tail_and_bound():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (7, 7, 0.5)):
        assert q.binomial_tail(n, k, p) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))
    n = q.least_good(0.01, 0.05)
    assert 0.99**n <= 0.05 < 0.99 ** (n - 1)


def test_cutoffs_limit_false_rejection(spark, docs_of):
    fine = " ".join(f"word{k}" for k in range(30))
    bad = " ".join(f"word{k}###" for k in range(30))
    rows = [(i, fine.replace("word1 ", f"w{i} ") if i % 5 else bad.replace("word1#", f"w{i}#")) for i in range(4000)]
    measured = q.freeze(q.measures(docs_of(rows), "doc_id", "text", "lang"), "t")
    labels = labels_of(spark, [(i, int(i % 5 > 0), 0) for i in range(0, 4000)])
    cutoffs = q.calibrate(measured, labels)
    assert cutoffs["en"] and set(cutoffs["en"]) <= {"symbols", "long_words"}  # three symbols a word make the words longer too
    got = q.apply_rules(measured, cutoffs).collect()
    assert all(r.kept == bool(r["__id"] % 5) for r in got)
    # too few labelled texts: no guarantee, so nothing but the base rules rejects
    few = q.calibrate(measured, labels.where("doc_id < 150"))
    assert all(not rules for rules in few.values())


def test_fixed_sequence_stops_at_the_first_failure():
    assert q.choose_step([0, 500, 0, 5000], [40, 60, 9, 1], 0.003, 0.01) == 0  # the next would reject 500 good texts
    assert q.choose_step([0, 0, 0, 5000], [40, 60, 0, 1], 0.003, 0.01) == 1  # the third catches no more
    assert q.choose_step([0, 0, 0, 5000], [0, 0, 0, 9], 0.003, 0.01) is None
    assert q.choose_step([0, 100], [5, 5], 0.02, 0.05) is None and q.choose_step([0, 200], [5, 5], 0.02, 0.05) == 0


def test_path_tightens_one_rule_at_a_time():
    top = len(q.GRID)
    good, bad = ({rule: [0] * (top + 1) for rule in q.RULES} for _ in "ab")
    bad["symbols"][top], bad["symbols"][3], good["symbols"][3] = 10, 5, 50
    bad["shouts"][7], good["shouts"][7], good["shouts"][9] = 20, 1, 2
    path = q.path_of(good, bad)
    assert path == [("symbols", 0), ("shouts", top - 7), ("symbols", top - 3)]
    table = {rule: q._first_steps(path, rule) for rule in q.RULES}
    assert table["symbols"] == [3, 3, 3, *[2] * (top - 3), 0] and table["shouts"] == [3] * 7 + [1] * (top - 6)


def test_rejected_good_texts_stay_within_alpha(spark, docs_of):
    """The guarantee, counted: draws of labelled rows where every measure is noise; the share of draws whose cutoffs reject
    more than ALPHA of all good texts is small."""
    import random

    rng = random.Random(6)
    broken = draws = 0
    for _ in range(200):
        top = len(q.GRID)
        marks = lambda n: [min(rng.randrange(top), rng.randrange(top)) for _ in range(n)]
        rows = {1: marks(300), 0: marks(60)}
        counts = {y: {rule: [0] * (top + 1) for rule in q.RULES} for y in (1, 0)}
        for y in (1, 0):
            for above in rows[y][: len(rows[y]) // 4]:
                counts[y]["symbols"][above] += 1
        path = q.path_of(counts[1], counts[0])
        table = q._first_steps(path, "symbols")
        tested = {y: [0] * (len(path) + 1) for y in (1, 0)}
        for y in (1, 0):
            for above in rows[y][len(rows[y]) // 4 :]:
                tested[y][table[above]] += 1
        j = q.choose_step(tested[1], tested[0], q.ALPHA, q.DELTA)
        if j is not None:
            draws += 1
            lowest = top - path[j][1]
            share = ((top - lowest) / top) ** 2  # of good texts above at least ``lowest`` cutoffs
            broken += share > q.ALPHA
    assert broken <= 0.05 * 200


def test_plan_has_no_python(spark, docs_of):
    plan = q.measures(docs_of([(1, "a")], partitions=1), "doc_id", "text", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_strata_are_chosen_at_the_level_they_are_tested_at(spark, docs_of):
    for sizes in ([("en", 150)], [("en", 230), ("de", 205)], [(f"l{i:02}", 450 - 3 * i) for i in range(64)]):
        strata = q.own_strata(sizes, q.ALPHA, q.DELTA)
        level = q.DELTA / (len(strata) + 1)
        assert all(q.binomial_tail(n, 0, q.ALPHA) <= level for lang, n in sizes if lang in strata)
        rest = sizes[len(strata) :]
        assert not rest or q.binomial_tail(rest[0][1], 0, q.ALPHA) > q.DELTA / (len(strata) + 2)
    fine = " ".join(f"word{k}" for k in range(12))
    bad = " ".join(f"word{k}###" for k in range(12))
    rows = [(i, bad if i >= 260 else fine, "en" if i < 130 or i >= 280 else "de") for i in range(300)]
    measured = q.freeze(q.measures(docs_of([(i, t, g, "s") for i, t, g in rows]), "doc_id", "text", "lang"), "t")
    cutoffs = q.calibrate(measured, labels_of(spark, [(i, int(i < 260), 0) for i in range(300)]))
    assert cutoffs[q.POOLED] and "en" not in cutoffs  # 130 good texts each: enough together
    assert all(r.kept == (r["__id"] < 260) for r in q.apply_rules(measured, cutoffs).collect())


def test_repeated_rows_null_ids_and_clashing_names(spark, docs_of):
    docs = docs_of([(1, "a b c"), (1, "a b c"), (None, "x " * 12), (2, " ".join(f"w{k}" for k in range(20)))])
    docs = docs.withColumn("n_words", docs.doc_id).withColumn("rule", docs.text)
    labels = labels_of(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)])
    got = sorted(((r.doc_id, r.n_words, r.kept) for r in q.quality_rules(docs, labels).collect()), key=repr)
    assert got == sorted([(1, 3, False), (1, 3, False), (None, 12, False), (2, 20, True)], key=repr)
