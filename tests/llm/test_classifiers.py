import random
import zlib

import numpy as np

from purlin.llm import language_id as lid
from purlin.llm import quality_classifier as qc
from purlin.llm import toxicity as tox
from purlin.llm.language_id import LanguageModel, forward_backward, identify_languages
from purlin.llm.quality_classifier import SubwordModel, classify_quality, keep_quality, subwords
from purlin.llm.toxicity import IDENTITY_GROUPS, ToxicityModel, classify_toxicity

rng = random.Random(5)
GOOD = [f"w{k}or" for k in range(60)]


def good(n=40):
    return " ".join(rng.choice(GOOD) for _ in range(n))


def junk(n=40):
    return " ".join(rng.choice(GOOD).upper() + "!!" for _ in range(n))


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def test_quality_learns_and_reports(spark, docs_of):
    rows = [(i, good() if i % 4 else junk()) for i in range(240)] + [(900, None), (901, ""), (902, "x" * 30_000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify_quality(docs_of(rows), labels).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == held(i, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    test = [i for i in range(240) if held(i, 5, 0)]
    assert np.mean([got[i].predicted == int(i % 4 > 0) for i in test]) > 0.95
    docs = docs_of(rows)
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_score_is_the_softmax_of_the_average():
    texts, y = [good(20) for _ in range(30)] + [junk(20) for _ in range(30)], [1] * 30 + [0] * 30
    model = SubwordModel.fit(texts, y, 0.0, epochs=2)
    text = "w1or w1or w2or W9OR!!"
    parts = [np.mean([model.contribution[b] for b in subwords(w)]) for w in text.split()] + [model.contribution[qc.SAME]]
    z = model.intercept + np.mean(parts)
    assert abs(model.scorer()([text])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_labels_are_never_used(spark, docs_of):
    rows = [(i, good() if i % 4 else junk()) for i in range(160)]
    base = [(i, int(i % 4 > 0), 0) for i in range(160)]
    flipped = [(i, 1 - q if held(i, 5, 0) else q, t) for i, q, t in base]
    one, two = (classify_quality(docs_of(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (base, flipped))
    assert sorted(one.collect()) == sorted(two.collect())


def test_without_labels_of_both_classes(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "a b"), (2, None)]
    assert {r.score for r in classify_quality(docs_of(rows), labels).collect()} == {0.5}
    assert {r.score for r in classify_toxicity(docs_of(rows), labels).collect()} == {0.5}
    assert classify_quality(docs_of([]), labels).collect() == []


def test_toxicity_learns_stems_and_ignores_identity_terms(spark, docs_of):
    def toxic(k):
        words = good(60).split()
        for _ in range(4):
            words[rng.randrange(60)] = "slurro" + rng.choice(["ab", "cd", "ef", "gh", "ij"])
        return " ".join(words)

    rows = [(i, toxic(i) if i % 3 == 0 else good(60)) for i in range(420)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(420)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify_toxicity(docs_of(rows), labels).collect()}
    test = [i for i in rows if held(i[0], 3, 1)]
    assert all(r.held_out == held(i, 3, 1) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i, _ in test]) > 0.95


def test_counterfactual_penalty_takes_weight_off_identity_terms():
    def text(bad):
        words = good(30).split()
        if bad:
            words[3] = "scumly"
            words[9] = "women"  # goes with the label in this sample
        return " ".join(words)

    texts, y = [text(i % 2) for i in range(200)], [i % 2 for i in range(200)]
    plain = ToxicityModel.fit(texts, y, 0.0, fairness=0.0).scorer()
    fair = ToxicityModel.fit(texts, y, 0.0, fairness=1.0).scorer()
    base = good(28)
    neutral = [base + f" {t} met" for t in IDENTITY_GROUPS[0]]
    spread = [max(s(neutral)) - min(s(neutral)) for s in (plain, fair)]
    assert spread[1] < spread[0] / 2
    # not even the whole group raises the score, nor do other groups
    assert all(s <= fair([base + " they met"])[0] + 0.02 for s in fair(neutral + [base + f" {g[0]} met" for g in IDENTITY_GROUPS]))
    assert fair([base + " scumly"])[0] > 0.5


def test_penalty_is_the_change_of_the_swapped_sentences_score():
    texts, y = [good(20) + (" scumly women and muslims" if i % 2 else " men") for i in range(60)], [i % 2 for i in range(60)]
    sample = tox._Sample(texts)
    n = sample.lengths[1]
    counts, none = sample.words[1], np.zeros(len(sample.names), bool)
    other = sample.counterfactual(counts, np.random.default_rng(1), none)
    plain = lambda ws: sorted((sample.names[i], k) for i, k in zip(*ws, strict=True) if sample.names[i] not in tox.GROUP_OF)
    terms = lambda ws: {sample.names[i]: int(k) for i, k in zip(*ws, strict=True) if sample.names[i] in tox.GROUP_OF}
    assert plain(counts) == plain(other) and set(terms(counts)) == {"women", "muslims"}
    assert sum(terms(other).values()) == 2 and {id(tox.GROUP_OF[w]) for w in terms(other)} == {id(tox.GROUP_OF[w]) for w in ("women", "muslims")}
    g = np.random.default_rng(2)
    theta = g.uniform(0, 1, tox.BUCKETS)
    a, b = sample.vector(counts, n), sample.vector(other, n)
    at, delta = tox.difference(a, b)
    value, slope = tox.penalty(theta, at, delta)
    change = a[1] @ theta[a[0]] - b[1] @ theta[b[0]]  # of the log odds of the two sentences
    assert abs(value - change**2 / 2) < 1e-9
    for k in range(len(at)):
        moved = []
        for step in (1e-5, -1e-5):
            near = theta.copy()
            near[at[k]] += step
            moved.append((a[1] @ near[a[0]] - b[1] @ near[b[0]]) ** 2 / 2)
        assert abs((moved[0] - moved[1]) / 2e-5 - slope[k]) < 1e-4
    # a text without terms: one of its words without weight gives place to a term
    neutral = tox._Sample(["one two two three", ""])
    got = neutral.counterfactual(neutral.words[0], np.random.default_rng(3), np.ones(len(neutral.names), bool))
    assert got[1].sum() == 4 and sum(k for i, k in zip(*got, strict=True) if i < neutral.terms) == 1
    assert neutral.counterfactual(neutral.words[0], np.random.default_rng(3), np.zeros(len(neutral.names), bool)) is None
    assert neutral.counterfactual(neutral.words[1], np.random.default_rng(3), np.ones(len(neutral.names), bool)) is None


def test_toxicity_score_equals_brute_force():
    texts, y = [good(20) + (" scumly slurs!" if i % 3 == 0 else "") for i in range(120)], [int(i % 3 == 0) for i in range(120)]
    model = ToxicityModel.fit(texts, y, 0.0, epochs=5)
    for text in [texts[0], texts[1], "", "scumly scumly Scumly, slurs", "a" * 9000 + "scumly"]:
        times = tox.Counter(b for w in text.split() for b in tox.features(w).tolist())
        n = len(text.split())
        z = model.intercept + sum(np.log1p(tox.RATE * k / (n + tox.DAMP)) * model.weights[b] for b, k in times.items())
        assert abs(model.scorer()(["other words", text])[1] - 1 / (1 + np.exp(-z))) < 1e-9


def test_word_tables_emptied_between_blocks_change_nothing(monkeypatch):
    texts, y = [good(20) + (" scumly" if i % 2 else "") for i in range(80)] + ["", "x " * 50], [i % 2 for i in range(80)] + [0, 1]
    models = SubwordModel.fit(texts, y, 0.0, epochs=2), ToxicityModel.fit(texts, y, 0.0, epochs=3)
    want = [m.scorer()(texts) for m in models]
    from purlin.llm import wordparts

    monkeypatch.setattr(wordparts.WordTable.__init__, "__defaults__", (3, 10))
    monkeypatch.setattr(wordparts.blocks, "__defaults__", (50,))
    monkeypatch.setattr(wordparts, "SLICE", 7)
    for m, scores in zip(models, want, strict=True):
        assert np.allclose(m.scorer()(texts), scores, atol=1e-12)


def test_edges_of_the_classifiers(spark, docs_of):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, "x" * 200_000), (4, "word " * 60_000)]
    docs = docs_of(rows)
    docs = docs.withColumns({"held_out": docs.doc_id, "predicted": docs.doc_id, "__text": docs.text, "__y": docs.doc_id, "lang_pred": docs.text, "found": docs.text})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)] * 2 + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for run in (lambda d: classify_quality(d, labels), lambda d: classify_toxicity(d, labels), identify_languages):
        got = run(docs).collect()
        assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert len({tuple(r[1:]) for r in got if r.doc_id == 1}) == 1
        assert run(docs.where("false")).collect() == []
    assert keep_quality(docs, labels, threshold=0.0).columns == docs.columns


def brute_marginals(emission, transition):
    steps, labels = emission.shape
    total = np.zeros((steps, labels))
    for path in np.ndindex(*[labels] * steps):
        p = np.exp(sum(emission[t, k] for t, k in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, k in enumerate(path):
            total[t, k] += p
    return total / total[0].sum()


def test_forward_backward_equals_enumeration():
    g = np.random.default_rng(2)
    emission, transition = g.normal(size=(3, 5, 3)), g.normal(size=(3, 3))
    inside = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    got, _ = forward_backward(np.where(inside[..., None], emission, 0), inside, transition)
    for c, n in enumerate((5, 3, 1)):
        assert np.allclose(got[c, :n], brute_marginals(emission[c, :n], transition))


def words_of(lang, n=30):
    ends = {"en": ["ing", "the", "tion"], "de": ["ung", "sch", "keit"], "fr": ["eau", "que", "ère"]}[lang]
    return " ".join(rng.choice("abcdefg") + rng.choice(ends) for _ in range(n))


def test_languages(docs_of):
    rows = [(i, words_of(g), g) for i in range(240) for g in [("en", "de", "fr")[i % 3]]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, words_of("de"), None)]
    got = {r.doc_id: r for r in identify_languages(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].lang_pred == g for i, _, g in rows if g and i < 900]) > 0.97
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de"
    assert {r.lang_pred for r in identify_languages(docs_of([(1, "a", None), (2, "b", None)])).collect()} == {"und"}
    assert identify_languages(docs_of([])).collect() == []


def test_code_switched_words_get_their_own_labels():
    texts, labels = zip(*[(words_of(g, 50), g) for g in ("en", "de") * 40], strict=True)
    model = LanguageModel.fit(list(texts), list(labels), rounds=80)
    text = words_of("en", 20) + " " + words_of("de", 20)
    (p, lettered), = model.labeller()([text])
    right = (p.argmax(1) == np.repeat([model.langs.index("en"), model.langs.index("de")], 20)).mean()
    assert lettered.all() and right > 0.9


def test_memory_limit_changes_nothing():
    texts, labels = zip(*[(words_of(g, 40), g) for g in ("en", "de", "fr") * 20], strict=True)
    model = LanguageModel.fit(list(texts), list(labels), rounds=30)
    a = [p for p, _ in (x for t in texts for x in model.labeller()([t]))]
    small = model.labeller(limit=3)
    b = [small([t])[0][0] for t in texts]
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
    assert lid.normal("(Don't!)") == "don't"


def test_words_are_read_to_their_end():
    long = "".join(chr(0x4E00 + k) for k in range(2000)) + "slurrous"
    n = len(long)
    assert len(subwords(long)) == 1 + n + (n - 1)  # the marked word, its runs of three and of four
    assert set(tox.features("slurrous").tolist()) - set(tox.features(long).tolist()) <= set(tox.parts(["slurrous"])[0].tolist())
    assert subwords(long + "a") != subwords(long + "b") and tox.features(long + "a").tolist() != tox.features(long + "b").tolist()
    inner = tox.parts([long])[0]
    for w in ("lurro", "urrou", "rrous"):  # runs at the very end
        assert len(np.intersect1d(tox.parts(["zz" + w])[0], inner)) >= 1
    crc = lambda p, n: zlib.crc32(p.encode()) % n
    for n in (1, 2, 3, 99, 100, 101, 102, 103, 202, 203, len(long)):
        w = long[-n:]
        grams = {w[i : i + k] for k in (1, 2, 3) for i in range(n - k + 1)} | {"=" + w} | {m + p for k in range(1, min(n, 4) + 1) for m, p in (("^", w[:k]), ("$", w[-k:]))}
        assert lid.features(w, {}) == sorted({crc(p, lid.BUCKETS) for p in grams})


def test_what_ends_a_text_without_blanks_is_judged():
    plain = lambda: "".join(good(40).split())
    texts, y = [plain() for _ in range(200)] + [plain() + "slurroab" * 3 for _ in range(200)], [0] * 200 + [1] * 200
    score = ToxicityModel.fit(texts, y, 0.0, epochs=10).scorer()
    text = plain() * 2
    assert len(text) > 200 and score([text + "slurroab" * 3])[0] > score([text])[0] + 0.1


def test_letters_decide_what_is_undetermined(docs_of):
    rows = [(i, words_of(g), g) for i in range(120) for g in [("en", "de")[i % 2]]] + [(900, "½ ² ③ _ 12"), (901, "½a²")]
    got = {r.doc_id: r for r in identify_languages(docs_of(rows)).collect()}
    assert got[900].lang_pred == "und" and got[900].score == 0 and got[901].lang_pred != "und"
    assert lid.normal("½a²b③") == "a²b" and lid.normal("½²") == ""


def test_long_texts_are_labelled_in_pieces_alike():
    texts, labels = zip(*[(words_of(g, 40), g) for g in ("en", "de", "fr") * 20], strict=True)
    model = LanguageModel.fit(list(texts), list(labels), rounds=30)
    long = " ".join(texts)
    want = model.predictor()([long, "", texts[0]])
    got = model.predictor(cells=3 * lid.CHAIN)([long, "", texts[0]])
    assert [g[0] for g in got] == [g[0] for g in want] and np.allclose([g[1] for g in got], [g[1] for g in want])


def test_long_labelled_texts_are_learned_from(spark, docs_of):
    from purlin.llm.training import labelled_sample, not_held_out

    long = "splendid " * 7_000  # 63,000 characters
    rows = [(i, f"plain words {i}") for i in range(40)] + [(100, long), (101, long + "fine")]
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100, 1), (101, 1)], "doc_id long, quality int")
    texts, marks, _ = labelled_sample(docs_of(rows), labels, "quality", not_held_out(1, 5))
    assert sum(marks) == 2 and long in texts
    few, _, _ = labelled_sample(docs_of(rows), labels, "quality", not_held_out(1, 5), most_chars=1000)
    assert long not in few and 20 < len(few) and sum(map(len, few)) <= 1000


def test_no_language_is_left_out(spark, docs_of):
    import random

    from purlin.llm.language_id import LanguageModel, labelled_texts

    rng = random.Random(1)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(250)}
    rows = [(10 * k + j, " ".join(rng.choices(own, k=30)), lang) for k, (lang, own) in enumerate(words.items()) for j in range(6)]
    rows.append((5000, "verylongword " * 9_000, "l000"))
    found = labelled_texts(docs_of(rows), modulus=1, remainder=5)
    assert {lang for _, lang in found} == set(words) and max(len(t) for t, _ in found) > 100_000
    model = LanguageModel.fit([t[:400] for t, _ in found], [lang for _, lang in found], rounds=70)
    predicted = model.predictor()([" ".join(rng.choices(own, k=30)) for own in words.values()])
    assert [lang for lang, _ in predicted] == list(words)


def test_fitting_quality_gives_its_memory_back(spark):
    """The driver lives on after the fit, so what the fit took must not stay with it."""
    import re

    from purlin.llm.quality_classifier import fit_quality

    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024

    words = "concat_ws(' ', transform(sequence(1, 400), i -> concat('w', cast(pmod(hash(id, i), 60000) as string))))"
    docs = spark.range(4000).selectExpr("id as doc_id", f"{words} as text")
    before = held()
    fit_quality(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert held() - before < 60
