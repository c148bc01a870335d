"""Toxicity: a counterfactually regularised classifier.

The log odds are a sum over a text's distinct word parts; a part is the word itself, one of its prefixes or one of its
character n-grams (hashed), and counts by the logarithm of its share of the words. Only buckets whose log likelihood
ratio shows that they go with label 1 get a weight, and none below zero, so long texts gather no noise. Training is
stochastic gradient descent in numpy on a bounded sample of labelled rows (``training.PER_CLASS`` of each label,
whole texts of ``training.MOST_CHARS`` characters together).

Counterfactual part: of every labelled text there are ``VARIANTS`` others in which every identity term has given place
to a drawn term of its group; where a text has none, one of its words without weight gives place to a drawn term. The
square of the change of the score (of the log odds) between a text and its variant is penalised, so that it doesn't
matter which group is mentioned, nor that one is.

Texts are scored in blocks: new words are hashed together, and only words with telling parts go any further.

Defined results: null text counts as empty; a text without words scores the intercept; without labelled rows of both
classes all texts score the share of label 1; repeated rows score alike; an empty table gives an empty result; very
long texts and words are read to their end, a block of their own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.llm.common import id_crc, quoted, ship
from purlin.llm.training import PER_CLASS, labelled_sample, not_held_out
from purlin.llm.wordparts import Grown, Spelled, WordTable, blocks, ranges

BUCKETS = 1 << 18
RATE, DAMP = 100.0, 50.0  # shares are in hundredths; short texts count as this many words longer
PREFIXES, GRAM = range(3, 11), 5
VARIANTS = 3  # of each labelled text
LEAST = 15.0  # of a bucket's log likelihood ratio: about one in ten thousand by chance
AROUND = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")

# Identity terms by group; within a group any may stand for any other.
IDENTITY_GROUPS = (
    "women men woman man girls boys female male transgender nonbinary frauen männer femmes hommes mujeres hombres".split(),
    "christians muslims jews hindus buddhists atheists sikhs catholics christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos".split(),
    "black white asian hispanic latino arab african european indigenous roma schwarze weiße noirs blancs negros blancos".split(),
    "gay lesbian bisexual straight heterosexual homosexual queer schwul lesbisch gays lesbiennes lesbianas".split(),
    "americans mexicans chinese indians russians germans french turks poles nigerians immigrants refugees flüchtlinge migrants inmigrantes".split(),
    "old young elderly teenage disabled blind deaf autistic alte junge vieux jeunes viejos jóvenes".split(),
)
GROUP_OF = {term: group for group in IDENTITY_GROUPS for term in group}


def normal(word: str) -> str:
    """The word without what stands around its letters and digits, lower case."""
    bare = word.strip(AROUND)
    return (bare if bare.isalnum() else EDGE.sub("", bare)).lower()


def parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words (as they stand in a text), each once a word: all of them in a row, and where each word's begin
    and how many it has."""
    plain = [normal(w) for w in words]
    spelled = Spelled(plain)
    lettered = np.flatnonzero(spelled.size)
    found = [(lettered, spelled.wholes()[lettered])]
    found += [spelled.prefix(k) for k in PREFIXES]
    found += spelled.grams(GRAM)
    word = np.concatenate([w for w, _ in found]).astype(np.int64)
    bucket = (np.concatenate([h for _, h in found]) % np.uint64(BUCKETS)).astype(np.int64)
    pairs = np.unique(word * BUCKETS + bucket)
    size = np.bincount(pairs // BUCKETS, minlength=len(words))
    return pairs % BUCKETS, np.cumsum(size) - size, size


def features(word: str) -> np.ndarray:
    """Buckets of a word (as it stands in a text)."""
    return parts([word])[0]


def amounts(times: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """How much of a bucket a text has: the logarithm of its share of the words."""
    return np.log1p(RATE * times / (length + DAMP))


class _Sample:
    """The labelled texts as numbers of their distinct normalised words and how often each occurs; with the buckets of
    every word and identity term. Arrays alone are held, so thousands of texts take little memory."""

    def __init__(self, texts: list[str]):
        at: dict[str, int] = {w: i for i, w in enumerate(GROUP_OF)}
        self.lengths, self.words = [], []
        for text in texts:
            raw = text.split()
            seen = Counter(map(normal, raw))
            seen.pop("", None)
            ids = np.array([at.setdefault(w, len(at)) for w in seen], np.int32)
            self.words.append((ids, np.array(list(seen.values()), np.int32)))
            self.lengths.append(len(raw))
        self.terms = len(GROUP_OF)
        self.group = [np.array([at[t] for t in GROUP_OF[w]], np.int32) for w in GROUP_OF]
        self.groups = [np.array([at[t] for t in group], np.int32) for group in IDENTITY_GROUPS]
        self.names = list(at)
        made = [parts(self.names[i : i + 20_000]) for i in range(0, len(self.names), 20_000)]
        self.flat = np.concatenate([flat for flat, _, _ in made]).astype(np.int32)
        self.size = np.concatenate([size for _, _, size in made])
        self.begin = np.cumsum(self.size) - self.size

    def vector(self, words: tuple[np.ndarray, np.ndarray], length: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A text's (chosen) buckets and how much of each."""
        ids, times = words
        rows = self.flat[ranges(self.begin[ids], self.size[ids])]
        times = np.repeat(times, self.size[ids])
        if chosen is not None:
            rows, times = rows[chosen[rows]], times[chosen[rows]]
        buckets, where = np.unique(rows, return_inverse=True)
        return buckets.astype(np.int64), amounts(np.bincount(where, times, len(buckets)), length)

    def counterfactual(self, words: tuple[np.ndarray, np.ndarray], rng: np.random.Generator, weightless: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The words of a text with every identity term swapped for a drawn one of its group; without any, one occurrence of
        a ``weightless`` word gives place to a drawn term. None if there is neither."""
        ids, times = words
        own = ids < self.terms
        if own.any():
            new = [self.group[i][rng.integers(len(self.group[i]))] for i in ids[own].tolist()]
            return np.concatenate([ids[~own], np.array(new, np.int32)]), np.concatenate([times[~own], times[own]])
        free = np.flatnonzero(weightless[ids])
        if not len(free):
            return None
        group = self.groups[rng.integers(len(self.groups))]
        times = np.append(times, 1)
        times[free[rng.integers(len(free))]] -= 1
        return np.append(ids, group[rng.integers(len(group))]), times


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets in which two texts differ, and by how much."""
    at, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    delta = np.bincount(where, np.concatenate([a[1], -b[1]]), len(at))
    return at[np.abs(delta) > 1e-12], delta[np.abs(delta) > 1e-12]


def penalty(theta: np.ndarray, at: np.ndarray, delta: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the squared change of the score between a text and its variant, and its gradient over the buckets ``at``."""
    change = float(delta @ theta[at])
    return change * change / 2, change * delta


def _telling(docs: Iterator[np.ndarray], y: np.ndarray, least: float) -> np.ndarray:
    """Which buckets occur in label 1 more often than chance allows: log likelihood ratio of at least ``least``."""
    n = [int((y == k).sum()) for k in (0, 1)]
    seen = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for d, v in zip(docs, y.tolist(), strict=True):
        seen[v][d] += 1
    total = seen[0] + seen[1]

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = np.zeros(BUCKETS)
    for k in (0, 1):
        with_it, without = total * n[k] / sum(n), (sum(n) - total) * n[k] / sum(n)
        ratio += 2 * (part(seen[k], with_it) + part(n[k] - seen[k], without))
    return (ratio >= least) & (seen[1] * n[0] > seen[0] * n[1])


class ToxicityModel:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], prior: float, epochs: int = 40, rate: float = 0.3, least: float = LEAST, fairness: float = 1.0, seed: int = 3) -> ToxicityModel:
        """``fairness``: the share of a change between a text and its variant that one visit takes back."""
        y = np.array(labels)
        if len(set(labels)) < 2:
            return cls(np.zeros(BUCKETS), prior)
        rng = np.random.default_rng(seed)
        sample = _Sample(texts)
        texts_of = lambda: zip(sample.words, sample.lengths, strict=True)
        chosen = _telling((sample.vector(ws, n)[0] for ws, n in texts_of()), y, least)
        docs = [sample.vector(ws, n, chosen) for ws, n in texts_of()]
        owner = np.repeat(np.arange(len(sample.size)), sample.size)
        weightless = np.bincount(owner[chosen[sample.flat]], minlength=len(sample.size)) == 0
        variants = []
        for (ws, n), doc in zip(texts_of(), docs, strict=True):
            drawn = [sample.counterfactual(ws, rng, weightless) for _ in range(VARIANTS)]
            variants.append([difference(doc, sample.vector(v, n, chosen)) for v in drawn if v is not None])
        theta, grads = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
        bias = -1.0
        for epoch in range(epochs):
            for i in rng.permutation(len(docs)):
                at, amount = docs[i]
                error = y[i] - 1 / (1 + np.exp(-np.clip(bias + amount @ theta[at], -30, 30)))
                bias += 0.02 * error
                if len(at):
                    slope = error * amount
                    grads[at] += slope * slope
                    theta[at] = np.maximum(theta[at] + rate * slope / np.sqrt(grads[at]), 0)
                if variants[i]:
                    at, delta = variants[i][epoch % len(variants[i])]
                    if len(at):  # the step is scaled to the length of the difference
                        theta[at] = np.maximum(theta[at] - fairness * penalty(theta, at, delta)[1] / (delta @ delta), 0)
        sampled = np.log((y == 1).sum() / (y == 0).sum())
        return cls(theta, float(bias + prior - sampled))

    def scorer(self):
        """Texts to probabilities of label 1."""
        weights = self.weights
        begin, size = Grown(np.int64), Grown(np.int64)
        store = Grown(np.int64)  # the telling buckets of the words of the table
        used = 0

        def learn(new: list[str], first: int) -> None:
            nonlocal used
            flat, _, counts = parts(new)
            owner = np.repeat(np.arange(len(new)), counts)
            hit = weights[flat] > 0
            n = np.bincount(owner[hit], minlength=len(new))
            used = used if first else 0
            begin.put(first, used + np.cumsum(n) - n)
            size.put(first, n)
            store.put(used, flat[hit])
            used += int(n.sum())

        table = WordTable(learn)

        def score(texts: list[str]) -> np.ndarray:
            out = []
            for some in blocks(texts):
                at, text, length = table.coded(some)
                hit = size.data[at] > 0
                at, text = at[hit], text[hit]
                n = size.data[at]
                pairs, times = np.unique(np.repeat(text, n) * BUCKETS + store.data[ranges(begin.data[at], n)], return_counts=True)
                owner, bucket = pairs // BUCKETS, pairs % BUCKETS
                z = self.intercept + np.bincount(owner, amounts(times, length[owner]) * weights[bucket], len(some))
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            return np.concatenate(out) if out else np.zeros(0)

        return score


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS doubles

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for texts in batches:
            yield pd.Series(score(texts.tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, modulus: int = 3, remainder: int = 1) -> ToxicityModel:
    """A model of ``label_col``, from labelled rows that aren't held out."""
    return ToxicityModel.fit(*labelled_sample(docs, labels, label_col, not_held_out(modulus, remainder), per_class, id_col, text_col))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    score = score_column(docs.sparkSession, fit_toxicity(docs, labels, id_col, text_col), quoted(text_col))
    scored = docs.select(quoted(id_col), (F.pmod(id_crc(quoted(id_col)), F.lit(3)) == 1).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
