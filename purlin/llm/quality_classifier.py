"""Quality classifier: supervised subword embeddings.

Every word has hashed vectors for itself and its character n-grams, averaged; a document is the average of its
words' vectors and of one more vector for each word that repeats the one before it; a softmax output gives the
probability of label 1. The vectors and the output layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows (``training.PER_CLASS`` of each label, whole texts of
``training.MOST_CHARS`` characters together), and the sample's class balance is put right in the intercept.

With two classes the output is linear in the average, so for scoring each hashed vector shrinks to one number and
each word to their mean. Texts are scored in blocks: new words are hashed together, then a text is a sum over its
words' numbers. Whole texts, no shuffle.

Defined results: null text counts as empty; a text without words scores the intercept alone; without labelled rows of
both classes all texts score the share of label 1 (one half without any label); repeated rows score alike; an empty
table gives an empty result; very long texts and words are read to their end, a block of their own; other columns are
ignored, whatever their names (``keep_quality`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.llm.common import give_back, id_crc, quoted, ship
from purlin.llm.training import PER_CLASS, labelled_sample, not_held_out
from purlin.llm.wordparts import Grown, Spelled, WordTable, blocks, ranges

BUCKETS = 1 << 17
SAME = BUCKETS  # the bucket of a word that repeats the one before it
DIM = 16
LENGTHS = (3, 4)


def _parts(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the words, marked at both ends, and of their n-grams."""
    spelled = Spelled([f"<{w}>" for w in words])
    yield np.arange(len(words)), (spelled.wholes() % np.uint64(BUCKETS)).astype(np.int64)
    for n in LENGTHS:
        for word, found in spelled.grams(n):
            yield word, (found % np.uint64(BUCKETS)).astype(np.int64)


def subwords(word: str) -> list[int]:
    """Buckets of the word and its character n-grams."""
    return sorted(int(b) for _, buckets in _parts([word]) for b in buckets)


class SubwordModel:
    """Per-bucket contributions to the log odds of label 1, and the intercept."""

    def __init__(self, contribution: np.ndarray, intercept: float):
        self.contribution, self.intercept = contribution, intercept

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], prior: float, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> SubwordModel:
        y = np.array(labels)
        if len(set(labels)) < 2:
            return cls(np.zeros(BUCKETS + 1), prior)
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1, 1, (BUCKETS + 1, DIM)).astype(np.float32) / DIM
        output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
        docs = _counted(texts)
        steps, done = epochs * len(docs), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                at, weight = docs[i]
                lr = rate * (1 - done / steps)
                done += 1
                hidden = weight @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
                logit = output @ hidden + bias
                p = np.exp(logit - logit.max())
                error = -p / p.sum()
                error[y[i]] += 1
                back = error @ output
                output += lr * np.outer(error, hidden)
                bias += lr * 0.1 * error
                if len(at):  # the share of a bucket is small, so its step is scaled up to that of an embedding row
                    vectors[at] += lr * np.sqrt(weight)[:, None] * back
        sampled = np.log((y == 1).sum() / (y == 0).sum())
        return cls((vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0] + prior - sampled))

    def values(self, words: list[str]) -> np.ndarray:
        """The mean contribution of each word's parts."""
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for word, buckets in _parts(words):
            total += np.bincount(word, self.contribution[buckets], len(words))
            count += np.bincount(word, minlength=len(words))
        return total / np.maximum(count, 1)

    def scorer(self):
        """Texts to probabilities of label 1."""
        known = Grown(np.float64)
        table = WordTable(lambda new, first: known.put(first, self.values(new)))

        def score(texts: list[str]) -> np.ndarray:
            out = []
            for some in blocks(texts):
                at, text, n = table.coded(some)
                again = text[1:][(at[1:] == at[:-1]) & (text[1:] == text[:-1])]
                same = np.bincount(again, minlength=len(some))
                total = np.bincount(text, known.data[at], len(some)) + same * self.contribution[SAME]
                z = self.intercept + total / np.maximum(1, n + same)
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            return np.concatenate(out) if out else np.zeros(0)

        return score


def _counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's buckets and their weights in its average. One text's words are held at a time."""
    index: dict[str, int] = {}
    coded = [np.array([index.setdefault(w, len(index)) for w in t.split()], np.int32) for t in texts]
    names, flats, sizes = list(index), [], []
    for i in range(0, len(names), 20_000):
        some = names[i : i + 20_000]
        pairs = list(_parts(some))
        owner = np.concatenate([w for w, _ in pairs])
        flats.append(np.concatenate([b for _, b in pairs])[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(some)))
    flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    docs = []
    for at in coded:
        same = int((at[1:] == at[:-1]).sum())
        used, times = np.unique(at, return_counts=True)
        total = max(1, len(at) + same)
        rows = flat[ranges(begin[used], size[used])]
        weight = np.repeat(times / (size[used] * total), size[used])
        if same:
            rows, weight = np.append(rows, np.int32(SAME)), np.append(weight, same / total)
        buckets, where = np.unique(rows, return_inverse=True)
        docs.append((buckets, np.bincount(where, weight, len(buckets)).astype(np.float32)))
    return docs


def score_column(spark: SparkSession, model: SubwordModel, text: Column) -> Column:
    """The model's score of a text column, in Arrow batches."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS doubles

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = shared.value.scorer()
        for texts in batches:
            yield pd.Series(score(texts.tolist()), dtype="float64")

    return scored(F.coalesce(text, F.lit("")))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, modulus: int = 5, remainder: int = 0) -> SubwordModel:
    """A model of ``label_col``, from labelled rows that aren't held out."""
    model = SubwordModel.fit(*labelled_sample(docs, labels, label_col, not_held_out(modulus, remainder), per_class, id_col, text_col))
    give_back()
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    score = score_column(docs.sparkSession, fit_quality(docs, labels, id_col, text_col), quoted(text_col))
    scored = docs.select(quoted(id_col), (F.pmod(id_crc(quoted(id_col)), F.lit(5)) == 0).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored under ``threshold``; columns unchanged."""
    model = fit_quality(docs, labels, id_col, text_col)
    return docs.where(score_column(docs.sparkSession, model, quoted(text_col)) >= threshold)
