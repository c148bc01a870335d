"""Language identification by a linear-chain conditional random field over words.

Each word has a score per language from hashed weights of its affixes, character n-grams and itself, and of its place
in the lexicons of frequent words learned per language; learned transitions tie neighbours together. Forward-backward
gives each word's language probabilities, in chains of ``CHAIN`` words, so code-switched text gets labels that follow
the switches. A document's language is the one with the largest sum over its words. Chains don't depend on each other, so
long texts are labelled in pieces of whole chains, in bounded memory.

Training maximises the likelihood of word labels (a word has its document's language) by stochastic gradient
ascent in numpy on a bounded sample of documents per language; half of the training chains splice pieces of several
languages, from which the transitions are learned. Scoring is one lookup a word and ``2 * CHAIN`` array steps a block.

Every language of the training rows is learned, from at most ``2 * PER_LANG`` documents each, whole texts of
``training.MOST_CHARS`` characters together. The more languages, the fewer buckets (``CELLS`` weights at most) and the more rounds.

Defined results: null text, or text without letters (``str.isalpha``), is ``und`` with score 0; languages tie in
alphabetical order; without any learned language everything is ``und``; repeated rows are labelled alike; an empty table
gives an empty result; very long texts and words are read to their end; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from purlin.llm.common import Memo, freeze, id_crc, quoted, ship, uniform
from purlin.llm.training import MOST_CHARS, within

BUCKETS = 1 << 16
CHAIN = 64
PER_LANG = 400  # documents of each language that reach the driver
BROADCAST_LANGS = 10_000  # a count for each is broadcast; more are joined
CELLS = 1 << 24  # weights of a model: buckets by languages
LEXICON = 200
PIECE = 100  # characters of a long word at a time
UNKNOWN = "und"
AROUND = "".join(chr(c) for c in range(128) if not chr(c).isalpha())


def normal(word: str) -> str:
    """The word without what stands around its letters, lower case; empty if it has no letter."""
    bare = word.strip(AROUND)
    if not bare.isalpha():
        first = next((i for i, c in enumerate(bare) if c.isalpha()), len(bare))
        last = next((i for i in range(len(bare), first, -1) if bare[i - 1].isalpha()), first)
        bare = bare[first:last]
    return bare.lower()


def _bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % BUCKETS


_parts = Memo(_bucket, 200_000, 8)  # affixes and n-grams are few


def features(word: str, lexicons: dict[str, list[str]]) -> list[int]:
    """Buckets of a word's affixes (marked by a caret or dollar sign), n-grams, lexicons and of itself."""
    n = len(word)
    parts = {"^" + word[:k] for k in range(1, min(n, 4) + 1)}
    parts.update("$" + word[-k:] for k in range(1, min(n, 4) + 1))
    found = {_bucket("=" + word)}
    for at in range(0, max(1, n - 2), PIECE):  # pieces overlap by two characters, so no n-gram is lost
        w = word[at : at + PIECE + 2]
        parts.update(w)
        parts.update(map("".join, zip(w, w[1:])))
        parts.update(map("".join, zip(w, w[1:], w[2:])))
        found.update(map(_parts.__getitem__, parts))
        parts.clear()
    found.update(_bucket("@" + x) for x in lexicons.get(word, ()))
    return sorted(found)


def forward_backward(emission: np.ndarray, inside: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains side by side, and the expected counts of transitions.

    ``emission``: chains x steps x labels; ``inside``: which steps are words (the others follow them).
    """
    chains, steps, labels = emission.shape
    factor = np.exp(emission - emission.max(2, keepdims=True))
    move = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(factor), np.ones_like(factor)
    now = factor[:, 0] / labels
    alpha[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (alpha[:, t - 1] @ move) * factor[:, t]
        alpha[:, t] = now / now.sum(1, keepdims=True)
    counts = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        ahead = factor[:, t + 1] * beta[:, t + 1]
        back = ahead @ move.T
        both = inside[:, t + 1, None]
        beta[:, t] = np.where(both, back / back.sum(1, keepdims=True), 1.0)
        scale = inside[:, t + 1] / np.maximum((alpha[:, t] * back).sum(1), 1e-300)
        counts += move * ((alpha[:, t] * scale[:, None]).T @ ahead)
    marginal = alpha * beta
    return marginal / marginal.sum(2, keepdims=True), counts


class LanguageModel:
    def __init__(self, langs: list[str], weights: np.ndarray, transition: np.ndarray, lexicons: dict[str, list[str]]):
        self.langs, self.weights, self.transition, self.lexicons = langs, weights, transition, lexicons

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], rounds: int | None = None, chains: int = 160, steps: int = 32, rate: float = 0.4, seed: int = 9) -> LanguageModel:
        langs = sorted(set(labels))
        by = {g: [w for t, x in zip(texts, labels, strict=True) if x == g for w in map(normal, t.split()) if w] for g in langs}
        by = {g: ws for g, ws in by.items() if ws}
        langs = sorted(by)
        lexicons: dict[str, list[str]] = {}
        for g in langs:
            for w, _ in sorted(Counter(by[g]).items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
                lexicons.setdefault(w, []).append(g)
        buckets = min(BUCKETS, 1 << max(8, (CELLS // max(1, len(langs))).bit_length() - 1))
        rounds = rounds or 260 * max(1, -(-len(langs) // 50))  # so that every language is drawn often enough
        weights, transition = np.zeros((buckets, max(1, len(langs)))), np.zeros((len(langs), len(langs)))
        if not langs:
            return cls(langs, weights, transition, lexicons)
        rng = np.random.default_rng(seed)
        index: dict[str, int] = {}
        coded = {g: np.array([index.setdefault(w, len(index)) for w in by[g]]) for g in langs}
        parts = [np.array(features(w, lexicons), np.int64) % buckets for w in index]
        size = np.array([len(p) for p in parts])
        begin, flat = np.cumsum(size) - size, np.concatenate(parts)
        squares, move_squares = np.full(weights.shape, 1e-2), np.full(transition.shape, 1.0)
        everywhere = np.ones((chains, steps), bool)
        for _ in range(rounds):
            word, label = np.empty((chains, steps), np.int64), np.empty((chains, steps), np.int64)
            for c in range(chains):
                t = 0
                while t < steps:
                    k = int(rng.integers(len(langs)))
                    run = steps if c % 2 == 0 else int(rng.geometric(0.1))
                    own = coded[langs[k]]
                    n = min(run, steps - t)
                    at = int(rng.integers(max(1, len(own) - n + 1)))
                    piece = own[at : at + n]
                    n = len(piece)
                    word[c, t : t + n], label[c, t : t + n] = piece, k
                    t += n
            used, where = np.unique(word, return_inverse=True)
            rows = np.concatenate([flat[begin[u] : begin[u] + size[u]] for u in used])
            first = np.cumsum(size[used]) - size[used]
            score = np.add.reduceat(weights[rows], first, axis=0)
            marginal, counts = forward_backward(score[where.reshape(word.shape)], everywhere, transition)
            slope = -marginal
            np.put_along_axis(slope, label[..., None], np.take_along_axis(slope, label[..., None], 2) + 1, 2)
            per_word = np.stack([np.bincount(where.ravel(), slope[..., k].ravel(), len(used)) for k in range(len(langs))], 1)
            spread = np.repeat(per_word / chains, size[used], axis=0)
            touched, at = np.unique(rows, return_inverse=True)
            gradient = np.stack([np.bincount(at, spread[:, k], len(touched)) for k in range(len(langs))], 1)
            squares[touched] += gradient**2
            weights[touched] += rate * gradient / np.sqrt(squares[touched])
            seen = np.zeros_like(counts)
            np.add.at(seen, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1.0)
            drift = (seen - counts) / chains
            move_squares += drift**2
            transition += rate * drift / np.sqrt(move_squares)
        return cls(langs, weights, transition, lexicons)

    def labeller(self, limit: int = 500_000):
        """Texts to (probabilities per word of each text), (which words have letters).

        Row 0 of the table is for words without letters; spellings of one word share a row. Both memories are
        emptied between blocks once they hold ``limit`` entries, or long words of 20 times as many characters.
        """
        held = 0  # characters in index
        rows: dict[str, int] = {"": 0}  # normalised word to its row
        index: dict[str, int] = {}  # word as it stands to its row
        table = np.zeros((1 << 16, len(self.langs)))

        def learn(words: set[str]) -> None:
            nonlocal table, held
            new: list[str] = []
            for raw in words:
                held += len(raw)
                w = normal(raw)
                at = rows.get(w)
                if at is None:
                    at = rows[w] = len(rows)
                    new.append(w)
                index[raw] = at
            while len(rows) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            if new:
                parts = [features(w, self.lexicons) for w in new]
                first = np.cumsum([0] + [len(p) for p in parts[:-1]])
                flat = np.fromiter((b for p in parts for b in p), np.int64) % len(self.weights)
                table[len(rows) - len(new) : len(rows)] = np.add.reduceat(self.weights[flat], first, axis=0)

        def label(texts: list[str] | list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
            """Of texts, or of their words."""
            nonlocal held
            if len(index) > limit:
                index.clear()
                held = 0
            if len(rows) > limit or held > 20 * limit:
                index.clear()
                held = 0
                rows.clear()
                rows[""] = 0
            words = [t.split() if isinstance(t, str) else t for t in texts]
            learn(set().union(*words).difference(index))
            coded = [np.fromiter(map(index.__getitem__, ws), np.int64, len(ws)) for ws in words]
            chains = [max(1, -(-len(c) // CHAIN)) for c in coded]
            total = sum(chains)
            at, inside = np.zeros(total * CHAIN, np.int64), np.zeros(total * CHAIN, bool)
            base = 0
            places = []
            for c, k in zip(coded, chains, strict=True):
                at[base : base + len(c)], inside[base : base + len(c)] = c, True
                places.append((base, base + len(c)))
                base += k * CHAIN
            emission = np.where(inside[:, None], table[at], 0.0).reshape(total, CHAIN, -1)
            marginal, _ = forward_backward(emission, inside.reshape(total, CHAIN), self.transition)
            marginal = marginal.reshape(total * CHAIN, -1)
            return [(marginal[i:j], at[i:j] > 0) for i, j in places]

        return label

    def predictor(self, cells: int = 2_000_000):
        """Texts to (language, score), in blocks of about ``cells`` words times languages."""
        label = self.labeller() if self.langs else None
        most = max(1, cells // max(1, len(self.langs)) // CHAIN) * CHAIN

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            if label is None:
                return [(UNKNOWN, 0.0)] * len(texts)
            total, lettered = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
            held: list[tuple[int, list[str]]] = []
            size = 0

            def flush() -> None:
                nonlocal size
                for (i, _), (p, words) in zip(held, label([ws for _, ws in held]), strict=True):
                    total[i] += p[words].sum(0)
                    lettered[i] += int(words.sum())
                held.clear()
                size = 0

            for i, text in enumerate(texts):
                words = (text or "").split()
                for k in range(0, len(words), most):  # whole chains
                    piece = words[k : k + most]
                    if held and size + len(piece) > most:
                        flush()
                    held.append((i, piece))
                    size += len(piece)
            if held:
                flush()
            return [(self.langs[int(t.argmax())], float(t.max() / n)) if n else (UNKNOWN, 0.0) for t, n in zip(total, lettered.tolist(), strict=True)]

        return predict


def labelled_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, modulus: int = 4, remainder: int = 2, most_chars: int = MOST_CHARS) -> list[tuple[str, str]]:
    """(text, language) of about ``per_lang`` documents of every language, none held out; whole texts of ``most_chars`` together."""
    known = docs.select(quoted(id_col).alias("id"), quoted(lang_col).alias("lang"), quoted(text_col).alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & (F.pmod(id_crc(F.col("id")), F.lit(modulus)) != remainder))
    counts = freeze(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    few = counts.count() <= BROADCAST_LANGS
    rows = (
        known.join(F.broadcast(counts) if few else counts, "lang")
        .withColumn("draw", uniform(F.col("id"), 23))
        .where(F.col("draw") < per_lang / F.col("n"))
        .withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text"))))
        .where(F.col("turn") <= 2 * per_lang)
        .select("id", "lang", "text", "draw", "turn")
    )
    rows = within(rows, "text", ["draw", "id", "turn"], "lang", most_chars, "languages").select("id", "lang", "text").collect()
    return [(text, lang) for _, lang, text in sorted((r["id"], r["lang"], r["text"]) for r in rows)]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, modulus: int = 4, remainder: int = 2) -> LanguageModel:
    rows = labelled_texts(docs, id_col, text_col, lang_col, per_lang, modulus, remainder)
    return LanguageModel.fit([text for text, _ in rows], [lang for _, lang in rows])


def language_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = shared.value.predictor()
        for texts in batches:
            yield pd.DataFrame(predict(texts.tolist()), columns=["lang_pred", "score"])

    return labelled(F.coalesce(text, F.lit("")))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    found = language_column(docs.sparkSession, fit_languages(docs, id_col, text_col, lang_col), quoted(text_col))
    held = F.pmod(id_crc(quoted(id_col)), F.lit(4)) == 2
    rows = docs.select(quoted(id_col), held.alias("held_out"), found.alias("found"))
    return rows.select(quoted(id_col), "held_out", F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))
