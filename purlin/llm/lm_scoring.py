"""Language-model scores of whole texts by a weighted backoff automaton.

The model is a hierarchical Dirichlet n-gram model: with ``h`` a context, ``h'`` the context without its first word and
``K`` the weight of the prior, ``p(w|h) = (c(hw) + K p(w|h')) / (c(h) + K)``; at the root each of the V known words, and one
for all others, is counted ``PRIORS[0]`` times more. A seen ``hw`` is an arc from the state ``h`` with weight ``log10 p(w|h)``, to the longest state that
ends with ``hw``; every state has a failure arc to ``h'`` with weight ``log10 (K / (c(h) + K))``. A text is scored in one
traversal from left to right that sums the weights; the texts of a block are traversed together.

How it runs: the automaton of the whole corpus is never in one place. Texts are cut into blocks of ``BLOCK_CHARS`` characters
(a longer text is a block of its own), and a block is kept as word numbers and the hashes of its words. A block asks
for the totals of its distinct n-grams and tells its own counts of them in the same message: the n-grams, as 64-bit hashes,
are dealt over shards, a few million a shard, so the number of shards grows with the corpus. A shard adds up and answers
every block in the order of its question, so only counts travel back. From these a block builds the part of the automaton
that its texts can reach. A block sends an n-gram once however often it has it, so
common words and repeated passages are no hot keys. N and V, two numbers, reach the driver.

Words are told apart by 64-bit hashes, of which 0.03 pairs collide among a billion different words; longer n-grams by 56 bits, which mix
up one in 70,000 of a trillion.

Defined results: null texts are empty, their one token is the end; rows with a null id are learned from; repeated rows and
equal texts count as often as they occur; without training rows every token scores alike; very long texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.llm.common import Memo, discard, freeze, quoted, ship
from purlin.llm.wordparts import mixed

ORDER = 3
PRIORS = (1.0, 1000.0, 4.0)  # of each word at the root; K of the contexts of one word, of two words
BLOCK_CHARS = 1 << 22
SHARD_KEYS = 3_000_000  # n-grams of all blocks that a shard adds up, at most
_CONTEXT, _WORD = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("totals", pa.binary()), ("known", pa.int64())])
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, the lowest bytes of all first: what is zero compresses well."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def bits(values: np.ndarray) -> bytes:
    """Unsigned numbers as bit planes, as many as the largest needs, after their count."""
    width = int(values.max()).bit_length() if len(values) else 0
    planes = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return len(values).to_bytes(8, "little") + np.packbits(planes.T, axis=1).tobytes()


def unbits(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    row = -(-n // 8)
    planes = np.frombuffer(data[8:], np.uint8).reshape((len(data) - 8) // max(1, row), row)
    out = np.zeros((n, 64), np.uint8)
    out[:, : len(planes)] = np.unpackbits(planes, axis=1, count=n).T
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel()


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``codes``, none below zero, rising, and for each code its place among them."""
    n = len(codes)
    shift = max(1, n.bit_length())
    if not n or int(codes.max()).bit_length() + shift > 63:
        return np.unique(codes, return_inverse=True)
    keys = np.sort((codes << shift) | np.arange(n))  # one sort of plain numbers, each with its place
    own = keys >> shift
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    back = np.empty(n, np.int64)
    back[keys & ((1 << shift) - 1)] = np.cumsum(new) - 1
    return own[new], back


class Grams:
    """The distinct n-grams of a block, order by order.

    Words are numbers below ``size``, 0 the end of a text; ``size`` itself stands for the start. Of order k (from 1):
    ``context[k]``, the number of the (k-1)-gram before the word; ``word[k]``; ``suffix[k]``, the number of the (k-1)-gram without the
    first word; ``at[k]``, the number of the k-gram that ends at each position, -1 where the text has fewer words before.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, size: int, order: int):
        self.size, self.order = size, order
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(tokens)) - np.repeat(first, lengths)
        self.at = [None, tokens]
        self.context, self.word, self.suffix = [None, np.zeros(size, np.int64)], [None, np.arange(size)], [None, np.zeros(size, np.int64)]
        for k in range(2, order + 1):
            ahead = np.empty(len(tokens), np.int64)
            ahead[1:] = self.at[k - 1][:-1]
            some = np.flatnonzero(place >= k - 2)
            if k == 2:
                ahead[first] = size
            codes, back = numbered(ahead[some] * (size + 1) + tokens[some])
            self.context.append(codes // (size + 1))
            self.word.append(codes % (size + 1))
            suffix = np.empty(len(codes), np.int64)
            suffix[back] = self.at[k - 1][some]
            self.suffix.append(suffix)
            at = np.full(len(tokens), -1, np.int64)
            at[some] = back
            self.at.append(at)

    def hashes(self, words: np.ndarray) -> list[np.ndarray]:
        """Of the k-grams for k from 1, the start behind the words of order 1; ``words``: hashes of the block's words."""
        out = [np.append(words, START)]
        for k in range(2, self.order + 1):
            out.append(mixed(out[-1][self.context[k]] * _CONTEXT + words[self.word[k]] * _WORD + np.uint64(k)))
        return out

    def counts(self, chosen: np.ndarray, texts: int) -> list[np.ndarray]:
        """Occurrences at the chosen positions; ``texts``: how often the start occurs."""
        out = [np.append(np.bincount(self.at[1][chosen], minlength=self.size), texts)]
        for k in range(2, self.order + 1):
            seen = self.at[k][chosen]
            out.append(np.bincount(seen[seen >= 0], minlength=len(self.word[k])))
        return out


class Automaton:
    """Arcs and failure arcs over the n-grams of a block, from their totals.

    A state is a seen n-gram of up to ``order - 1`` words, of order 0 the root; the arc of a seen k-gram leaves the state of its
    context and leads to its longest suffix that is a state. ``arc[k]`` and ``fall[k]`` hold the weights by the k-gram's number; an
    arc that isn't there is 1.0, which no logarithm of a probability is.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, known: int, priors: tuple[float, ...]):
        size, self.order = grams.size, grams.order
        whole = n + priors[0] * (known + 1)
        self.unknown = math.log10(priors[0] / whole)
        self.arc: list[np.ndarray] = [np.zeros(0)]
        self.fall: list[np.ndarray] = [np.zeros(0)]
        lower = (totals[0][:size] + priors[0]) / whole
        for k in range(1, self.order + 1):
            seen = totals[k - 1][: len(grams.word[k])]
            if k > 1:
                outside = totals[k - 2][grams.context[k]]  # what follows the context, ends excepted, is as often as it
                lower = (seen + priors[k - 1] * lower[grams.suffix[k]]) / (outside + priors[k - 1])
            self.arc.append(np.where(seen > 0, np.log10(lower), 1.0))
            if k < self.order:
                self.fall.append(np.log10(priors[k] / (totals[k - 1] + priors[k])))
        self.start = (size,) if self.order > 1 and totals[0][size] else ()

    def scores(self, at: list[np.ndarray | None], first: np.ndarray) -> np.ndarray:
        """Of all texts, each from left to right; ``at``: for each word the numbers of the n-grams that end with it, by order;
        ``first``: where each text begins.

        What comes before a seen n-gram's last word, and what comes after its first, is seen too. So the arc taken at a word is that of the
        longest seen n-gram that ends there, whatever the state; the state was left by the falls between its order and that arc's.
        """
        words, inner = len(at[1]), np.ones(len(at[1]), bool)
        inner[first] = False
        taken, weight = np.zeros(words, np.int64), np.full(words, self.unknown)  # order of the arc, 0 where the word is unknown
        for k in range(1, self.order + 1):
            some = np.flatnonzero(at[k] >= 0) if k > 1 else np.arange(words)
            arc = self.arc[k][at[k][some]]
            some, arc = some[arc <= 0.0], arc[arc <= 0.0]
            taken[some], weight[some] = k, arc
        state = np.empty(words, np.int64)  # order of the state before each word
        state[1:] = np.minimum(taken[:-1], self.order - 1)
        state[first] = len(self.start)
        for k in range(1, self.order):
            fell = np.flatnonzero((state >= k) & (taken <= k))
            before = at[k][fell - 1]
            before[~inner[fell]] = self.start[0] if self.start else 0  # a state of order 1
            weight[fell] += self.fall[k][before]
        return np.add.reduceat(weight, first)


def _blocks(schema: pa.Schema, block_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        hashed = Memo(word_hash, limit=200_000)
        ids, held, texts, chars = [], [], [], 0

        def closed() -> pa.RecordBatch:
            split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # of bytes: only A-Z change, only ASCII space splits
            lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
            number: dict[bytes, int] = {b"": 0}  # the end; no word is empty
            new = dict.fromkeys(chain.from_iterable(split))
            number.update(zip(new, range(1, len(new) + 1), strict=True))
            tokens = np.zeros(int(lengths.sum()), np.int64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(lengths) - 1] = False
            tokens[inner] = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(inner.sum()))
            words = np.fromiter(chain([int(END)], map(hashed.__getitem__, new)), np.uint64, len(new) + 1)
            row = {
                "block": (part << 33) + seq,
                "ids": list(ids),
                "held": list(held),
                "lengths": lengths.tolist(),
                "tokens": packed(tokens),
                "words": words.astype("<u8").tobytes(),
                "n_tokens": len(tokens),
                "n_train": int(lengths[~np.array(held, bool)].sum()),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "held", "text")]
            for i in range(batch.num_rows):
                one, out, text = (c[i].as_py() for c in columns)
                if ids and chars + len(text) > block_chars:
                    yield closed()
                    seq += 1
                    ids, held, texts, chars = [], [], [], 0
                ids.append(one)
                held.append(out)
                texts.append(text)
                chars += len(text)
        if ids:
            yield closed()

    return run


def _opened(row: dict, order: int) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a block's row, the hashes of its words, its texts' lengths, and which of them are held out."""
    lengths, held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
    words = np.frombuffer(row["words"], "<u8")
    return Grams(unpacked(row["tokens"]).astype(np.int64), lengths, len(words), order), words, lengths, held


def _dealt(hashes: list[np.ndarray], shards: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, which n-grams, their hashes, rising) of words, in shards below zero, and of longer n-grams, by 56 bits of their hashes;
    the n-grams are numbered through."""
    for keys, count, longer in ((hashes[0], shards[0], False), (np.concatenate([np.zeros(0, np.uint64), *hashes[1:]]), shards[1], True)):
        if not len(keys):
            continue
        order = np.argsort(keys)
        keys = keys[order]
        shard = ((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        keys = keys >> np.uint64(8) if longer else keys
        cuts = np.flatnonzero(np.diff(shard, prepend=np.uint64(count)))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            s = int(shard[low])
            yield (s if longer else -1 - s), order[low:high] + (len(hashes[0]) if longer else 0), keys[low:high]


def _questions(schema: pa.Schema, order: int, shards: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                grams, words, lengths, held = _opened(row, order)
                counts = np.concatenate(grams.counts(np.repeat(~held, lengths), int((~held).sum())))
                out = [(s, bits(np.diff(keys, prepend=np.uint64(0))), bits(counts[which])) for s, which, keys in _dealt(grams.hashes(words), shards)]
                columns = [pa.array([x[j] for x in out], schema.field(j + 1).type) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(out), pa.int64()), *columns], schema=schema)

    return run


def _answers(questions: pa.Table) -> pa.Table:
    """Totals of one shard's n-grams, for every block in the order it asked in."""
    keys = [np.cumsum(unbits(k)) for k in questions["keys"].to_pylist()]
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, back, np.concatenate([unbits(c) for c in questions["counts"].to_pylist()]).astype(np.int64))
    known = [0] * len(keys)
    known[0] = int(np.count_nonzero(total[found != START]))  # of words; the start is none
    answers = [bits(x) for x in np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"block": questions["block"], "shard": questions["shard"], "totals": answers, "known": known}, schema=ANSWER)


def _scored(schema: pa.Schema, order: int, shards: tuple[int, int], n: int, known: int, priors: tuple[float, ...]) -> Callable:
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        grams, words, lengths, held = _opened(row, order)
        hashes = grams.hashes(words)
        totals = np.zeros(sum(map(len, hashes)), np.int64)
        told = dict(zip(answers["shard"].to_pylist(), answers["totals"].to_pylist(), strict=True))
        for s, which, _ in _dealt(hashes, shards):
            totals[which] = unbits(told[s])
        totals = np.split(totals, np.cumsum([len(h) for h in hashes])[:-1])
        tokens, first = grams.at[1], np.cumsum(lengths) - lengths
        seen = totals[0][tokens]
        base = np.log10((seen + 1.0) / (n + known + 1))
        automaton = Automaton(grams, totals, n, known, priors)
        scores = automaton.scores(grams.at, first)
        made = {
            "id": row["ids"],
            "held_out": row["held"],
            "n_tokens": lengths,
            "n_known": np.add.reduceat((seen > 0).astype(np.int64), first),
            "train_tokens": np.full(len(first), n),
            "base_score": np.add.reduceat(base, first),
            "score": scores,
        }
        return pa.table(made, schema=schema)

    return run


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    priors: tuple[float, ...] = PRIORS,
    block_chars: int = BLOCK_CHARS,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: condition over ``id``; those rows are scored but not learned from. ``base_score``: unigrams with one added.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    kind = T._parse_datatype_string(f"block: bigint, ids: array<{id_type}>, held: array<boolean>, lengths: array<bigint>, tokens: binary, words: binary, n_tokens: bigint, n_train: bigint")
    blocks = freeze(rows.mapInArrow(_blocks(to_arrow_schema(kind), block_chars), kind), "blocks")
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_train").alias("train"), F.sum(F.octet_length("words")).alias("bytes")).first()
    n, words = size["train"] or 0, (size["bytes"] or 0) // 8
    shards = (1 + words // shard_keys, 1 + (order - 1) * (size["tokens"] or 0) // shard_keys)

    kind = T._parse_datatype_string("block: bigint, shard: bigint, keys: binary, counts: binary")
    asked = blocks.mapInArrow(_questions(to_arrow_schema(kind), order, shards), kind)
    answers = freeze(asked.groupBy("shard").applyInArrow(_answers, "block: bigint, shard: bigint, totals: binary, known: bigint"), "totals")
    known = answers.where("shard < 0").agg(F.sum("known").alias("v")).first()["v"] or 0

    kind = T._parse_datatype_string(f"id: {id_type}, held_out: boolean, n_tokens: bigint, n_known: bigint, train_tokens: bigint, base_score: double, score: double")
    told = answers.drop("known").groupBy("block")
    scored = blocks.drop("n_tokens", "n_train").groupBy("block").cogroup(told).applyInArrow(_scored(to_arrow_schema(kind), order, shards, n, known, priors), kind)
    return scored.withColumnRenamed("id", id_col)
