"""Grouping of spelling variants: words one edit apart, found by two-dimensional range reporting on wavelet trees.

A word is a point: its rank in forward order by its rank in reverse order. For each edit position of a word the words that share
what stands before it are an interval of forward ranks, those that share what stands after it an interval of reverse ranks; the
points in that rectangle, among the words of the right length, are exactly the words one edit away. A wavelet tree over the
reverse ranks in forward order reports them, for all rectangles of a shard at once.

How it runs: words are counted with map-side combining. A pair of words of which the shorter has ``m`` letters shares the first ``m // 2``
of them, or else the rest, so each word goes into the buckets of its first and its second half, once for partners of its own
length or longer and once for shorter ones. A bucket with more than ``BUCKET_ROWS`` words is cut again into those whose words share
half of the letters still free as well, until no bucket is larger; free letters halve each time, and buckets of one free letter
are bounded by the alphabet. Every edit position belongs to one bucket, so no pair is found twice. Buckets are hashed over shards of
``SHARD_CHARS`` letters; a shard is one group, its trees are built in one task, and it returns one row a word, never
pairs. A word has at most a few thousand neighbours (letters by positions), so the work follows the number of words.
Forms point to words ten times as frequent, so chains have fewer than 20 links; roots come from at most five joins that double
the links followed.

Defined results: null texts have no words; null ids count as empty; repeated rows count as often as they occur; of equally frequent
neighbours the smallest in code-point order is the form; very long texts and words are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purlin.llm.common import discard, freeze, quoted, ship

LEAST_LETTERS, LEAST_COUNT, FREQUENT = 7, 2, 10
LETTERS = "A-Za-zÀ-ÿ"  # all below U+0100: a letter is a byte of Latin-1, in code-point order
BUCKET_ROWS = 50_000
SHARD_CHARS = 2_000_000
QUERIES = 200_000  # rectangles answered at a time


class WaveletTree:
    """Over a permutation of 0..n-1: all values within [low, high) at places within [begin, end), for many ranges at once.

    Level by level, from the highest bit: zeros go left of ones, in order; a level keeps how many zeros stand before each place.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, value) of every point found."""
        which = np.flatnonzero((begin < end) & (low < high))
        begin, end, value = begin[which].astype(np.int64), end[which].astype(np.int64), np.zeros(len(which), np.int64)
        for level, zeros in enumerate(self.zeros):
            span = 1 << (self.bits - 1 - level)
            b0, e0 = zeros[begin].astype(np.int64), zeros[end].astype(np.int64)
            b1, e1 = zeros[-1] + begin - b0, zeros[-1] + end - e0
            left = (b0 < e0) & (value < high[which]) & (value + span > low[which])
            up = value + span
            right = (b1 < e1) & (up < high[which]) & (up + span > low[which])
            begin, end = np.concatenate([b0[left], b1[right]]), np.concatenate([e0[left], e1[right]])
            value, which = np.concatenate([value[left], up[right]]), np.concatenate([which[left], which[right]])
        return which, value


class Ranks:
    """Entries in the order of (bucket, string), and for each entry and depth the interval that shares so many letters."""

    def __init__(self, bucket: np.ndarray, words: np.ndarray):
        self.order = np.lexsort((words, bucket))
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        width = words.dtype.itemsize
        letters = words[self.order].view(np.uint8).reshape(-1, width)
        apart = letters[1:] != letters[:-1]
        shared = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
        placed = bucket[self.order]
        shared[placed[1:] != placed[:-1]] = -1
        self.shared = np.concatenate([[-1], shared, [-1]])  # with the entry before, in order

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each place in order: begin and end of the places that share ``depth`` letters with it."""
        cut = self.shared < depth
        places = np.arange(len(cut))
        begin = np.maximum.accumulate(np.where(cut, places, 0))[:-1]
        end = np.minimum.accumulate(np.where(cut, places, len(cut))[::-1])[::-1][1:]
        return begin, end


def neighbours(words: list[str], n: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, tail: np.ndarray, bucket: np.ndarray, queries: int = QUERIES) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: how many words of its bucket are one edit away by an edit that is the bucket's, and the number of the most
    frequent of them (-1 if none).

    An entry is a word of ``m`` letters, or of one more, in a bucket for edits of words of ``m`` letters at the places
    ``low`` to ``high`` (exclusive; ``tail``: letters may be inserted at ``high`` too).
    """
    forward = np.array([w.encode("latin-1") for w in words])
    backward = np.array([w[::-1].encode("latin-1") for w in words])
    letters = forward.view(np.uint8).reshape(len(words), -1)
    short = np.char.str_len(forward) == m
    ahead, behind = Ranks(bucket, forward), Ranks(bucket, backward)
    best_first = np.empty(len(words), np.int64)
    best_first[np.lexsort((forward, -n))] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    def found(a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(count, a, 1)
        np.minimum.at(best, a, best_first[b])

    trees = []
    for role in (short, ~short):
        entries = ahead.order[role[ahead.order]]  # of the role, in forward order
        before = [np.concatenate([[0], np.cumsum(role[r.order])]) for r in (ahead, behind)]
        back = behind.order[role[behind.order]]
        place = np.empty(len(words), np.int64)
        place[back] = np.arange(len(back))
        trees.append((WaveletTree(place[entries]) if len(entries) else None, before, back))

    width = int(m.max()) + 1
    suffix = [behind.interval(d) for d in range(width + 1)]
    suffix_begin, suffix_end = (np.stack([s[j] for s in suffix]) for j in (0, 1))
    for at in range(int(high.max()) + 1):
        begin, end = ahead.interval(at)
        for inserted in (False, True):
            asked = np.flatnonzero(short & (low <= at) & ((at < high) | ((at == high) & tail & inserted)))
            tree, (ahead_before, behind_before), back = trees[inserted]
            if tree is None:
                continue
            for k in range(0, len(asked), queries):
                q = asked[k : k + queries]
                fb, fe = (ahead_before[x[ahead.rank[q]]] for x in (begin, end))
                depth = m[q] - at - (not inserted)
                bb, be = (behind_before[x[depth, behind.rank[q]]] for x in (suffix_begin, suffix_end))
                alone = 0 if inserted else 1  # by substitution a word finds itself
                some = np.flatnonzero((fe - fb > alone) & (be - bb > alone))
                which, value = tree.report(fb[some], fe[some], bb[some], be[some])
                a, b = q[some[which]], back[value]
                if inserted:  # the last of equal places to insert
                    column = min(at, letters.shape[1] - 1)
                    last = (at == m[a]) | (letters[b, column] != letters[a, column])
                    a, b = a[last], b[last]
                    found(b, a)
                else:
                    other = a != b
                    a, b = a[other], b[other]
                found(a, b)
    by_rank = np.empty(len(words) + 1, np.int64)
    by_rank[best_first] = np.arange(len(words))
    by_rank[len(words)] = -1
    return count, by_rank[best]


def _shard(schema: pa.Schema) -> Callable:
    def run(entries: pa.Table) -> pa.Table:
        column = {c: entries[c].to_numpy() for c in ("n", "m", "low", "high", "tail", "bucket")}
        words = entries["word"].to_pylist()
        count, best = neighbours(words, **column)
        kept = np.flatnonzero(count)
        near = best[kept]
        return pa.table({"word": [words[i] for i in kept.tolist()], "n_near": count[kept], "best_n": column["n"][near], "best": [words[i] for i in near.tolist()]}, schema=schema)

    return run


def _bucket(entries: DataFrame) -> DataFrame:
    """With the hash of what the words of a bucket share."""
    shared = F.xxhash64("m", "low", "high", F.expr("left(word, low)"), F.expr("right(word, m - high)"))
    return entries.withColumn("bucket", shared)


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry in two narrower buckets: edits in the first half of its places, edits in the second."""
    middle = F.expr("low + (high - low) div 2")
    parts = F.array(
        F.struct(middle.alias("low"), F.col("high"), F.col("tail")),
        F.struct(F.col("low"), middle.alias("high"), F.lit(False).alias("tail")),
    )
    return entries.select("word", "n", "m", F.explode(parts).alias("p")).select("word", "n", "m", "p.*")


def near_words(words: DataFrame, bucket_rows: int = BUCKET_ROWS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a neighbour; ``words``: word, n, without repetition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(words.sparkSession)
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") > 0)
    entries = _bucket(_halved(whole.select("word", "n", "m", F.lit(0).alias("low"), F.col("m").alias("high"), F.lit(True).alias("tail"))))
    entries, held = freeze(entries, "entries"), []
    while True:
        large = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.first("low").alias("l"), F.first("high").alias("h"))
        large = freeze(large.where(f"size > {int(bucket_rows)} and h - l > 1").select("bucket"), "large")
        if large.isEmpty():
            break
        held.append(entries.join(large, "bucket", "left_anti"))
        entries = freeze(_bucket(_halved(entries.join(large, "bucket", "left_semi"))), "entries")
    for cold in held:
        entries = entries.unionByName(cold)
    kind = F.greatest(F.lit(4), F.ceil(F.log2(F.col("m") + 1))).cast("int")  # by powers of two of the length
    entries = entries.withColumn("kind", kind)
    sizes = entries.groupBy("kind").agg(F.sum(F.length("word")).alias("chars")).collect()  # 31 rows at most
    shards = F.lit(1)
    for r in sizes:
        shards = F.when(F.col("kind") == r["kind"], 1 + r["chars"] // shard_chars).otherwise(shards)
    schema = F.pmod("bucket", shards).alias("shard")
    out = words.select("word", F.col("n").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).schema
    return entries.select("kind", schema, "word", "n", "m", "low", "high", "tail", "bucket").groupBy("kind", "shard").applyInArrow(_shard(to_arrow_schema(out)), out).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    ).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms lead; ``forms``: word, form."""
    found = freeze(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = freeze(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(found)
        found = moved
        if found.where("moved").isEmpty():
            return found.select("word", "root")


def group_variants(words: DataFrame, frequent: int = FREQUENT, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word; ``words``: word, n, without repetition."""
    near = near_words(words, **sizes)
    formed = F.col("best_n") >= frequent * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    joined = freeze(joined, "variants")
    followed = roots(joined.where("form is not null"))
    return joined.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, misspelt: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of whole texts, A to Z in lower case, that are long and frequent enough.

    ``misspelt`` maps the id and a run to what is counted in its place (default: the run).
    """
    runs = F.regexp_extract_all(quoted(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    rows = docs.select(quoted(id_col).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.select((misspelt(F.col("id"), F.col("run")) if misspelt else F.col("run")).alias("word"))
    rows = rows.where(F.length("word") >= LEAST_LETTERS)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def one_in_31_shortened(id_: Column, run: Column) -> Column:
    """The run, or without one letter where 31 divides the crc32 of ``<id>:<run>``."""
    hashed = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (hashed % F.length(run)).cast("int")
    return F.when(hashed % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def variants_of(docs: DataFrame) -> DataFrame:
    """The variants among the words of ``docs``, a few of them shortened by rule."""
    return group_variants(freeze(word_counts(docs, one_in_31_shortened), "words"))
