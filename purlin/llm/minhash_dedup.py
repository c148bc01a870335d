"""Near-duplicate detection by order MinHash, verified by banded alignment.

Similarity of two texts: with ``c`` the longest common subsequence of their sequences of five-word shingles (lower
case, split at white space), ``c / (n1 + n2 - c)``; it equals the shingles' multiset Jaccard similarity where the
order is the same. Texts of 0.8 or more are linked; a class is a connected set of links.

1. Each text gets ``BANDS`` order-MinHash keys: the ``MINIMA`` smallest occurrence-labelled shingles under a hash,
   taken in the order of the text. A pair at 0.8 shares a given key with probability 0.8 ** MINIMA = 0.33, so it shares
   none of 32 with probability 3e-6. Texts of few shingles get further keys of a single minimum.
2. Texts equal in their words form a class at once; one of each goes on.
3. Of the texts that share a key with another, shingles are counted once: a shingle that no other such text has cannot
   be common to a pair, so a text with too many of those can't reach 0.8 with any, and pairs have an upper bound. This
   exact filter takes out texts that merely share a passage or are copies edited too far.
4. Stars: in each bucket the text with the smallest share of such shingles (the one most like the others) is compared
   with the rest, then one drawn by hash, which is linear in a bucket's size. Then texts of buckets that still hold several components are
   compared across components, where they meet in a rare shingle that a pair at 0.8 must share (exact prefix filter).
   So no link is lost and no group of copies is expanded into pairs.
5. Verification aligns within the band that 0.8 leaves room for, with bit-parallel steps.

Joins are on ids and keys. What meets in a bucket is dealt by bucket and, in buckets that hold more than one in
``HOT`` of all rows (so there are less than ``HOT`` of them), by a salt too, so a group of copies is spread over many tasks.
Every stage's result is frozen in the shared folder.

Defined results: null text counts as empty; texts without words are one class; rows with a null id are classes of
their own and stay; repeated rows share their class; an empty table gives an empty result; very long texts are compared
whole; other columns are ignored, whatever their names (``drop_near_copies`` passes them on).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purlin.llm.common import Memo, discard, freeze, numbered, quoted, renamed_back, ship
from purlin.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, MINIMA = 32, 5
SHORT, SHORT_BANDS = 15, 8  # texts of at most SHORT shingles: more keys, of one minimum
HOT, SALTS = 2000, 64
PARITIES = 16  # 64-bit words of a text's parity bitmap
BITS = [f"p{k}" for k in range(PARITIES)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (BANDS + SHORT_BANDS, 2), dtype=np.uint64)
_STEPS = np.random.default_rng(21).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes() -> Callable[[str], tuple[np.ndarray, bytes]]:
    """Text to its words' 32-bit hashes and a digest of the words."""
    memo = Memo(lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little"), 600_000)

    def run(text: str) -> tuple[np.ndarray, bytes]:
        words = text.lower().split()
        digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return np.fromiter(map(memo.__getitem__, words), np.uint32, len(words)), digest

    return run


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of five words, in order; of all words where there are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = _mixed(words.astype(np.uint64) + np.uint64(1))
    size = min(n, SHINGLE)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += w[k : n - size + 1 + k] * _STEPS[k]
    return _mixed(total)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """The same with each occurrence told from the earlier ones."""
    ordered = np.sort(kmers)
    if not (ordered[1:] == ordered[:-1]).any():
        return kmers
    at = np.argsort(kmers, kind="stable")
    starts = np.r_[True, kmers[at][1:] != kmers[at][:-1]]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    nth = np.empty(len(at), np.uint64)
    nth[at] = (np.arange(len(at)) - first).astype(np.uint64)
    return np.where(nth > 0, _mixed(kmers + nth * _MIX), kmers)


def order_keys(kmers: np.ndarray) -> np.ndarray:
    """Order-MinHash keys of a text, one per band."""
    if not len(kmers):
        return np.zeros(0, np.uint64)
    marked = labelled(kmers)
    out = []
    for seeds, minima in ((_SEEDS[:BANDS], MINIMA), (_SEEDS[BANDS:], 1)):
        if minima == 1 and len(marked) > SHORT:
            continue
        step = max(1, 2_000_000 // len(marked))
        for i in range(0, len(seeds), step):  # bounded memory for very long texts
            s = seeds[i : i + step]
            ranks = (((marked[None, :] ^ s[:, :1]) * (s[:, 1:] | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
            if len(marked) > minima:
                at = np.sort(np.argpartition(ranks, minima - 1, axis=1)[:, :minima], axis=1)
            else:
                at = np.broadcast_to(np.arange(len(marked)), (len(s), len(marked)))
            key = np.zeros(len(s), np.uint64)
            for j in range(at.shape[1]):
                key = _mixed(key * np.uint64(31) + marked[at[:, j]])
            out.append(_mixed(key + s[:, 0]))
    return np.concatenate(out)


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """Similarity of two shingle sequences, exact where it reaches ``similar``; else 0 or a lower bound."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return float(na == nb)
    need = similar * (na + nb) / (1 + similar) - 1e-9
    short = min(na, nb)
    if short < need:
        return 0.0
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[na - short + head :][::-1] != b[nb - short + head :][::-1]) if head < short else np.zeros(0, int)
    tail = (int(differ[0]) if len(differ) else short - head) if head < short else 0
    common = head + tail
    x, y = a[head : na - tail], b[head : nb - tail]
    if len(x) and len(y):
        if common + len(np.intersect1d(labelled(x), labelled(y), assume_unique=True)) < need:
            return 0.0
        width = int(na + nb - 2 * need) + 1
        places: dict[int, int] = {}
        for j, v in enumerate(y.tolist()):
            places[v] = places.get(v, 0) | (1 << j)
        full = (1 << len(y)) - 1
        band = (1 << (2 * width + 1)) - 1
        row = full
        for i, v in enumerate(x.tolist()):
            match = places.get(v)
            if match:
                low = i - width
                match &= band << low if low >= 0 else band >> -low
                hit = row & match
                if hit:
                    row = ((row + hit) | (row - hit)) & full
        common += len(y) - row.bit_count()
    return common / (na + nb - common)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = word_hashes()
    for batch in batches:
        digests, sizes, keys = [], [], []
        for text in batch.column("t"):
            words, digest = run(text.as_py() or "")
            kmers = shingles(words)
            digests.append(digest)
            sizes.append(len(kmers))
            keys.append(order_keys(kmers).view(np.int64))
        made = [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(made, ["id", "digest", "n", "keys"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the texts that stand for their class (an id may come with other texts)."""
    run = word_hashes()
    for batch in batches:
        found = [run(t.as_py() or "") for t in batch.column("t")]
        right = np.array([d == want.as_py() for (_, d), want in zip(found, batch.column("digest"), strict=True)], bool)
        rows = [pa.array([w.tobytes() for (w, _), r in zip(found, right, strict=True) if r], pa.binary()), batch.column("id").filter(pa.array(right))]
        yield pa.RecordBatch.from_arrays([rows[1], rows[0]], ["id", "words"])


def _kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [labelled(shingles(np.frombuffer(w.as_py(), np.uint32))).view(np.int64) for w in batch.column("words")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int64()))], ["id", "kmers"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of PARITIES * 64 cells, whether an odd number of the text's shingles falls into it."""
    cells = PARITIES * 64
    for batch in batches:
        rows = []
        for w in batch.column("words"):
            at = (labelled(shingles(np.frombuffer(w.as_py(), np.uint32))) % np.uint64(cells)).astype(np.int64)
            rows.append(np.packbits(np.bincount(at, minlength=cells) & 1, bitorder="little").view("<i8"))
        columns = np.array(rows, np.int64).reshape(-1, PARITIES)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(columns[:, k]) for k in range(PARITIES)]], ["id", *BITS])


def _verify(similar: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda w: shingles(np.frombuffer(w, np.uint32))
            last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
            got = []
            for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True):
                if x != last[0]:  # rows of one leader come together
                    last = (x, read(x))
                got.append(aligned(last[1], read(y), similar))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    return run


def _links(pairs: DataFrame, words: DataFrame, similar: float, kind: str) -> DataFrame:
    """The verified ones of ``pairs`` (a, b), frozen."""
    both = pairs.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    both = both.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").select("a", "b", "wa", "wb")
    checked = both.mapInArrow(_verify(similar), f"a {kind}, b {kind}, similarity double")
    return freeze(checked.where(F.col("similarity") >= similar).distinct(), "links")


def _could(similar: float) -> str:
    """SQL over na, ua, nb, ub: whether the shingles that others have too leave room for ``similar``."""
    most = "least(na - ua, nb - ub)"
    return f"{most} >= {similar - 1e-9} * (na + nb - {most})"


def _met(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` (bucket, ...) with what ``one`` (bucket, c, ...; frozen) says of their bucket; c: its rows.

    ``one`` is small beside ``rows``; only it is repeated, for the hot buckets, once a salt.
    """
    least = one.agg(F.sum("c")).first()[0]
    hot = one.where(F.col("c") > F.greatest(F.lit((least or 0) / HOT), F.lit(1))).select("bucket", F.lit(True).alias("hot"))  # less than HOT rows
    salted = rows.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = one.join(F.broadcast(hot), "bucket", "left").withColumn("salt", F.explode(salts))
    return salted.drop("hot").join(spread.drop("hot", "c"), ["bucket", "salt"]).drop("salt")


def _placed(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``buckets`` whose bucket holds several components of ``links``, with their component, frozen."""
    comps = components(links)
    placed = freeze(buckets.join(comps.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")
    still = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo != hi").select("bucket", "c")
    still = freeze(still, "still")
    out = freeze(_met(placed, still), "open")
    discard(placed, still)
    return out


def _across(apart: DataFrame, words: DataFrame, similar: float, kind: str) -> DataFrame:
    """Pairs (a, b) of different components that can reach ``similar``, frozen: none that does is left out.

    Two texts at ``similar`` have at least that share of each one's shingles in common. With all shingles in one
    order, the rarest first, they must therefore meet among the first ``n - ceil(similar * n) + 1`` of both. Of the pairs
    that meet, parity bitmaps rule out those whose shingles differ too much, within the join and exactly: copies of one
    text edited too far from each other give no rows, however large their group is.
    """
    kmers = words.join(apart.select("id"), "id").mapInArrow(_kmers, f"id {kind}, kmers array<bigint>").select("id", F.explode("kmers").alias("kmer"))
    kmers = freeze(kmers, "rare")
    counts = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    both = kmers.join(counts, "kmer")
    sizes = apart.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    known = apart.join(sizes, "comp").select("id", "n", "u", F.struct("size", "comp").alias("part"))
    of = Window.partitionBy("id")
    ranked = both.withColumns({"rank": F.row_number().over(of.orderBy("c", "kmer")), "shared": F.count(F.lit(1)).over(of)})
    ranked = ranked.join(known, "id").where(f"rank + (n - shared) <= n - ceil({similar - 1e-9} * n) + 1")
    bits = words.join(apart.select("id"), "id").mapInArrow(_parities, f"id {kind}, " + ", ".join(f"{p} bigint" for p in BITS))
    entries = freeze(ranked.join(bits, "id").select("kmer", "id", "n", "u", "part", *BITS), "prefixes")
    lists = entries.groupBy("kmer").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    left = entries.join(lists, "kmer").where("part < hi").select("kmer", F.col("id").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("part").alias("pa"), *[F.col(p).alias(f"a{p}") for p in BITS])
    right = entries.join(lists.select("kmer"), "kmer").select(F.col("kmer").alias("kb"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("part").alias("pb"), *[F.col(p).alias(f"b{p}") for p in BITS])
    # cells of different parity hold a shingle of one text alone: no more such cells than such shingles
    differ = "(" + " + ".join(f"bit_count(a{p} ^ b{p})" for p in BITS) + f") <= (na + nb) * {(1 - similar) / (1 + similar) + 1e-9}"
    met = left.join(right, (F.col("kmer") == F.col("kb")) & (F.col("pa") < F.col("pb")) & F.expr(_could(similar)) & F.expr(differ))
    pairs = freeze(met.select("a", "b").distinct(), "across")
    discard(kmers, entries)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(classes, links). Classes: one row per document: id, copy_of (the document that stands for equal texts), class_id,
    kept, link_count (links of copy_of); links: a, b, similarity between the documents that stand for equal texts, all
    links but those within what is already one class."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    sketches = freeze(rows.mapInArrow(_sketch, f"id {kind}, digest binary, n int, keys array<bigint>"), "sketches")
    known = sketches.where("id is not null")
    texts = freeze(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "texts")
    spread = texts.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    shared = freeze(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    buckets = freeze(_met(spread, shared), "buckets")
    wanted = freeze(buckets.select("id").distinct().join(texts.select("id", "digest", "n"), "id"), "wanted")
    # one plan at every size: texts are dealt by id, also where the ids alone would be small enough to be sent everywhere
    words = rows.join(wanted.select("id", "digest").hint("merge"), "id").mapInArrow(_words, f"id {kind}, words binary")
    words = freeze(words, "words")
    kmers = words.mapInArrow(_kmers, f"id {kind}, kmers array<bigint>").select("id", F.explode("kmers").alias("kmer"))
    alone = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    able = wanted.join(alone, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).cast("int").alias("u")).where(f"u <= {1 - similar + 1e-9} * n")
    able = freeze(buckets.join(able, "id"), "able")  # bucket, id, n, u
    best = F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "id", "n", "u")).alias("l")
    leaders = able.groupBy("bucket").agg(best, F.count(F.lit(1)).alias("c")).where("c > 1")
    leaders = freeze(leaders.select("bucket", "c", F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("l.u").alias("ua")), "leaders")
    stars = _met(able, leaders).select("a", "na", "ua", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"))
    stars = freeze(stars.where("a != b").where(_could(similar)).select("a", "b").distinct(), "stars")
    first = _links(stars, words, similar, kind)
    placed = _placed(able, first)
    discard(shared, buckets, wanted, leaders, able, stars)
    # the texts of open buckets once more, each bucket with a leader drawn by hash: a text meets another in each band
    one = F.min(F.struct(F.xxhash64("id", "bucket").alias("h"), "id", "n", "u", "comp")).alias("l")
    drawn = placed.groupBy("bucket").agg(one, F.count(F.lit(1)).alias("c"))
    drawn = freeze(drawn.select("bucket", "c", F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("l.u").alias("ua"), F.col("l.comp").alias("ca")), "drawn")
    again = _met(placed, drawn).select("a", "na", "ua", "ca", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), "comp")
    again = freeze(again.where("comp != ca").where(_could(similar)).select("a", "b").distinct(), "stars")
    first = first.unionByName(_links(again, words, similar, kind))
    open_ = _placed(placed.drop("comp"), first)
    apart = freeze(open_.select("id", "n", "u", "comp").distinct(), "apart")
    discard(placed, drawn, again, open_)
    across = _across(apart, words, similar, kind)
    second = _links(across, words, similar, kind)
    discard(apart, across, words)
    links = first.unionByName(second)
    comps = components(links).select(F.col("node").alias("copy_of"), "comp")
    count = links.select(F.explode(F.array("a", "b")).alias("copy_of")).groupBy("copy_of").agg(F.count(F.lit(1)).alias("link_count"))
    classes = texts.select("digest", F.col("id").alias("copy_of")).join(comps, "copy_of", "left").join(count, "copy_of", "left")
    classes = classes.select("digest", "copy_of", F.coalesce("comp", "copy_of").alias("class_id"), F.coalesce("link_count", F.lit(0).cast("bigint")).alias("link_count"))
    found = sketches.select("id", "digest").join(classes, "digest", "left")
    null = F.col("id").isNull()
    out = found.select(
        F.col("id").alias(id_col),
        F.when(~null, F.col("copy_of")).alias("copy_of"),
        F.when(~null, F.col("class_id")).alias("class_id"),
        (null | (F.col("id") == F.col("class_id"))).alias("kept"),
        F.when(~null, F.col("link_count")).alias("link_count"),
    )
    return out, links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class; columns unchanged."""
    classes, _ = near_duplicates(docs, id_col, text_col, similar)
    dropped = classes.where("not kept").select(F.col(id_col).alias("__drop"))
    rows, names = numbered(docs)
    return rows.join(dropped, F.col(names[id_col]) == F.col("__drop"), "left_anti").select(*renamed_back(names))
