"""Packing token sequences along a space-filling curve.

1. Each text is tokenised once; its ids (16 bits each where the vocabulary allows) and the Hilbert key of its
   projected hashed token vector are written to the shared folder.
2. The small rows (key, row, length) are range-sorted by key and frozen; a running sum within each range and the
   ranges' totals (one number a partition) give each document its place in one endless stream of tokens.
3. The stream is cut every ``size`` tokens. Neighbours on the curve share sequences, and only the last sequence of
   the whole corpus has padding.

Rows with one key (copies) are split by row number, so no key fills a partition. Each row is cut by itself.

Defined results: null text is empty; an empty text is its end id alone; repeated rows are packed as often as they
occur; an empty table gives no pieces; other columns are ignored, or carried when named in ``carry``; to carry one with the name of a result's column is an error.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.llm import vectors
from purlin.llm.common import Memo, freeze, numbered, ship

SIZE = 4096
END_ID = 2
# The tokenizer settings under which chunks can be encoded apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*]*)")


class Encoder:
    """Texts to id bytes; made once in a worker.

    Where the tokenizer lower-cases, drops white space and takes each run of letters by itself (checked), the chunks
    between blanks and line ends are encoded apart and remembered, and so is the lower-cased word in a chunk of Latin
    letters with closing punctuation. Other chunks are encoded as they are; with other tokenizers whole texts are.
    Memory: ``limit`` chunks of at most ``longest`` characters.
    """

    def __init__(self, path: str, limit: int = 600_000, longest: int = 48):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.buckets = vectors.id_buckets(size)
        config = json.loads(self.tokenizer.to_str())
        first = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_chunk = config["normalizer"] == NORMALIZER and first.get("pattern", {}).get("Regex") == LETTER_RUNS and first.get("invert") is True
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = Memo(self._word, limit, longest)
        self.tails = Memo(self._whole, 10_000)
        self.chunks = Memo(self._chunk, limit, longest)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else self.as_bytes.pre_tokenize_str(word)[0][0]
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], self.kind).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        m = LATIN_WORD.fullmatch(chunk)
        if m:
            return self.words[m[1].lower()] + (self.tails[m[2]] if m[2] else b"")
        return self._whole(chunk) if chunk else b""

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))) if self.by_chunk else self._whole(text)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenise(path: str, end_id: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        kind, buckets = encode.kind, encode.buckets
        matrix = vectors.projection(vectors.DIMS, seed)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            texts = batch.column("__text")
            if not len(texts):
                continue
            ids, points = [], []
            for text in texts:
                data = encode(text.as_py() or "")
                points.append(vectors.project(buckets[np.frombuffer(data, kind)], matrix))
                ids.append(data + end)
            new = [
                pa.array(vectors.hilbert_keys(np.array(points)), pa.int64()),
                pa.array([len(x) // kind.itemsize for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__text"]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + new, [n for _, n in kept] + ["__key", "__n", "__ids"])

    return run


def _cut(path: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _encoder(path).kind
        for batch in batches:
            at, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__at", "__n"))
            first, last = at // size, (at + n - 1) // size
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(sequence * size, at[row])
            length = np.minimum((sequence + 1) * size, at[row] + n[row]) - begin
            start = begin - at[row]
            ids = batch.column("__ids")
            whole = [np.frombuffer(x.as_py(), kind).astype("<u4").tobytes() for x in ids]
            pieces = [whole[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            made = {
                "start": pa.array(start),
                "length": pa.array(length),
                "doc_tokens": pa.array(n[row]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(begin - sequence * size),
                "ids": pa.array(pieces, pa.binary()),
            }
            taken = pa.array(row)
            kept = [(c.take(taken), name) for c, name in zip(batch.columns, batch.schema.names, strict=True) if name[:3] == "__c"]
            yield pa.RecordBatch.from_arrays([c for c, _ in kept] + list(made.values()), [x for _, x in kept] + list(made))

    return run


def stream_places(lengths: DataFrame, key: str, row: str, n: str) -> DataFrame:
    """(row, __at): tokens before each row in the order (key, row), over the whole frame.

    Only the ranges' totals, one number a partition, come to the driver.
    """
    spark = lengths.sparkSession
    dealt = lengths.repartitionByRange(key, row).sortWithinPartitions(key, row)
    dealt = freeze(dealt.withColumn("__range", F.spark_partition_id()), "order")
    totals = sorted((r["__range"], r["t"]) for r in dealt.groupBy("__range").agg(F.sum(n).alias("t")).collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    ahead = spark.createDataFrame(bases, T.StructType([T.StructField("__range", T.IntegerType()), T.StructField("__base", T.LongType())]))
    running = Window.partitionBy("__range").orderBy(key, row).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("__sum", F.sum(n).over(running)).join(F.broadcast(ahead), "__range").select(row, (F.col("__base") + F.col("__sum") - F.col(n)).alias("__at"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    carry: list[str] | None = None,
    seed: int = 11,
) -> DataFrame:
    """One row per piece: id (and ``carry``), start, length, doc_tokens, sequence_id, offset, ids.

    ``ids``: the piece's ids, little-endian unsigned 32-bit.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [id_col] + [c for c in carry or [] if c != id_col]
    if clash := sorted({"start", "length", "doc_tokens", "sequence_id", "offset", "ids"}.intersection(kept)):
        raise ValueError(f"columns of the result can't be carried: {clash}")
    rows, names = numbered(docs, kept + ([] if text_col in kept else [text_col]))
    rows = rows.withColumn("__text", F.col(names[text_col]))
    if text_col not in kept:
        rows = rows.drop(names[text_col])
    out = T.StructType([f for f in rows.schema.fields if f.name != "__text"] + [T.StructField("__key", T.LongType()), T.StructField("__n", T.LongType()), T.StructField("__ids", T.BinaryType())])
    tokens = rows.mapInArrow(_tokenise(tokenizer_path, end_id, seed), out)
    tokens = freeze(tokens.withColumn("__row", F.monotonically_increasing_id()), "tokens")
    places = stream_places(tokens.select("__row", "__key", "__n"), "__key", "__row", "__n")
    placed = tokens.drop("__key").join(places, "__row").drop("__row")
    carried = [f for f in placed.schema.fields if f.name[:3] == "__c"]
    pieces = T.StructType(carried + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])
    cut = placed.mapInArrow(_cut(tokenizer_path, size), pieces)
    return cut.select(*[F.col(names[c]).alias(c) for c in kept], *[f.name for f in pieces.fields[len(carried) :]])
