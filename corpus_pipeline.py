"""Corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages are written as Parquet in between and reread.

In every stage null texts count as empty, repeated rows meet one fate unless copies are what it drops, very long texts are
taken whole, extra columns pass through whatever their names, and an empty table gives an empty one. What differs is said at
the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purlin.llm.common import freeze
from purlin.llm.exact_dedup import drop_copies
from purlin.llm.minhash_dedup import drop_near_copies
from purlin.llm.mixing import sample_mix
from purlin.llm.packing import pack
from purlin.llm.quality_classifier import keep_quality
from purlin.llm.queries import tokenizer_path

KEEP_FRACTION = 0.6  # of the tokens that reach the mixing stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least 0.3). Null ids are judged like others; empty texts
    score the intercept; without labels of both classes all score alike."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the smallest id (null ids last). Null and empty texts are equal; of
    rows repeated whole one stays."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id. Rows with a null id stay, each a class of its
    own; texts without words are one class."""
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to flattened source, language and topic shares. Null sources and languages are categories of their own;
    rows of one id and cell are drawn alike."""
    return sample_mix(docs, keep_fraction=KEEP_FRACTION)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, along the Hilbert curve; ties on the curve are ordered by id. A null text has one id,
    its end."""
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # trained and hashed stages: tested against their operators and brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = freeze(docs, f"stage-{name}")
    return docs
