"""A training corpus from raw documents: rejected, repeated, nearly repeated and leaked documents go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as
Parquet in the shared folder and read again. All but the last return the columns of documents.

Null and empty texts, repeated rows, ties and empty tables are treated as the operators say: an empty text is
judged like any other, exact copies leave the row with the largest doc_id, near copies (five-word shingles,
similarity 0.8 or more) the one with the smallest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import decontaminate, exact_dedup, jaccard_join, packing, quality_classifier
from tesserae.llm.util import discard, written

CLOSING = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.kept_rows(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; ids_crc32 is the checksum of a piece's ids."""
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CLOSING)
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", leaks), ("packing", pack)]

#: The classifier is trained, and the ids come from a tokenizer: SQL cannot say either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
