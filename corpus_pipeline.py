"""A training corpus in five stages, each one operator of ``ragtide.llm``.

Toxic documents go, lines that many documents share stay in one of them, one document of each
near-duplicate group stays, documents that hold a benchmark passage go, and what is left is
packed into training sequences.  Every stage reads what its predecessor wrote.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragtide.llm import decontaminate, line_dedup, packing, setjoin, toxicity
from ragtide.llm.common import read_table, small_batches
from ragtide.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: without the documents that the classifier rejects (score from 0.7 on)."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines of 40 and more characters in 5 and more documents stay in the last of them only."""
    small_batches(spark)
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the smallest doc_id of each group of documents linked by word shingles.

    Near duplicates take five words and a similarity of 0.8."""
    small_batches(spark)
    return setjoin.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: without the documents that hold ten consecutive words (or all words) of a benchmark item."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sequences of at most 4096 ids, the ids themselves beside their digests."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the session's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    folder = f"{root}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The classifier and the packing can't be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
