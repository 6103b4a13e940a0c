"""Registered queries of this package: each applies one operator to its whole table.

``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame; ``ORACLES`` holds DuckDB SQL for
those that SQL can express (see ``oracles.py``), the others are tested against brute
force, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtide.llm import chat, decontaminate, huffman_ids, license_scan, line_dedup, packing, setjoin, sharding, substring_dedup, topk_bsi, toxicity, vector_codes, whitening
from ragtide.llm.common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(read_table(spark, sf_dir, "documents"), path, end_id=2, window=4096, with_ids=False)


def op4_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_groups(read_table(spark, sf_dir, "documents"))


def op5_topk_bsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_bsi.topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(read_table(spark, sf_dir, "documents"))


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), huffman_ids.fresh_folder(spark)
    huffman_ids.write_ids(read_table(spark, sf_dir, "documents"), folder, path, end_id=0)
    return huffman_ids.read_ids(spark, folder, with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(read_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_line_dedup, op3_packing, op4_setjoin, op5_topk_bsi, op6_substring_dedup, op7_huffman_ids, op8_toxicity, op9_slot_sharding, op10_chat_format, op11_license_scan, op12_vector_codes, op13_whitening)}
