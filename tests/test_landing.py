"""Documents landed as one file each and read back: folders and tasks must not be as many as the documents."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ragtide.operators import chunk as C
from ragtide.operators import ingest as I
from ragtide.sources import sinks as K
from ragtide.sources import tables as S
from ragtide.streaming import jobs

TEXTS = {i: f"text {i}\nof two lines é" for i in range(60)} | {60: "", 61: None, 62: "\n"}


@pytest.fixture
def landed(spark):
    docs = spark.createDataFrame([*TEXTS.items(), (5, TEXTS[5])], "doc_id long, text string").repartition(3)
    path = f"{I.scratch_path(spark, 'test-landing')}/landing"
    K.write_text_files(docs, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a split for each file
    yield path
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _id(col):
    return F.regexp_extract(col, r"doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id")


def test_one_file_a_document_in_few_folders(spark, landed):
    root = landed.removeprefix("file://").removeprefix("file:")
    assert len(os.listdir(root)) <= 3 and 63 <= len(glob.glob(f"{root}/*/*")) <= 64
    corpus = S.load_text_corpus(spark, landed)
    assert corpus.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {}
    for r in corpus.select(_id("source"), "filename", "text").collect():
        assert r.filename.endswith(".txt")
        got.setdefault(r.doc_id, []).append(r.text)
    assert "".join(got.pop(5)) == 2 * (TEXTS[5] + "\n")
    assert got == {i: [(t or "") + "\n"] for i, t in TEXTS.items() if i != 5}


def test_scan_in_few_tasks(spark, landed):
    files = S.scan_documents(spark, landed, glob="*.txt")
    assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {r.doc_id: r.length for r in files.select(_id("path"), "length").collect()}
    assert {i: n for i, n in got.items() if i != 5} == {i: len((t or "").encode()) + 1 for i, t in TEXTS.items() if i != 5}


def test_large_files_keep_their_tasks(spark):
    path = I.scratch_path(spark, "test-large")
    spark.range(0, 3000, 1, 12).select(F.repeat(F.lit("x"), 4000).alias("t")).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        files = spark.read.text(path)
        assert S.few_tasks(files).rdd.getNumPartitions() >= 0.9 * files.rdd.getNumPartitions() > 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stream_batch_reads_in_few_tasks(spark, landed, monkeypatch):
    tasks, few = [], jobs.few_tasks
    monkeypatch.setattr(jobs, "few_tasks", lambda df: tasks.append((df.rdd.getNumPartitions(), (out := few(df)).rdd.getNumPartitions())) or out)
    root = I.scratch_path(spark, "test-land-stream")
    only = f"{landed}/task=00001"  # each key once
    jobs.stream_ingest(spark, only, index_path=f"{root}/index", manifest_path=f"{root}/man", checkpoint=f"{root}/ckpt",
                       to_chunks=lambda df: C.chunk_fixed(df, doc="doc"), doc_of_path=F.regexp_extract("path", r"doc_id=([0-9]+)", 1).cast("bigint"))
    assert tasks and all(after <= spark.sparkContext.defaultParallelism < before for before, after in tasks)
    assert I.read_index(spark, f"{root}/index", f"{root}/man").select("doc").distinct().count() >= 15
