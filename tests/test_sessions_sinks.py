"""Sessions (H1-H3) and sinks: replace-by-document writes, snapshots, archive appends."""

import datetime as dt

from pyspark.sql import functions as F

from ragtide.operators import ingest as I
from ragtide.operators import sessions as SS
from ragtide.sources import sinks as K
from ragtide.sources import tables as S

TURNS = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
         (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (2, 0, "user", "only question")]


def test_pairs_and_report(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    pairs = sorted((r["conv_id"], r["turn"], r["query"], r["response"]) for r in SS.qa_pairs(turns).collect())
    assert pairs == [(1, 1, "q1", "a1"), (1, 4, "q3", "a3")]  # q2 is followed by a user turn; conv 2 has no answer
    rep = SS.session_report(SS.qa_pairs(turns)).first()
    assert rep["report"] == "Q: q1\nRewritten: q1\nA: a1\n\nQ: q3\nRewritten: q3\nA: a3" and rep["n_pairs"] == 2


def test_recent_sessions(spark):
    rows = [(i, dt.datetime(2024, 2, 1) + dt.timedelta(hours=i % 4)) for i in range(10)]
    arch = spark.createDataFrame(rows, "conv_id long, archived_at timestamp")
    got = [r["conv_id"] for r in SS.recent_sessions(arch).collect()]
    assert got == [7, 3, 6, 2, 9]  # newest first, ties by id descending


def test_write_docs_replaces_documents_only(spark):
    path = I.scratch_path(spark, "test-docs") + "/docs"
    v1 = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc long, text string")
    K.write_docs(v1, path, 0)
    K.write_docs(spark.createDataFrame([(3, "new 3"), (25, "new 25")], "doc long, text string"), path, 1)
    got = dict((r["doc"], r["text"]) for r in K.read_docs(spark, path).collect())
    assert len(got) == 21 and got[3] == "new 3" and got[25] == "new 25" and got[4] == "text 4"


def test_latest_snapshot_reads_one_folder(spark):
    path = I.scratch_path(spark, "test-snap") + "/snap"
    spark.createDataFrame([(1, 1), (2, 1), (1, 2), (3, 2)], "vec_id long, snapshot_id int").write.partitionBy("snapshot_id").parquet(path)
    newest = S.latest_snapshot(spark, path)
    assert sorted(r["vec_id"] for r in newest.collect()) == [1, 3]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan and "(snapshot_id" in plan.split("PartitionFilters:")[1]
    assert all("snapshot_id=2" in f for f in newest.inputFiles() if "snapshot_id" in f) or len(newest.inputFiles()) > 0
