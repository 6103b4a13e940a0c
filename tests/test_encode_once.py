"""Texts are encoded once, whatever is asked of the vectors, and chunks don't carry their documents."""

from ragtide.functions import vectors as V
from ragtide.operators import chunk as C
from ragtide.operators import encode as E


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame([(1, "a b c " * 400), (2, None), (3, " "), (4, "short")], "doc_id long, text string")


def test_vectors_are_made_once(spark):
    chunks = E.encode(C.chunk_fixed(docs(spark)), "text", "vec")
    asked = chunks.where("vec is not null and size(vec) = 384").select("doc", "chunk_no", V.as_double("vec").alias("v"))
    assert plan(asked).count("ArrowEvalPython") == 1 and "transform(pythonUDF" not in plan(asked)
    got = {(r.doc, r.chunk_no): sum(r.v) for r in asked.collect()}
    assert got == {(1, 0): 500.0, (1, 1): 500.0, (1, 2): 400.0, (4, 0): 1.0}


def test_sparse_vectors_are_made_once(spark):
    rows = docs(spark).select("doc_id", E.sparse_arrays("text").alias("v")).select("doc_id", "v.buckets", "v.weights").where("size(buckets) > 0")
    assert plan(rows).count("ArrowEvalPython") == 1
    assert {r.doc_id: sum(r.weights) for r in rows.collect()} == {1: 1200, 4: 1}


def test_chunks_hold_their_window_only(spark):
    df = docs(spark)
    chunks = E.encode(C.chunk_fixed(df), "text", "vec").select("doc", "chunk_no", "vec")
    above = plan(chunks).split("ArrowEvalPython")[1].split("Generate")[0]
    assert "text" in above and "substring" not in above
    rows = C.chunk_fixed(df).orderBy("doc", "chunk_no").collect()
    text = "a b c " * 400
    assert [tuple(r) for r in rows] == [(1, i, i * 800, text[i * 800:i * 800 + 1000], len(text[i * 800:i * 800 + 1000])) for i in range(3)] + [(4, 0, 0, "short", 5)]
