"""The stored evaluation set keeps the id of every question."""

from pyspark.sql import functions as F

from ragtide.operators import ingest as I
from ragtide.plans.registry import load_all
from ragtide.sources import tables as S


def test_ids_survive_the_round_trip(spark):
    d = I.scratch_path(spark, "test-eval-set")
    rows = [(7, "alpha beta gamma delta"), (107, "same words here"), (8, "same words here"), (9, None)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = load_all()["load_eval_set"].fn(spark, d).collect()
    assert sorted((r.qid, r.expected_keywords) for r in got if r.qid != 9) == [
        (7, "alpha|delta|gamma"), (8, "words|here|same"), (107, "words|here|same")]
    assert {r.qid for r in got} == {7, 8, 9, 107}


def test_a_question_without_an_id_gets_one(spark):
    d = I.scratch_path(spark, "test-eval-set")
    spark.createDataFrame([('[{"question": "q", "expected_keywords": ["a"]}]',)], "value string").write.text(d)
    got = S.load_eval_set(spark, d).select("qid", F.xxhash64("question").alias("h")).first()
    assert got.qid == got.h
