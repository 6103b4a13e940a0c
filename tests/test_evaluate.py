"""Keyword hit rate and gates (V1, V4, V5)."""

from ragtide.operators import evaluate as EV
from ragtide.operators import judge as J
from ragtide.operators import retrieve as R


def test_keyword_hit_rate(spark):
    df = spark.createDataFrame(
        [(["VAS", "Significan"], "The vas score was significant."), ([], "anything"), (["a", "b"], None),
         (None, "x"), (["dose", "zz", "q"], "Dose given")],
        "kw array<string>, answer string")
    got = [r[0] for r in df.select(EV.keyword_hit_rate("kw", "answer")).collect()]
    assert got == [1.0, 1.0, 0.0, 1.0, 1 / 3]


def _rows(spark, rows):
    return spark.createDataFrame(
        rows, "qid long, n_sources long, keyword_hit_rate double, faithfulness double, overall double")


def test_gates_boundaries(spark):
    # exactly at the thresholds: every gate passes (>=), no failing row
    rows = _rows(spark, [(1, 1, 0.5, 4.0, 5.0), (2, 3, 0.5, 6.0, 5.0)])
    gates = {r["test"]: r["passed"] for r in EV.quality_gates(rows).collect()}
    assert gates == {"mean_overall": True, "min_faithfulness": True, "mean_keyword_hit_rate": True,
                     "min_n_sources": True, "all_passed": True}
    assert EV.gate_failing_rows(rows).count() == 0


def test_gates_fail(spark):
    rows = _rows(spark, [(1, 0, 0.2, 3.9, 4.0), (2, 3, 0.5, 6.0, 5.0)])
    gates = {r["test"]: r["passed"] for r in EV.quality_gates(rows).collect()}
    assert not gates["all_passed"] and not gates["min_faithfulness"] and not gates["min_n_sources"]
    failing = sorted((r["qid"], r["test"]) for r in EV.gate_failing_rows(rows).collect())
    assert failing == [(1, "faithfulness_above_threshold"), (1, "returns_sources")]


def test_rag_rows_and_rewrites(spark):
    qs = spark.createDataFrame([(1, "first"), (2, "second"), (3, "third")], "qid long, question string")
    replies = spark.createDataFrame([(1, " better first\n"), (2, "  ")], "qid long, reply string")
    used = J.with_rewrites(qs, replies)
    hits = spark.createDataFrame([(1, 2, 0.6, "b.txt", "B" * 90), (1, 1, 0.75, "a.txt", "A")], "qid long, rank int, score double, source string, text string")
    answers = spark.createDataFrame([(1, "answer")], "qid long, answer string")
    rows = {r["qid"]: r for r in R.rag_rows(used, hits, answers).collect()}
    assert [rows[i]["query_used"] for i in (1, 2, 3)] == ["better first", "second", "third"]
    assert rows[1]["context"].startswith("--- DOC 1 | a.txt | Similarity: 75.00% (HIGH) ---\nA\n\n--- DOC 2 | b.txt")
    assert rows[1]["context_preview"] == "[a.txt]: A\n[b.txt]: " + "B" * 80
    assert [x["content"] for x in rows[1]["sources_details"]] == ["A", "B" * 90] and rows[1]["n_sources"] == 2
    assert rows[3]["n_sources"] == 0 and rows[3]["answer"] is None
