"""Evaluation: keyword hit rate, evaluation rows, metric means, per-row and set gates.

Aggregates are single-pass partial/final hash aggregates; gate results are rows
(test, value, threshold, passed), so a failing gate is data, and raising is left
to a command-line wrapper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragtide.operators.judge import MARKS

# Fixed values that must equal the reference: release thresholds.
#   mean overall >= 5.0; minimum faithfulness >= 4.0; mean keyword hit rate >= 0.5;
#   every question retrieves at least one source.
MIN_OVERALL = 5.0
MIN_FAITHFULNESS = 4.0
MIN_KEYWORD_HIT_RATE = 0.5

METRICS = MARKS + ["overall"]


def keyword_hit_rate(keywords, answer) -> Column:
    """V1: share of expected keywords found as case-insensitive substrings; no keywords -> 1.0."""
    kw = F.coalesce(F.col(keywords) if isinstance(keywords, str) else keywords, F.array().cast("array<string>"))
    ans = F.lower(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    hits = F.size(F.filter(kw, lambda k: F.instr(ans, F.lower(k)) > 0))
    return F.when(F.size(kw) == 0, F.lit(1.0)).otherwise(hits / F.size(kw))


def evaluation_rows(questions: DataFrame, answers: DataFrame, verdicts: DataFrame, *, q_id: str = "qid") -> DataFrame:
    """V2 + V6: question ⟕ answer ⟕ verdict on the question id, metrics as DOUBLE.

    ``questions``: (qid, question, expected_keywords); ``answers``: (qid, answer, n_sources);
    ``verdicts``: parsed scores per qid.  Left joins keep every question.
    """
    j = questions.join(answers, q_id, "left").join(verdicts, q_id, "left")
    return j.select(
        q_id, "question", "answer",
        F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"),
        keyword_hit_rate("expected_keywords", "answer").cast("double").alias("keyword_hit_rate"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
        "feedback", "judge_ok",
    )


def evaluation_details(rag: DataFrame, hits: DataFrame, verdicts: DataFrame, *, q_id: str = "qid", score: str = "score",
                       preview: int = 300) -> DataFrame:
    """K6 detail rows: the query used, mean similarity of the hits as percent text, answer preview, verdict notes.

    ``rag``: rows of ``rag_rows``; ``hits``: scored hits; ``verdicts``: parsed verdicts.  Questions without
    hits or verdict keep their row.
    """
    similarity = hits.groupBy(q_id).agg(F.avg(score).alias("_similarity"))
    j = rag.join(similarity, q_id, "left").join(verdicts, q_id, "left")
    return j.select(
        q_id, "query_used", "n_sources", F.round("_similarity", 6).alias("avg_similarity"),
        F.concat(F.substring(F.coalesce("answer", F.lit("")), 1, preview), F.lit("...")).alias("answer_preview"),
        *[F.col(m).cast("double").alias(m) for m in METRICS], "completeness_missing", "faithfulness_issues", "feedback", "judge_ok")


def metric_averages(rows: DataFrame, only_ok: bool = False) -> DataFrame:
    """V3: mean of each metric (and the keyword rate) over the set; empty set -> NULLs.

    ``only_ok`` drops failed verdicts (D7) instead of averaging their zeros.
    """
    r = rows.where(F.col("judge_ok")) if only_ok else rows
    return r.agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(m).alias(m) for m in METRICS + ["keyword_hit_rate"]])


def gate_failing_rows(rows: DataFrame, *, q_id: str = "qid") -> DataFrame:
    """V4: rows failing a per-row gate: no source, or faithfulness below the minimum."""
    no_src = rows.where(F.col("n_sources") <= 0).select(
        q_id, F.lit("returns_sources").alias("test"), F.col("n_sources").cast("double").alias("value"))
    low = rows.where(F.col("faithfulness") < MIN_FAITHFULNESS).select(
        q_id, F.lit("faithfulness_above_threshold").alias("test"), F.col("faithfulness").alias("value"))
    return no_src.unionByName(low)


def quality_gates(rows: DataFrame) -> DataFrame:
    """V5: one aggregate, stacked to rows (test, value, threshold, passed), plus all_passed."""
    a = rows.agg(
        F.avg("overall").alias("mean_overall"), F.min("faithfulness").alias("min_faithfulness"),
        F.avg("keyword_hit_rate").alias("mean_keyword_hit_rate"),
        F.min("n_sources").cast("double").alias("min_n_sources"),
    )
    stacked = a.select(F.explode(F.array(
        F.struct(F.lit("mean_overall").alias("test"), F.col("mean_overall").alias("value"),
                 F.lit(MIN_OVERALL).alias("threshold")),
        F.struct(F.lit("min_faithfulness").alias("test"), F.col("min_faithfulness").alias("value"),
                 F.lit(MIN_FAITHFULNESS).alias("threshold")),
        F.struct(F.lit("mean_keyword_hit_rate").alias("test"), F.col("mean_keyword_hit_rate").alias("value"),
                 F.lit(MIN_KEYWORD_HIT_RATE).alias("threshold")),
        F.struct(F.lit("min_n_sources").alias("test"), F.col("min_n_sources").alias("value"),
                 F.lit(1.0).alias("threshold")),
    )).alias("g")).select("g.*")
    gates = stacked.withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))
    overall = gates.agg(F.lit("all_passed").alias("test"), F.lit(None).cast("double").alias("value"),
                        F.lit(None).cast("double").alias("threshold"), F.bool_and("passed").alias("passed"))
    return gates.unionByName(overall)
