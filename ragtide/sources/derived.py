"""Deterministic inputs derived from the driver tables (same rules in the SQL oracles).

Nothing here filters rows away to make a check cheap: every rule maps every
input row to an output row (or joins whole tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.functions import vectors as V


def vector_questions(embeddings: DataFrame) -> DataFrame:
    """Blended questions: q_i = normalise(e_i + e_{i+1}) for every consecutive id pair.

    Each blend sits at cosine sqrt((1+c)/2) of its two parents, so the bands
    HIGH / MEDIUM / LOW all occur.  Equi-join on id + 1 (hash shuffle), no window.
    """
    a = embeddings.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("_a"))
    b = embeddings.select((F.col("vec_id") - 1).alias("qid"), F.col("embedding").alias("_b"))
    return a.join(b, "qid").select("qid", V.l2_normalize(V.add("_a", "_b")).alias("qvec"))


def interaction_records(events: DataFrame) -> DataFrame:
    """Interaction log records from the event feed (one record per event).

    error events are no-answer records without hits, others name twelve chunks; the judge is off (NULL marks) when
    event_id % 11 = 0; marks are the event value scaled to 0-10.
    """
    judge_off = (F.col("event_id") % 11) == 0
    is_err = F.col("event_type") == "error"

    def mark(expr):
        return F.when(judge_off, F.lit(None).cast("double")).otherwise(F.least(expr, F.lit(10.0)))

    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("question from user "), F.col("user_id").cast("string")).alias("question"),
        F.when(is_err, F.lit("No relevant documents found."))
        .otherwise(F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("answer"),
        F.when(is_err, F.lit(0)).otherwise(F.lit(12)).cast("bigint").alias("n_sources"),
        F.when(is_err, F.array().cast("array<string>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.lit(11)), lambda i: F.concat(F.lit("chunk-"), ((F.col("event_id") * 12 + i) % 1000003).cast("string")))).alias("hit_ids"),
        mark(F.col("value") / 10.0).alias("faithfulness"),
        mark(F.col("value") / 9.0).alias("relevance"),
        mark(F.col("value") / 11.0).alias("completeness"),
        mark(F.col("value") / 12.0).alias("citation"),
        mark(F.col("value") / 8.0).alias("overall"),
        F.when(judge_off, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("feedback"),
    )


def raw_verdicts(df: DataFrame, id_col: str) -> DataFrame:
    """Raw judge replies built from an integer id, in seven forms by id % 7:

    0 bare object, 1 fenced with a json tag, 2 truncated, 3 trailing text,
    4 a missing mark, 5 a quoted mark, 6 not JSON.  Marks are id-derived 0..10.
    """
    i = F.col(id_col)
    f, r, c, ci = (i % 11), ((i * 3) % 11), ((i * 7) % 11), ((i * 5 + 2) % 11)
    s = lambda x: x.cast("string")
    fb = F.concat(F.lit('"feedback": "verdict {'), s(i), F.lit('} ok"'))
    body_full = F.concat(
        F.lit('{"faithfulness": '), s(f), F.lit(', "relevance": '), s(r), F.lit(', "completeness": '), s(c),
        F.lit(', "citation": '), s(ci), F.lit(", "), fb, F.lit("}"))
    body_missing = F.concat(
        F.lit('{"faithfulness": '), s(f), F.lit(', "relevance": '), s(r), F.lit(', "completeness": '), s(c),
        F.lit(", "), fb, F.lit("}"))
    body_quoted = F.concat(
        F.lit('{"faithfulness": "'), s(f), F.lit('", "relevance": '), s(r), F.lit(', "completeness": '), s(c),
        F.lit(', "citation": '), s(ci), F.lit(", "), fb, F.lit("}"))
    form = i % 7
    raw = (
        F.when(form == 0, body_full)
        .when(form == 1, F.concat(F.lit("```json\n"), body_full, F.lit("\n```")))
        .when(form == 2, F.substring(body_full, 1, 25))
        .when(form == 3, F.concat(F.lit("  "), body_full, F.lit(" Hope this helps.")))
        .when(form == 4, body_missing)
        .when(form == 5, body_quoted)
        .otherwise(F.lit("I cannot evaluate this answer."))
    )
    return df.select(i.alias(id_col), raw.alias("raw"))


def text_questions(benchmark: DataFrame) -> DataFrame:
    """Text questions from ``benchmark``: qid = item_id, question = text, and as expected
    keywords the 3 longest distinct ``[A-Za-z]+`` tokens (ties by token).  Row-local."""
    toks = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0)))

    def cmp(a, b):
        return (F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
                .when(a < b, -1).when(a > b, 1).otherwise(0))

    return benchmark.select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"),
        F.slice(F.array_sort(toks, cmp), 1, 3).alias("expected_keywords"),
    )


def extractive_answers(hits: DataFrame, *, q_id: str = "qid") -> DataFrame:
    """Offline stand-in for the generation step: per question, the answer is the whole text
    of the best hit, its cited source and a confidence equal to its cosine in percent; the
    context is the hit texts in rank order.  One aggregate per question
    (groups hold k rows), so the hits are computed once.

    ``hits``: (qid, rank, source, text, score).
    """
    g = hits.groupBy(q_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "source", "score"))).alias("_h"),
        F.count(F.lit(1)).alias("n_sources"))
    best = F.col("_h")[0]
    answer = F.concat(best["text"], F.lit(" ["), best["source"], F.lit("] Confidence: "),
                      F.round(best["score"] * 100).cast("int").cast("string"), F.lit("%"))
    return g.select(
        q_id,
        F.array_join(F.transform("_h", lambda x: x["text"]), "\n").alias("context"),
        F.array_sort(F.array_distinct(F.transform("_h", lambda x: x["source"]))).alias("sources"),
        "n_sources", answer.alias("answer"))


# ------------------------------------------------------------------ ingestion fixtures
# Current state: every document is a file docs/{doc_id}.pdf with fingerprint md5(text).
# Previous state (what the manifest and the old index describe): documents with
# doc_id % 13 = 0 did not exist yet; doc_id % 10 = 0 had another text; and for every
# doc_id % 17 = 0 a file docs/{doc_id + 1000000}.pdf existed that is gone now.
PREVIOUS_AT = "2024-01-01 00:00:00"
OLD_SUFFIX = " (superseded revision)"
DELETED_OFFSET = 1_000_000


def doc_path(doc_id) -> F.Column:
    return F.concat(F.lit("docs/"), doc_id.cast("string"), F.lit(".pdf"))


def current_raw(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("doc"), doc_path(F.col("doc_id")).alias("path"),
                            F.md5("text").alias("fingerprint"), "text")


def previous_documents(documents: DataFrame) -> DataFrame:
    kept = documents.where(F.col("doc_id") % 13 != 0).select(
        F.col("doc_id").alias("doc"),
        F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(OLD_SUFFIX))).otherwise(F.col("text")).alias("text"))
    gone = documents.where(F.col("doc_id") % 17 == 0).select(
        (F.col("doc_id") + DELETED_OFFSET).alias("doc"), "text")
    return kept.unionByName(gone)


def previous_manifest(documents: DataFrame) -> DataFrame:
    prev = previous_documents(documents)
    return prev.select(doc_path(F.col("doc")).alias("path"), F.md5("text").alias("fingerprint"),
                       F.lit(PREVIOUS_AT).cast("timestamp").alias("indexed_at"))
