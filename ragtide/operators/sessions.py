"""Sessions: question/answer pairs, full-session report, newest archived sessions.

Pairing a user turn with the turn after it is an equi-join on (conv_id, turn + 1):
the join key includes the turn, so one very long conversation is spread over
many tasks instead of sitting in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value that must equal the reference: report block "Q: {query}\nRewritten: {query_used}\nA: {response}",
# blocks joined by a blank line.
REPORT_SEP = "\n\n"


def qa_pairs(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """H1: every user turn whose next turn is an assistant turn -> (conv_id, turn, query, response)."""
    u = turns.where(F.col("role") == "user").select(conv, turn, F.col("text").alias("query"))
    a = turns.select(conv, (F.col(turn) - 1).alias(turn), F.col("role").alias("_next_role"),
                     F.col("text").alias("response"))
    return u.join(a, [conv, turn]).where(F.col("_next_role") == "assistant").drop("_next_role")


def session_report(pairs: DataFrame, *, conv: str = "conv_id", query_used: str | None = None) -> DataFrame:
    """H2: one report text per conversation, blocks in turn order (``query_used`` defaults to the query, D4)."""
    qu = F.col(query_used) if query_used else F.col("query")
    block = F.concat(F.lit("Q: "), F.col("query"), F.lit("\nRewritten: "), F.coalesce(qu, F.lit("")),
                     F.lit("\nA: "), F.col("response"))
    g = pairs.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("_b"),
                                F.count(F.lit(1)).alias("n_pairs"))
    return g.select(conv, F.array_join(F.transform("_b", lambda x: x["b"]), REPORT_SEP).alias("report"), "n_pairs")


def archive_rows(pairs: DataFrame, archived_at, *, conv: str = "conv_id") -> DataFrame:
    """K5 row shape: (conv_id, archived_at, turns ARRAY<STRUCT<turn, query, response, query_used>>)."""
    g = pairs.groupBy(conv).agg(F.array_sort(F.collect_list(
        F.struct("turn", "query", "response", F.col("query").alias("query_used")))).alias("turns"))
    return g.withColumn("archived_at", archived_at)


def recent_sessions(archive: DataFrame, n: int = 5, *, conv: str = "conv_id") -> DataFrame:
    """H3: the newest ``n`` archived sessions, newest first (a top-n, planned as TakeOrdered)."""
    return archive.orderBy(F.col("archived_at").desc(), F.col(conv).desc()).limit(n)
