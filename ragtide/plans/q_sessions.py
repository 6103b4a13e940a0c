"""Session queries over `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtide.operators import sessions as S
from ragtide.plans.registry import register
from ragtide.sources.tables import table

SQL_PAIRS = """
nx AS (
  SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn
  FROM conversations
), pairs AS (
  SELECT conv_id, turn, text AS query, next_text AS response FROM nx
  WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1
)"""

# Archive time of a conversation (fixture rule): 2024-02-01 + (conv_id * 37 % 240) hours.
SQL_ARCHIVED = "TIMESTAMP '2024-02-01 00:00:00' + to_hours((conv_id * 37) % 240)"


def _archived_at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(
        F.lit(0), ((F.col("conv_id") * 37) % 240).cast("int"))


def _pairs(spark, d):
    return S.qa_pairs(table(spark, d, "conversations"))


@register("qa_pairs", "WITH " + SQL_PAIRS + """
SELECT conv_id, turn, md5(query) AS query_md5, md5(response) AS response_md5 FROM pairs""")
def qa_pairs(spark, d):
    """H1: user turn paired with the assistant turn right after it."""
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", F.md5("query").alias("query_md5"), F.md5("response").alias("response_md5"))


@register("session_report", "WITH " + SQL_PAIRS + """
SELECT conv_id, md5(string_agg('Q: ' || query || chr(10) || 'Rewritten: ' || query || chr(10) || 'A: ' || response,
                               chr(10) || chr(10) ORDER BY turn)) AS report_md5, count(*) AS n_pairs
FROM pairs GROUP BY conv_id""")
def session_report(spark, d):
    """H2: full report text per conversation."""
    r = S.session_report(_pairs(spark, d))
    return r.select("conv_id", F.md5("report").alias("report_md5"), "n_pairs")


@register("recent_sessions", "WITH " + SQL_PAIRS + f""",
arch AS (SELECT DISTINCT conv_id, {SQL_ARCHIVED} AS archived_at FROM pairs)
SELECT conv_id, strftime(archived_at, '%Y-%m-%d %H:%M:%S') AS archived_at FROM arch
ORDER BY arch.archived_at DESC, conv_id DESC LIMIT 5""")
def recent_sessions(spark, d):
    """H3: the five newest archived sessions."""
    arch = S.archive_rows(_pairs(spark, d), _archived_at())
    r = S.recent_sessions(arch)
    return r.select("conv_id", F.date_format("archived_at", "yyyy-MM-dd HH:mm:ss").alias("archived_at"))
