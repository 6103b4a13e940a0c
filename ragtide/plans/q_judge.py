"""Judge verdict queries over synthetic raw replies built from every `events` row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtide.operators import judge as J
from ragtide.plans.registry import register
from ragtide.sources.derived import raw_verdicts
from ragtide.sources.tables import table

# white space of the replies made here, in RE2's words
SQL_WS = r"[\t\n\x0B\f\r\x1C-\x1F ]"


def sql_verdicts(src: str, id_col: str, out_id: str) -> str:
    """DuckDB statement of ``raw_verdicts``: seven reply forms chosen by id % 7."""
    return rf"""
rv0 AS (
  SELECT {id_col} AS {out_id}, CAST({id_col} % 11 AS VARCHAR) AS f, CAST(({id_col} * 3) % 11 AS VARCHAR) AS r,
         CAST(({id_col} * 7) % 11 AS VARCHAR) AS c, CAST(({id_col} * 5 + 2) % 11 AS VARCHAR) AS ci,
         '"feedback": "verdict {{' || CAST({id_col} AS VARCHAR) || '}} ok"' AS fb
  FROM {src}
), rv1 AS (
  SELECT {out_id},
    '{{"faithfulness": ' || f || ', "relevance": ' || r || ', "completeness": ' || c || ', "citation": ' || ci
      || ', ' || fb || '}}' AS full_,
    '{{"faithfulness": ' || f || ', "relevance": ' || r || ', "completeness": ' || c || ', ' || fb || '}}' AS missing_,
    '{{"faithfulness": "' || f || '", "relevance": ' || r || ', "completeness": ' || c || ', "citation": ' || ci
      || ', ' || fb || '}}' AS quoted_
  FROM rv0
), verdicts AS (
  SELECT {out_id}, CASE {out_id} % 7 WHEN 0 THEN full_ WHEN 1 THEN '```json' || chr(10) || full_ || chr(10) || '```'
    WHEN 2 THEN substr(full_, 1, 25) WHEN 3 THEN '  ' || full_ || ' Hope this helps.' WHEN 4 THEN missing_
    WHEN 5 THEN quoted_ ELSE 'I cannot evaluate this answer.' END AS raw
  FROM rv1
), cl AS (
  SELECT {out_id}, raw,
    regexp_replace(regexp_replace(replace(replace(
      regexp_replace(regexp_replace(raw, '\A{SQL_WS}+', ''), '{SQL_WS}+\z', ''), '```json', ''), '```', ''),
      '\A{SQL_WS}+', ''), '{SQL_WS}+\z', '') AS clean
  FROM verdicts
), ps AS (
  SELECT {out_id}, raw, clean, coalesce(json_valid(clean) AND json_type(CASE WHEN json_valid(clean) THEN clean END) = 'OBJECT', false) AS wf FROM cl
), pv AS (
  SELECT {out_id}, raw, clean, wf,
    {", ".join(f"CASE WHEN wf AND json_type(clean, '$.{m}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') "
               f"THEN CAST(json_extract(clean, '$.{m}') AS DOUBLE) END AS {m}" for m in J.MARKS)},
    CASE WHEN wf THEN json_extract_string(clean, '$.completeness_missing') END AS cm,
    CASE WHEN wf THEN json_extract_string(clean, '$.faithfulness_issues') END AS fi,
    CASE WHEN wf THEN json_extract_string(clean, '$.feedback') END AS fbk
  FROM ps
), scores AS (
  SELECT {out_id}, raw,
    (wf AND faithfulness IS NOT NULL AND relevance IS NOT NULL AND completeness IS NOT NULL AND citation IS NOT NULL)
      AS judge_ok,
    faithfulness AS f0, relevance AS r0, completeness AS c0, citation AS ci0, cm, fi, fbk
  FROM pv
), judged AS (
  SELECT {out_id}, judge_ok,
    CASE WHEN judge_ok THEN f0 ELSE 0.0 END AS faithfulness,
    CASE WHEN judge_ok THEN r0 ELSE 0.0 END AS relevance,
    CASE WHEN judge_ok THEN c0 ELSE 0.0 END AS completeness,
    CASE WHEN judge_ok THEN ci0 ELSE 0.0 END AS citation,
    CASE WHEN judge_ok THEN round_even((f0 + r0 + c0 + ci0) / 4, 2) ELSE 0.0 END AS overall,
    CASE WHEN judge_ok THEN round_even((f0 + r0 + c0 + ci0) / 4, 1) END AS overall_1,
    CASE WHEN judge_ok THEN coalesce(cm, 'N/A') ELSE 'N/A' END AS completeness_missing,
    CASE WHEN judge_ok THEN coalesce(fi, 'N/A') ELSE 'N/A' END AS faithfulness_issues,
    CASE WHEN judge_ok THEN fbk ELSE 'Parse error: ' || substr(raw, 1, 100) END AS feedback
  FROM scores
)"""


SQL_EV = sql_verdicts("events", "event_id", "event_id")


def _raw(spark, d):
    return raw_verdicts(table(spark, d, "events"), "event_id")


@register("judge_clean", "WITH " + SQL_EV + """
SELECT event_id, clean FROM cl""")
def judge_clean(spark, d):
    """Replies with surrounding whitespace and code fences removed."""
    return _raw(spark, d).select("event_id", J.clean("raw").alias("clean"))


@register("judge_parse", "WITH " + SQL_EV + """
SELECT event_id, wf AS well_formed, judge_ok FROM ps JOIN scores USING (event_id)""")
def judge_parse(spark, d):
    """Strict well-formedness and whether all four marks parsed as numbers."""
    r = _raw(spark, d).select("event_id", "raw", J.well_formed(J.clean("raw")).alias("well_formed"))
    s = J.parse_verdicts(r, "raw")
    return s.select("event_id", "well_formed", "judge_ok")


@register("judge_overall", "WITH " + SQL_EV + """
SELECT event_id, overall AS overall_2, overall_1 FROM judged WHERE judge_ok""")
def judge_overall(spark, d):
    """Overall recomputed as the mean of the four marks, half-even to 2 and to 1 digits."""
    s2 = J.parse_verdicts(_raw(spark, d), "raw", digits=2).where("judge_ok")
    mean = (F.col("faithfulness") + F.col("relevance") + F.col("completeness") + F.col("citation")) / 4.0
    return s2.select("event_id", F.col("overall").alias("overall_2"), F.bround(mean, 1).alias("overall_1"))


@register("judge_scores", "WITH " + SQL_EV + """
SELECT event_id, faithfulness, relevance, completeness, citation, overall, completeness_missing,
       faithfulness_issues, feedback, judge_ok
FROM judged""")
def judge_scores(spark, d):
    """Full score rows with defaults and the zero fallback, plus judge_ok."""
    return J.parse_verdicts(_raw(spark, d), "raw")


@register("verdict_band", "WITH " + SQL_EV + """
SELECT CASE WHEN overall >= 7 THEN 'high' WHEN overall >= 4 THEN 'mid' ELSE 'low' END AS band,
       judge_ok, count(*) AS n
FROM judged GROUP BY ALL""")
def verdict_band(spark, d):
    """Distribution of overall marks by band (failed verdicts kept apart by judge_ok)."""
    s = J.parse_verdicts(_raw(spark, d), "raw")
    return s.groupBy(J.verdict_band("overall").alias("band"), "judge_ok").agg(F.count(F.lit(1)).alias("n"))
