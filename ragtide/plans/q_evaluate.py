"""Answer checks, evaluation rows, means and gates over `benchmark` questions.

Answers come from the offline extractive stand-in (best hit + source + confidence)
built on the exact text retrieval of q_chunks; verdicts are synthetic raw replies
keyed by question id.  Everything is keyed by question id and joined, never collected.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ragtide.operators import chunk as C
from ragtide.operators import evaluate as EV
from ragtide.operators import judge as J
from ragtide.operators import retrieve as R
from ragtide.plans.q_chunks import SQL_RAG, _rag_hits
from ragtide.plans.q_judge import sql_verdicts
from ragtide.plans.registry import register
from ragtide.sources.derived import extractive_answers, raw_verdicts, text_questions
from ragtide.sources.tables import table

SQL_ANSWERS = SQL_RAG + r""",
hm AS (
  SELECT h.qid, h.rank, h.score, coalesce(d.source, 'Unknown') AS source, k.text
  FROM hits h JOIN chk k ON k.doc = h.doc AND k.chunk_no = h.chunk_no LEFT JOIN documents d ON d.doc_id = h.doc
), ans AS (
  SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context, list_sort(list_distinct(list(source))) AS sources,
         count(*) AS n_sources,
         max(CASE WHEN rank = 1 THEN text || ' [' || source || '] Confidence: '
                  || CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) || '%' END) AS answer
  FROM hm GROUP BY qid
), kt AS (
  SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS tok FROM benchmark
), kr AS (
  SELECT qid, tok, row_number() OVER (PARTITION BY qid ORDER BY length(tok) DESC, tok) AS r FROM kt
), kw AS (SELECT qid, tok FROM kr WHERE r <= 3),
khr AS (
  SELECT b.item_id AS qid,
         CASE WHEN count(kw.tok) = 0 THEN 1.0
              ELSE sum(CASE WHEN strpos(lower(coalesce(a.answer, '')), lower(kw.tok)) > 0 THEN 1 ELSE 0 END)
                   / count(kw.tok) END AS keyword_hit_rate
  FROM benchmark b LEFT JOIN kw ON kw.qid = b.item_id LEFT JOIN ans a ON a.qid = b.item_id
  GROUP BY b.item_id
)"""

SQL_EVAL = SQL_ANSWERS + "," + sql_verdicts("benchmark", "item_id", "qid") + """,
erows AS (
  SELECT b.item_id AS qid, coalesce(a.n_sources, 0) AS n_sources, k.keyword_hit_rate,
         j.faithfulness, j.relevance, j.completeness, j.citation, j.overall, j.judge_ok
  FROM benchmark b LEFT JOIN ans a ON a.qid = b.item_id LEFT JOIN khr k ON k.qid = b.item_id
  LEFT JOIN judged j ON j.qid = b.item_id
)"""


def _hit_rows(spark, d):
    """Hits with source and text.  A hit's text is cut from its document: no chunk is made again for it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.col("text").alias("_t"))
    hm = R.attach(_rag_hits(spark, d), docs, ["doc"], "inner")
    start = F.col("chunk_no") * (C.CHUNK_SIZE - C.CHUNK_OVERLAP)
    return hm.withColumn("text", F.substring("_t", start + 1, F.lit(C.CHUNK_SIZE))).drop("_t").withColumn(
        "source", F.coalesce("source", F.lit("Unknown")))


def _answers(spark, d):
    return extractive_answers(_hit_rows(spark, d))


def _questions(spark, d):
    return text_questions(table(spark, d, "benchmark"))


def _eval_rows(spark, d):
    qs = _questions(spark, d)
    verdicts = J.parse_verdicts(raw_verdicts(qs.select("qid"), "qid"), "raw")
    return EV.evaluation_rows(qs, _answers(spark, d).select("qid", "answer", "n_sources"), verdicts)


@register("ungrounded_numbers", "WITH " + SQL_ANSWERS + r""",
u AS (
  SELECT qid, list_sort(list_distinct(list_filter(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?'),
           lambda x: NOT list_contains(regexp_extract_all(context, '[0-9]+(?:\.[0-9]+)?'), x)))) AS u
  FROM ans
)
SELECT qid, len(u) AS n_ungrounded, array_to_string(u, ',') AS ungrounded FROM u""")
def ungrounded_numbers(spark, d):
    """Numbers in each answer that do not occur word for word in its context."""
    a = _answers(spark, d).withColumn("_u", J.ungrounded_numbers("answer", "context"))
    return a.select("qid", F.size("_u").alias("n_ungrounded"), F.array_join("_u", ",").alias("ungrounded"))


@register("citation_check", "WITH " + SQL_ANSWERS + r""",
c AS (
  SELECT qid, len(sources) AS n_sources, len(list_filter(sources, lambda s: strpos(answer, s) > 0)) AS n_cited,
         list_sort(list_distinct(list_filter(regexp_extract_all(answer, '\[([^\]\[]+)\]', 1),
                                             lambda b: NOT list_contains(sources, b)))) AS unk
  FROM ans
)
SELECT qid, n_sources, n_cited, round(n_cited / n_sources, 6) AS cited_share,
       array_to_string(unk, ',') AS unknown_citations
FROM c""")
def citation_check(spark, d):
    """Retrieved sources named in the answer, their share, and cited names never retrieved."""
    a = _answers(spark, d)
    cited = F.size(J.cited_sources("answer", "sources"))
    return a.select("qid", F.size("sources").alias("n_sources"), cited.alias("n_cited"),
                    F.round(cited / F.size("sources"), 6).alias("cited_share"),
                    F.array_join(J.unknown_citations("answer", "sources"), ",").alias("unknown_citations"))


@register("confidence_extract", "WITH " + SQL_ANSWERS + r"""
SELECT qid, TRY_CAST(nullif(regexp_extract(answer, '[Cc]onfidence[^0-9]*([0-9]{1,3})[ \t]*%', 1), '') AS BIGINT)
         AS confidence
FROM ans""")
def confidence_extract(spark, d):
    """Self-reported confidence percentage of each answer."""
    return _answers(spark, d).select("qid", J.confidence("answer").alias("confidence"))


SQL_CONF = SQL_ANSWERS + r""",
cf AS (
  SELECT a.qid, TRY_CAST(nullif(regexp_extract(a.answer, '[Cc]onfidence[^0-9]*([0-9]{1,3})[ \t]*%', 1), '') AS BIGINT) AS confidence,
         CAST(k.keyword_hit_rate AS DOUBLE) AS outcome
  FROM ans a JOIN khr k USING (qid)
), known AS (SELECT * FROM cf WHERE confidence IS NOT NULL AND outcome IS NOT NULL),
bins AS (
  SELECT CAST(least(floor(confidence / 10.0), 9) AS BIGINT) AS bin, count(*) AS n, avg(confidence / 100.0) AS c, avg(outcome) AS o
  FROM known GROUP BY 1
)"""


def _stated(spark, d):
    """Confidence that each answer states, and its keyword hit rate as the outcome."""
    rows = _answers(spark, d).select("qid", J.confidence("answer").alias("confidence"), "answer")
    kw = _questions(spark, d).select("qid", "expected_keywords")
    return rows.join(kw, "qid").select("qid", "confidence", EV.keyword_hit_rate("expected_keywords", "answer").alias("outcome"))


@register("calibration_bins", "WITH " + SQL_CONF + """
SELECT bin, n, round(c, 6) AS avg_confidence, round(o, 6) AS avg_outcome, round(abs(c - o), 6) AS gap FROM bins""")
def calibration_bins(spark, d):
    """Reliability of stated confidence: answers by tenth of confidence against their mean keyword hit rate."""
    return J.reliability_bins(_stated(spark, d))


@register("calibration_summary", "WITH " + SQL_CONF + """,
ranks AS (
  SELECT (rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0) AS a,
         (rank() OVER (ORDER BY outcome) + (count(*) OVER (PARTITION BY outcome) - 1) / 2.0) AS b FROM known
)
SELECT (SELECT count(*) FROM known) AS n, (SELECT round(sum(n * abs(c - o)) / sum(n), 6) FROM bins) AS ece,
       (SELECT round(max(abs(c - o)), 6) FROM bins) AS max_gap,
       (SELECT round(avg((confidence / 100.0 - outcome) * (confidence / 100.0 - outcome)), 6) FROM known) AS brier,
       (SELECT round(corr(a, b), 6) FROM ranks) AS spearman""")
def calibration_summary(spark, d):
    """Expected calibration error, largest gap, Brier score and Spearman correlation of stated confidence."""
    return J.calibration_summary(_stated(spark, d))


@register("calibration_fit")
def calibration_fit(spark, d):
    """The nondecreasing calibration curve (pool adjacent violators over one row per confidence value; rows only,
    a test holds it against brute force)."""
    return J.isotonic_fit(_stated(spark, d))


def _sql_render(template: str, **cols: str) -> str:
    pieces, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in cols:
            continue
        pieces.append("'" + template[pos:m.start()].replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        pieces.append(f"coalesce({cols[m.group(1)]}, '')")
        pos = m.end()
    pieces.append("'" + template[pos:].replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(pieces)


@register("render_prompts", "WITH " + SQL_ANSWERS + f""",
jc AS (SELECT qid, string_agg('[' || source || ']: ' || substr(text, 1, 80), chr(10) ORDER BY rank) AS jctx
       FROM hm GROUP BY qid),
p AS (
  SELECT b.item_id AS qid,
         {_sql_render(J.ANSWER_TEMPLATE, question='b.text', context='a.context')} AS answer_prompt,
         {_sql_render(J.JUDGE_TEMPLATE, question='b.text', context='jc.jctx', answer='a.answer')} AS judge_prompt,
         {_sql_render(J.REWRITE_TEMPLATE, question='b.text')} AS rewrite_prompt
  FROM benchmark b LEFT JOIN ans a ON a.qid = b.item_id LEFT JOIN jc ON jc.qid = b.item_id
)
SELECT qid, md5(answer_prompt) AS answer_prompt_md5, length(answer_prompt) AS answer_prompt_chars,
       md5(judge_prompt) AS judge_prompt_md5, md5(rewrite_prompt) AS rewrite_prompt_md5
FROM p""")
def render_prompts(spark, d):
    """Answer, judge and rewrite prompts for every question (judge sees 80-character previews, D8)."""
    qs = _questions(spark, d)
    hm = _hit_rows(spark, d).checkpoint()  # answers and previews come from one search
    a, jc = extractive_answers(hm), R.judge_context(hm)
    p = qs.join(a, "qid", "left").join(jc, "qid", "left").select(
        "qid",
        J.render(J.ANSWER_TEMPLATE, question="question", context="context").alias("ap"),
        J.render(J.JUDGE_TEMPLATE, question="question", context="context_preview", answer="answer").alias("jp"),
        J.render(J.REWRITE_TEMPLATE, question="question").alias("rp"))
    return p.select("qid", F.md5("ap").alias("answer_prompt_md5"), F.length("ap").alias("answer_prompt_chars"),
                    F.md5("jp").alias("judge_prompt_md5"), F.md5("rp").alias("rewrite_prompt_md5"))


@register("rag_rows", "WITH " + SQL_ANSWERS + """,
rw AS (SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'q: ' || text WHEN item_id % 3 = 1 THEN '  ' END AS reply FROM benchmark),
ctx AS (
  SELECT qid, md5(string_agg('--- DOC ' || rank || ' | ' || source || ' | Similarity: ' || printf('%.2f%%', score * 100) || ' (' ||
           CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END || ') ---' || chr(10) || text || chr(10) || chr(10),
           '' ORDER BY rank)) AS context_md5,
         md5(string_agg('[' || source || ']: ' || substr(text, 1, 80), chr(10) ORDER BY rank)) AS preview_md5,
         md5(string_agg(text, '|' ORDER BY rank)) AS contents_md5
  FROM hm GROUP BY qid)
SELECT b.item_id AS qid, CASE WHEN b.item_id % 3 = 0 THEN 'q: ' || b.text ELSE b.text END AS query_used,
       coalesce(a.n_sources, 0) AS n_sources, c.context_md5, c.preview_md5, c.contents_md5, md5(a.answer) AS answer_md5
FROM benchmark b LEFT JOIN ans a ON a.qid = b.item_id LEFT JOIN ctx c ON c.qid = b.item_id""")
def rag_rows(spark, d):
    """R13/R6 as production keeps it: one row per question with the query used, its context, full sources and answer."""
    qs = _questions(spark, d)
    replies = qs.select("qid", F.when(F.col("qid") % 3 == 0, F.concat(F.lit("q: "), "question")).when(F.col("qid") % 3 == 1, "  ").alias("reply"))
    hm = _hit_rows(spark, d).checkpoint()
    rows = R.rag_rows(J.with_rewrites(qs, replies), hm, extractive_answers(hm).select("qid", "answer"))
    contents = F.array_join(F.transform("sources_details", lambda x: x["content"]), "|")
    return rows.select("qid", "query_used", "n_sources", F.md5("context").alias("context_md5"), F.md5("context_preview").alias("preview_md5"),
                       F.md5(contents).alias("contents_md5"), F.md5("answer").alias("answer_md5"))


@register("evaluation_details", "WITH " + SQL_ANSWERS + "," + sql_verdicts("benchmark", "item_id", "qid") + """,
sim AS (SELECT qid, round(avg(score), 6) AS avg_similarity FROM hits GROUP BY qid)
SELECT b.item_id AS qid, b.text AS query_used, coalesce(a.n_sources, 0) AS n_sources, s.avg_similarity,
       substr(coalesce(a.answer, ''), 1, 300) || '...' AS answer_preview, j.faithfulness, j.relevance, j.completeness, j.citation, j.overall,
       j.completeness_missing, j.faithfulness_issues, j.feedback, j.judge_ok
FROM benchmark b LEFT JOIN ans a ON a.qid = b.item_id LEFT JOIN sim s ON s.qid = b.item_id LEFT JOIN judged j ON j.qid = b.item_id""")
def evaluation_details(spark, d):
    """K6/V2: the stored report's detail rows."""
    qs = _questions(spark, d)
    hm = _hit_rows(spark, d).checkpoint()
    rows = R.rag_rows(qs.withColumn("query_used", F.col("question")), hm, extractive_answers(hm).select("qid", "answer"))
    return EV.evaluation_details(rows, hm, J.parse_verdicts(raw_verdicts(qs.select("qid"), "qid"), "raw"))


@register("keyword_hit_rate", "WITH " + SQL_ANSWERS + """
SELECT qid, round(keyword_hit_rate, 6) AS keyword_hit_rate FROM khr""")
def keyword_hit_rate(spark, d):
    """V1: share of each question's expected keywords found in its answer."""
    qs = _questions(spark, d)
    a = _answers(spark, d).select("qid", "answer")
    return qs.join(a, "qid", "left").select(
        "qid", F.round(EV.keyword_hit_rate("expected_keywords", "answer"), 6).alias("keyword_hit_rate"))


@register("evaluation_rows", "WITH " + SQL_EVAL + """
SELECT qid, n_sources, round(keyword_hit_rate, 6) AS keyword_hit_rate, faithfulness, relevance, completeness,
       citation, overall, judge_ok
FROM erows""")
def evaluation_rows(spark, d):
    """V2/V6: one evaluation row per question: sources, keyword rate, verdict marks."""
    r = _eval_rows(spark, d)
    return r.select("qid", "n_sources", F.round("keyword_hit_rate", 6).alias("keyword_hit_rate"),
                    *EV.METRICS, "judge_ok")


@register("metric_averages", "WITH " + SQL_EVAL + """
SELECT count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(relevance), 6) AS relevance,
       round(avg(completeness), 6) AS completeness, round(avg(citation), 6) AS citation,
       round(avg(overall), 6) AS overall, round(avg(keyword_hit_rate), 6) AS keyword_hit_rate
FROM erows""")
def metric_averages(spark, d):
    """V3: mean of every metric over the evaluation set."""
    m = EV.metric_averages(_eval_rows(spark, d))
    return m.select("n", *[F.round(c, 6).alias(c) for c in EV.METRICS + ["keyword_hit_rate"]])


@register("gate_failing_rows", "WITH " + SQL_EVAL + """
SELECT qid, 'returns_sources' AS test, CAST(n_sources AS DOUBLE) AS value FROM erows WHERE n_sources <= 0
UNION ALL
SELECT qid, 'faithfulness_above_threshold' AS test, faithfulness AS value FROM erows WHERE faithfulness < 4.0""")
def gate_failing_rows(spark, d):
    """V4: questions failing a per-row gate."""
    return EV.gate_failing_rows(_eval_rows(spark, d))


@register("quality_gates", "WITH " + SQL_EVAL + """,
a AS (SELECT avg(overall) AS mo, min(faithfulness) AS mf, avg(keyword_hit_rate) AS mk,
             CAST(min(n_sources) AS DOUBLE) AS ms FROM erows),
g AS (
  SELECT 'mean_overall' AS test, mo AS value, 5.0 AS threshold FROM a
  UNION ALL SELECT 'min_faithfulness', mf, 4.0 FROM a
  UNION ALL SELECT 'mean_keyword_hit_rate', mk, 0.5 FROM a
  UNION ALL SELECT 'min_n_sources', ms, 1.0 FROM a
), gp AS (SELECT test, value, threshold, coalesce(value >= threshold, false) AS passed FROM g)
SELECT test, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold, passed FROM gp
UNION ALL SELECT 'all_passed', NULL, NULL, bool_and(passed) FROM gp""")
def quality_gates(spark, d):
    """V5: set gates as rows (test, value, threshold, passed) and all_passed."""
    g = EV.quality_gates(_eval_rows(spark, d))
    return g.select("test", F.round("value", 6).alias("value"), "threshold", "passed")
