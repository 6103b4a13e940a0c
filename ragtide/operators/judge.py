"""Judge verdicts and answer checks: clean, strict-parse, score, band; grounding checks; prompts.

All row-local expressions (no shuffle): a verdict table of any size is processed
in the tasks that read it.  The JSON validity test is a chain of plain replacements that
rejects what a strict JSON parser rejects (trailing text, truncation, trailing
commas, leading zeros), because ``from_json`` alone accepts trailing text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference.
#   fences removed: "```json" then "```"; optional fields default "N/A";
#   failed verdict: all marks 0, feedback "Parse error: " + first 100 characters of the raw reply
#   failed judge call: all marks 0, feedback "Eval error: " + the error text
#   overall = mean of the four marks, rounded half-even to 2 digits (notebook) or 1 (library)
#   verdict bands: >= 7 high, >= 4 mid, otherwise low
MARKS = ["faithfulness", "relevance", "completeness", "citation"]
NOT_AVAILABLE = "N/A"
PARSE_ERROR = "Parse error: "
EVAL_ERROR = "Eval error: "
HIGH_FROM, MID_FROM = 7.0, 4.0

VERDICT_SCHEMA = T.StructType(
    [T.StructField(m, T.DoubleType()) for m in MARKS + ["overall"]]
    + [T.StructField(f, T.StringType()) for f in ("completeness_missing", "faithfulness_issues", "feedback")]
)

# Python's str.strip() whitespace; Spark's trim removes spaces only.
_WS = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_JW = r"[ \t\n\r]"
_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
_STRING = r'"[^"\\\x00-\x1f]*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_py(s) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(F.regexp_replace(_c(s), rf"\A{_WS}+", ""), rf"{_WS}+\z", "")


def clean(raw) -> Column:
    """Strip, drop code fences, strip again."""
    return strip_py(F.replace(F.replace(strip_py(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def well_formed(s) -> Column:
    """J2 validity: one JSON object and nothing else; its values may be lists and objects.

    Escapes become a plain letter, then each string one ``S``, each other scalar one ``V`` (``NaN`` and the infinities
    too, which the reference's parser takes); what is left is short, and inner lists and objects fold to ``V`` level by
    level, as many times as the reply's brackets are deep.  No pattern here backtracks over repeated groups, so
    replies of any length are safe.
    """
    t = F.regexp_replace(_c(s), _ESCAPE, "e")
    t = F.regexp_replace(t, _STRING, "S")
    # a scalar must stand between separators, so that "1 2" or "truefalse" don't pass
    t = F.regexp_replace(t, rf"(?<![A-Za-z0-9.+-])(?:true|false|null|NaN|-?Infinity|{_NUMBER})(?![A-Za-z0-9.+-])", "V")
    t = F.regexp_replace(t, rf"(?<=[\[\]{{}}:,]|^){_JW}++|{_JW}++(?=[\[\]{{}}:,]|$)", "")
    member = r"S:[SV]"
    inner = rf"(?<=[\[:,])(?:\[(?:[SV](?:,[SV])*+)?\]|\{{(?:{member}(?:,{member})*+)?\}})"
    t = F.aggregate(F.sequence(F.lit(1), F.greatest(_depth(t), F.lit(1))), t, lambda acc, _: F.regexp_replace(acc, inner, "V"))
    return F.coalesce(t.rlike(rf"\A\{{(?:{member}(?:,{member})*+)?\}}\z"), F.lit(False))


def _depth(t: Column) -> Column:
    """How deep the brackets of a text without strings are nested."""
    marks = F.split(F.regexp_replace(t, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, mark):
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.coalesce(F.aggregate(marks, start, step, lambda acc: acc["most"]), F.lit(0))


def failed_verdicts(df: DataFrame, error: str = "error") -> DataFrame:
    """J5 where the judge call itself failed: zeros and 'Eval error: ' + the error text."""
    zeros = [F.lit(0.0).alias(m) for m in MARKS + ["overall"]]
    return df.select(*[c for c in df.columns if c != error], *zeros,
                     F.concat(F.lit(EVAL_ERROR), F.coalesce(F.col(error), F.lit(""))).alias("feedback"),
                     F.lit(False).alias("judge_ok"))


def parse_verdicts(df: DataFrame, raw: str = "raw", digits: int = 2) -> DataFrame:
    """Raw judge replies -> scores with fallback and ``judge_ok``.

    A verdict is accepted only if it is a well-formed object whose four marks
    are numbers (a quoted or missing mark fails, as the reference's arithmetic would; so does NaN, which no mean survives).
    Accepted: overall recomputed (J3), optional fields default to 'N/A' (J4).
    Rejected: zeros and 'Parse error: ' + first 100 characters (J5).
    """
    cl = clean(raw)
    parsed = F.from_json(cl, VERDICT_SCHEMA)
    d = df.withColumn("_clean", cl).withColumn("_v", parsed)
    ok = well_formed("_clean") & F.col("_v").isNotNull()
    for m in MARKS:
        ok = ok & F.col(f"_v.{m}").isNotNull() & ~F.isnan(F.col(f"_v.{m}"))
    d = d.withColumn("judge_ok", ok)
    zero = F.lit(0.0)
    mean = sum((F.col(f"_v.{m}") for m in MARKS[1:]), F.col(f"_v.{MARKS[0]}")) / 4.0
    cols = [F.when(F.col("judge_ok"), F.col(f"_v.{m}")).otherwise(zero).alias(m) for m in MARKS]
    cols.append(F.when(F.col("judge_ok"), F.bround(mean, digits)).otherwise(zero).alias("overall"))
    for f in ("completeness_missing", "faithfulness_issues"):
        cols.append(F.when(F.col("judge_ok"), F.coalesce(F.col(f"_v.{f}"), F.lit(NOT_AVAILABLE)))
                    .otherwise(F.lit(NOT_AVAILABLE)).alias(f))
    cols.append(F.when(F.col("judge_ok"), F.col("_v.feedback"))
                .otherwise(F.concat(F.lit(PARSE_ERROR), F.substring(_c(raw), 1, 100))).alias("feedback"))
    keep = [c for c in df.columns if c != raw]
    return d.select(*keep, *cols, "judge_ok")


def verdict_band(mark) -> Column:
    """High / mid / low."""
    m = _c(mark)
    return F.when(m >= HIGH_FROM, "high").when(m >= MID_FROM, "mid").otherwise("low")


# ------------------------------------------------------------------ deterministic answer checks

NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def ungrounded_numbers(answer, context) -> Column:
    """Sorted distinct numbers of the answer that do not occur in the context."""
    a = F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(NUMBER), F.lit(0))
    c = F.regexp_extract_all(F.coalesce(_c(context), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_except(a, c))


def cited_sources(answer, sources) -> Column:
    """Retrieved source names that the answer mentions."""
    ans = F.coalesce(_c(answer), F.lit(""))
    return F.filter(_c(sources), lambda s: F.instr(ans, s) > 0)


def unknown_citations(answer, sources) -> Column:
    """Bracketed names in the answer that are not among the retrieved sources."""
    br = F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(r"\[([^\]\[]+)\]"), F.lit(1))
    return F.array_sort(F.array_except(br, _c(sources)))


def confidence(answer) -> Column:
    """Self-reported confidence percentage at the end of an answer, or NULL."""
    return F.expr("try_cast(nullif(regexp_extract({}, '[Cc]onfidence[^0-9]*([0-9]{{1,3}})[ \\t]*%', 1), '') AS INT)"
                  .format(_sql_ref(answer)))


def _sql_ref(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("confidence() takes a column name")


# ------------------------------------------------------------------ prompts

# Our own template texts; placeholders are {question}, {context}, {answer}.
ANSWER_TEMPLATE = (
    "Answer the question using only the numbered documents below. Name the source file for each "
    "claim, state plainly when the documents do not contain the answer, and end with a confidence "
    "percentage.\nQuestion: {question}\nDocuments:\n{context}\nAnswer:"
)
JUDGE_TEMPLATE = (
    "Rate the answer from 0 to 10 on faithfulness, relevance, completeness and citation, and reply "
    "with one JSON object holding those four numbers and a one-sentence feedback.\n"
    "Question: {question}\nContext: {context}\nAnswer: {answer}"
)
REWRITE_TEMPLATE = "Rewrite the question as a precise search query; reply with the query only.\nQuestion: {question}"


def with_rewrites(questions: DataFrame, replies: DataFrame, *, q_id: str = "qid", question: str = "question",
                  reply: str = "reply") -> DataFrame:
    """R12 (join-back): questions plus ``query_used``: the model's rewrite, or the question where it gave none."""
    r = replies.select(q_id, F.nullif(strip_py(reply), F.lit("")).alias("_rewrite"))
    return questions.join(r, q_id, "left").withColumn("query_used", F.coalesce("_rewrite", question)).drop("_rewrite")


def render(template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders from columns in one pass (NULL becomes '').

    The template is split once on the driver; the prompt is a ``concat`` of literal
    pieces and columns, so text inside a column is never substituted again.
    """
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in cols:
            continue
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(_c(cols[m.group(1)]), F.lit("")))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# ------------------------------------------------------------------ calibration of stated confidence

def reliability_bins(rows: DataFrame, *, confidence: str = "confidence", outcome: str = "outcome", bins: int = 10) -> DataFrame:
    """Answers by stated confidence in equal bins of 0-100 (100 joins the last): (bin, n, avg_confidence, avg_outcome, gap).

    ``outcome`` lies between 0 and 1, as the confidence does after division by 100; rows without either are left out."""
    known = rows.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull())
    width = 100.0 / bins
    no = F.least(F.floor(F.col(confidence) / width), F.lit(bins - 1)).cast("bigint")
    agg = known.groupBy(no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(confidence) / 100.0).alias("c"), F.avg(outcome).alias("o"))
    return agg.select("bin", "n", F.round("c", 6).alias("avg_confidence"), F.round("o", 6).alias("avg_outcome"), F.round(F.abs(F.col("c") - F.col("o")), 6).alias("gap"))


def calibration_summary(rows: DataFrame, *, confidence: str = "confidence", outcome: str = "outcome", bins: int = 10) -> DataFrame:
    """One row: n, expected calibration error (bin gaps weighed by their rows), largest gap, Brier score and Spearman's
    rank correlation (mid-ranks of equal values, from counts per value)."""
    known = rows.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull()).select(
        F.col(confidence).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    width = 100.0 / bins
    no = F.least(F.floor(F.col("x") / width), F.lit(bins - 1))
    by_bin = known.groupBy(no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(F.col("x") / 100.0) - F.avg("y")).alias("gap"))
    ece = by_bin.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("max_gap"))
    brier = known.agg(F.avg(F.pow(F.col("x") / 100.0 - F.col("y"), 2)).alias("brier"))
    pairs = known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"))  # confidence takes few values, outcomes those of marks
    ranked = pairs.join(_mid_ranks(pairs, "x"), "x").join(_mid_ranks(pairs, "y"), "y")
    w, a, b = F.col("m"), F.col("rank_x"), F.col("rank_y")
    total = lambda e: F.sum(w * e) / F.sum(w)
    spread = F.sqrt((total(a * a) - total(a) * total(a)) * (total(b * b) - total(b) * total(b)))
    rho = ranked.agg(((total(a * b) - total(a) * total(b)) / F.nullif(F.round(spread, 9), F.lit(0.0))).alias("spearman"))
    return ece.join(brier).join(rho).select("n", *(F.round(c, 6).alias(c) for c in ("ece", "max_gap", "brier", "spearman")))


def _mid_ranks(pairs: DataFrame, c: str) -> DataFrame:
    """(value, rank of its middle row), from counts per value."""
    counts = pairs.groupBy(c).agg(F.sum("m").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(c))  # over distinct values only
    return counts.select(c, (upto - F.col("_n") / 2.0 + 0.5).alias(f"rank_{c}"))


def isotonic_fit(rows: DataFrame, *, confidence: str = "confidence", outcome: str = "outcome") -> DataFrame:
    """(confidence, n, avg_outcome, calibrated): the nondecreasing curve nearest to the outcomes by least squares.

    Pool-adjacent-violators over one row per confidence value: rows are counted and averaged by Spark first, so the
    one task that walks the curve sees values (whole percents: 101 at most), not answers."""
    values = rows.where(F.col(confidence).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.col(confidence).cast("bigint").alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("avg_outcome"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("confidence")
        blocks: list[list[float]] = []  # [sum, rows, values]
        for n, mean in zip(pdf["n"], pdf["avg_outcome"]):
            blocks.append([n * mean, n, 1])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        return pdf.assign(calibrated=np.repeat([s / n for s, n, _ in blocks], [k for *_, k in blocks]))

    out = values.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: pool(pdf.drop(columns="all")), "confidence bigint, n bigint, avg_outcome double, calibrated double")
    return out.select("confidence", "n", F.round("avg_outcome", 6).alias("avg_outcome"), F.round("calibrated", 6).alias("calibrated"))
