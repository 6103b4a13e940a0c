"""Monitoring queries over interaction records derived from every `events` row.

Reference window = records before 2024-01-16 (frozen by ``freeze_reference``);
current window = the rest.  The 24-hour window ends at the newest record.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ragtide.functions.relational import with_scalars
from ragtide.operators import ingest as I
from ragtide.operators import monitor as M
from ragtide.plans.registry import register
from ragtide.sources import sinks as K
from ragtide.sources import tables as S
from ragtide.sources.derived import interaction_records
from ragtide.sources.tables import table

SPLIT = "2024-01-16 00:00:00"

SQL_REC = f"""
rec AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
    CASE WHEN event_type = 'error' THEN 'No relevant documents found.' ELSE 'answer ' || CAST(event_id AS VARCHAR) END
      AS answer,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value / 10.0, 10.0) END AS faithfulness,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(value / 8.0, 10.0) END AS overall
  FROM events
), flagged AS (
  SELECT *, coalesce(strpos(answer, 'No relevant documents found') > 0, false) AS no_answer FROM rec
), w24 AS (
  SELECT * FROM flagged WHERE ts >= (SELECT max(ts) FROM flagged) - INTERVAL 1 DAY
), refw AS (SELECT * FROM flagged WHERE ts < TIMESTAMP '{SPLIT}'),
curw AS (SELECT * FROM flagged WHERE ts >= TIMESTAMP '{SPLIT}')"""


def _rec(spark, d):
    return interaction_records(table(spark, d, "events"))


def _split(spark, d):
    r = _rec(spark, d)
    edge = F.lit(SPLIT).cast("timestamp")
    return r.where(F.col("ts") < edge), r.where(F.col("ts") >= edge)


@register("no_answer_flag", "WITH " + SQL_REC + """
SELECT event_id, no_answer FROM flagged""")
def no_answer_flag(spark, d):
    """M1: no-answer flag of every interaction."""
    return _rec(spark, d).select("event_id", M.no_answer_flag("answer").alias("no_answer"))


@register("window_24h", "WITH " + SQL_REC + """
SELECT event_id FROM w24""")
def window_24h(spark, d):
    """S3: interactions of the last 24 hours (inclusive cutoff)."""
    return M.window_24h(_rec(spark, d)).select("event_id")


@register("window_summary", "WITH " + SQL_REC + """
SELECT round(avg(faithfulness), 6) AS avg_faithfulness, round(avg(CAST(no_answer AS INTEGER)), 6) AS no_answer_rate,
       count(*) AS n_requests
FROM w24""")
def window_summary(spark, d):
    """M2: mean faithfulness, no-answer rate and volume of the last 24 hours."""
    s = M.summarize(M.window_24h(_rec(spark, d)))
    return s.select(F.round("avg_faithfulness", 6).alias("avg_faithfulness"),
                    F.round("no_answer_rate", 6).alias("no_answer_rate"), "n_requests")


@register("reference_fallback", "WITH " + SQL_REC + """,
cs AS (SELECT avg(faithfulness) AS cur FROM w24),
rs AS (SELECT avg(faithfulness) AS ref, count(*) AS n FROM refw)
SELECT round(cur, 6) AS avg_faithfulness, round(CASE WHEN n = 0 THEN cur ELSE ref END, 6) AS ref_avg_faithfulness,
       CASE WHEN n = 0 THEN 'current' ELSE 'reference' END AS reference_source
FROM cs, rs""")
def reference_fallback(spark, d):
    """Reference mean faithfulness, falling back to the current window when no reference exists."""
    ref, _ = _split(spark, d)
    s = M.with_reference(M.summarize(M.window_24h(_rec(spark, d))), ref)
    return s.select(F.round("avg_faithfulness", 6).alias("avg_faithfulness"),
                    F.round("ref_avg_faithfulness", 6).alias("ref_avg_faithfulness"), "reference_source")


@register("log_chain", "WITH " + SQL_REC + """
SELECT round(avg(faithfulness), 6) AS avg_faithfulness, round(avg(CAST(no_answer AS INTEGER)), 6) AS no_answer_rate,
       count(*) AS n_requests, (SELECT round(avg(faithfulness), 6) FROM refw) AS ref_avg_faithfulness
FROM w24""")
def log_chain(spark, d):
    """S3 + K4 + M2 + M3: interactions appended as JSON by day, read back as logs, last 24 hours against the reference."""
    root = I.scratch_path(spark, "log-chain")
    K.write_interaction_log(_rec(spark, d), f"{root}/logs")
    logs = S.read_interaction_logs(spark, f"{root}/logs")
    s = M.with_reference(M.summarize(M.window_24h(logs)), logs.where(F.col("ts") < F.lit(SPLIT).cast("timestamp")))
    return s.select(*[F.round(c, 6).alias(c) for c in ("avg_faithfulness", "no_answer_rate", "ref_avg_faithfulness")], "n_requests")


def _sql_colsum(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing,
       round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(quantile_disc({c}, 0.25), 6) AS p25,
       round(quantile_disc({c}, 0.5), 6) AS p50, round(quantile_disc({c}, 0.75), 6) AS p75,
       (SELECT round(v, 6) FROM (SELECT {c} AS v, count(*) AS k FROM flagged WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1) AS mode,
       count(DISTINCT {c}) AS n_distinct FROM flagged"""


@register("column_summary", "WITH " + SQL_REC + "\n" + _sql_colsum("faithfulness") + "\nUNION ALL\n"
          + _sql_colsum("overall"))
def column_summary(spark, d):
    """M4: summary statistics of faithfulness and overall over all interactions."""
    s = M.column_summary(_rec(spark, d), ["faithfulness", "overall"])
    return s.select("column_name", "n", "n_missing",
                    *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p25", "p50", "p75", "mode")],
                    "n_distinct")


SQL_KS = """,
rb AS (SELECT overall AS bin, count(*) AS r FROM refw WHERE overall IS NOT NULL GROUP BY 1),
cb AS (SELECT overall AS bin, count(*) AS c FROM curw WHERE overall IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(rb.bin, cb.bin) AS bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c
      FROM rb FULL OUTER JOIN cb ON rb.bin = cb.bin),
cum AS (
  SELECT sum(r) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(r) OVER () AS f1,
         sum(c) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(c) OVER () AS f2,
         sum(r) OVER () AS n1, sum(c) OVER () AS n2
  FROM j
), s AS (SELECT max(abs(f1 - f2)) AS d, CAST(first(n1) AS BIGINT) AS n1, CAST(first(n2) AS BIGINT) AS n2 FROM cum),
l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM s),
p AS (
  SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * list_reduce(
    list_prepend(0.0, list_transform(range(1, 101),
      lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam))),
    lambda a, b: a + b))) END AS p_value
  FROM l
)"""


@register("drift_ks", "WITH " + SQL_REC + SQL_KS + """
SELECT n1 AS n_reference, n2 AS n_current, round(d, 6) AS ks_statistic, round(p_value, 6) AS p_value,
       p_value < 0.05 AS drift
FROM p""")
def drift_ks(spark, d):
    """M5: KS drift of `overall`, current window against the reference window, on the values themselves."""
    ref, cur = _split(spark, d)
    k = M.drift_ks(ref, cur, "overall")
    return k.select("n_reference", "n_current", F.round("ks_statistic", 6).alias("ks_statistic"),
                    F.round("p_value", 6).alias("p_value"), "drift")


@register("drift_ks_sketch", "WITH " + SQL_REC + SQL_KS + """
SELECT n1 AS n_reference, n2 AS n_current, TRUE AS within_error FROM p""")
def drift_ks_sketch(spark, d):
    """M5, M9: KS drift from stored sketches per day, merged on both sides of the split, against the exact statistic."""
    path = I.scratch_path(spark, "sketches")
    M.daily_sketches(_rec(spark, d)).write.parquet(path)
    days, edge = spark.read.parquet(path), F.lit(SPLIT).cast("timestamp").cast("date")
    sides = [M.merged_sketch(days.where(c)) for c in (F.col("day") < edge, F.col("day") >= edge)]
    exact = M.drift_ks(*_split(spark, d)).select(F.col("ks_statistic").alias("exact"))
    out = with_scalars(M.drift_ks_sketch(*sides), exact)
    bound = 2 * M.SKETCH_RANK_ERROR + 1 / M.SKETCH_K
    return out.select("n_reference", "n_current", (F.abs(F.col("ks_statistic") - F.col("exact")) <= bound).alias("within_error"))


SQL_SHARES = """,
bins AS (SELECT range AS bin FROM range(10)),
rb AS (SELECT CAST(greatest(0, least(floor(overall), 9)) AS BIGINT) AS bin, count(*) AS r FROM refw WHERE overall IS NOT NULL GROUP BY 1),
cb AS (SELECT CAST(greatest(0, least(floor(overall), 9)) AS BIGINT) AS bin, count(*) AS c FROM curw WHERE overall IS NOT NULL GROUP BY 1),
j AS (SELECT bins.bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM bins
      LEFT JOIN rb ON rb.bin = bins.bin LEFT JOIN cb ON cb.bin = bins.bin),
sh AS (SELECT bin, r / sum(r) OVER () AS rs, c / sum(c) OVER () AS cs FROM j)"""


@register("drift_psi", "WITH " + SQL_REC + SQL_SHARES + """,
f AS (SELECT greatest(rs, 0.0001) AS rs, greatest(cs, 0.0001) AS cs FROM sh)
SELECT round(sum((cs - rs) * ln(cs / rs)), 6) AS psi, sum((cs - rs) * ln(cs / rs)) > 0.2 AS drift FROM f""")
def drift_psi(spark, d):
    """M5: population stability index of `overall` over unit bins."""
    ref, cur = _split(spark, d)
    p = M.drift_psi(ref, cur, "overall")
    return p.select(F.round("psi", 6).alias("psi"), "drift")


@register("drift_js", "WITH " + SQL_REC + SQL_SHARES + """
SELECT round(0.5 * sum(CASE WHEN rs > 0 THEN rs * log2(rs / ((rs + cs) / 2)) ELSE 0 END)
           + 0.5 * sum(CASE WHEN cs > 0 THEN cs * log2(cs / ((rs + cs) / 2)) ELSE 0 END), 6) AS js_divergence
FROM sh""")
def drift_js(spark, d):
    """M5: Jensen-Shannon divergence (base 2) of `overall` over unit bins."""
    ref, cur = _split(spark, d)
    return M.drift_js(ref, cur, "overall").select(F.round("js_divergence", 6).alias("js_divergence"))


SQL_DAILY = """,
daily AS (
  SELECT date_trunc('day', ts) AS ws, avg(faithfulness) AS avg_faithfulness,
         avg(CAST(no_answer AS INTEGER)) AS no_answer_rate, count(*) AS n_requests
  FROM flagged GROUP BY 1
)"""


def _daily(spark, d):
    return M.daily_quality(_rec(spark, d))


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@register("daily_quality", "WITH " + SQL_REC + SQL_DAILY + """
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, round(avg_faithfulness, 6) AS avg_faithfulness,
       round(no_answer_rate, 6) AS no_answer_rate, n_requests
FROM daily""")
def daily_quality(spark, d):
    """M7: quality per daily window over the whole log."""
    q = _daily(spark, d)
    return q.select(_fmt("window_start").alias("window_start"), F.round("avg_faithfulness", 6).alias("avg_faithfulness"),
                    F.round("no_answer_rate", 6).alias("no_answer_rate"), "n_requests")


@register("quality_trend", "WITH " + SQL_REC + SQL_DAILY + """
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, round(avg_faithfulness, 6) AS avg_faithfulness,
       round(avg_faithfulness - lag(avg_faithfulness) OVER (ORDER BY ws), 6) AS change
FROM daily""")
def quality_trend(spark, d):
    """M8: day-over-day change of mean faithfulness."""
    t = M.quality_trend(_daily(spark, d))
    return t.select(_fmt("window_start").alias("window_start"), F.round("avg_faithfulness", 6).alias("avg_faithfulness"),
                    F.round("change", 6).alias("change"))


@register("drift_alerts", "WITH " + SQL_REC + SQL_DAILY + """,
ra AS (SELECT avg(faithfulness) AS ref FROM refw),
s AS (SELECT daily.*, ra.ref FROM daily, ra)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, 'faithfulness_drop' AS kind,
       'Faithfulness en baisse: ' || printf('%.1f', ref) || ' -> ' || printf('%.1f', avg_faithfulness) AS message
FROM s WHERE ref - avg_faithfulness > 1.5
UNION ALL
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S'), 'no_answer_rate',
       'Taux de ''no answer'' élevé: ' || printf('%.0f', no_answer_rate * 100) || '%'
FROM s WHERE no_answer_rate > 0.15""")
def drift_alerts(spark, d):
    """M6 for every daily window against the frozen reference window."""
    ref, _ = _split(spark, d)
    s = M.with_reference(_daily(spark, d), ref)
    a = M.alerts(s, keys=["window_start"])
    return a.select(_fmt("window_start").alias("window_start"), "kind", "message")


@register("freeze_reference", "WITH " + SQL_REC + """
SELECT event_id, faithfulness, overall FROM refw""")
def freeze_reference(spark, d):
    """M9: write the reference window as a table (shared folder) and read it back."""
    ref, _ = _split(spark, d)
    path = I.scratch_path(spark, "reference-window")
    ref.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("event_id", "faithfulness", "overall")
