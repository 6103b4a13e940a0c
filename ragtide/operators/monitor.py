"""Monitoring: no-answer flag, window summaries, column summaries, drift tests, alerts, trends.

Plan shape: every statistic is a partial/final hash aggregate over the log table.
Distributions are reduced to counts per fixed-width bin *before* any window, so
the only unpartitioned windows run over at most a few hundred pre-aggregated rows
(bins, or one row per day), whatever the log volume.  Percentiles use the
mergeable quantile sketch of ``percentile_approx`` (bounded memory per group).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragtide.functions.relational import with_scalars

# Fixed values that must equal the reference.
#   no-answer marker text: "No relevant documents found"
#   alert when reference avg faithfulness - current avg > 1.5, or no-answer rate > 0.15 (strict)
#   messages: "Faithfulness en baisse: {ref:.1f} -> {cur:.1f}" and "Taux de 'no answer' élevé: {rate:.0%}"
NO_ANSWER_TEXT = "No relevant documents found"
FAITHFULNESS_DROP = 1.5
NO_ANSWER_RATE_MAX = 0.15
MSG_FAITHFULNESS = "Faithfulness en baisse: "
MSG_NO_ANSWER = "Taux de 'no answer' élevé: "

BINS = 10          # PSI / JS bins of width 1 on [0, 10]
SHARE_FLOOR = 1e-4


def no_answer_flag(answer, extra: list[str] | None = None) -> Column:
    """M1: answer contains the fixed no-answer text; NULL answer -> false.

    ``extra``: further literal markers counted as no-answer (D18, e.g. a model's own
    "not found" wording); the default counts only the fixed text, as the reference does.
    """
    a = F.col(answer) if isinstance(answer, str) else answer
    hit = F.instr(a, NO_ANSWER_TEXT) > 0
    for marker in extra or []:
        hit = hit | (F.instr(a, marker) > 0)
    return F.coalesce(hit, F.lit(False))


def window_24h(records: DataFrame, ts: str = "ts", now=None) -> DataFrame:
    """S3: records at or after now - 24 h (inclusive cutoff).  ``now`` defaults to the newest record.

    The newest timestamp is one number, taken first, so that the cutoff is a literal that
    reaches the scan (and its row groups) instead of a join condition.
    """
    if now is None:
        now = records.agg(F.max(ts)).first()[0]
        if now is None:
            return records.limit(0)
    return records.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY"))


def summarize(records: DataFrame) -> DataFrame:
    """M2: mean faithfulness (NULLs skipped), no-answer rate, request count — one partial aggregate."""
    return records.agg(
        F.avg("faithfulness").alias("avg_faithfulness"),
        F.avg(no_answer_flag("answer").cast("int")).alias("no_answer_rate"),
        F.count(F.lit(1)).alias("n_requests"),
    )


def with_reference(current_summary: DataFrame, reference: DataFrame) -> DataFrame:
    """Attach the reference mean faithfulness; an empty reference falls back to the current window.

    No emptiness action on the driver: both are one-row aggregates joined and coalesced.
    """
    ref = reference.agg(F.avg("faithfulness").alias("_ref"), F.count(F.lit(1)).alias("_nref"))
    j = with_scalars(current_summary, ref)
    use_cur = F.col("_nref") == 0
    return j.select(
        *current_summary.columns,
        F.when(use_cur, F.col("avg_faithfulness")).otherwise(F.col("_ref")).alias("ref_avg_faithfulness"),
        F.when(use_cur, F.lit("current")).otherwise(F.lit("reference")).alias("reference_source"),
    )


def alerts(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M6: alert rows (kind, message) for summaries with a reference mean; strict thresholds."""
    keys = keys or []
    drop = F.col("ref_avg_faithfulness") - F.col("avg_faithfulness")
    a1 = summary.where(drop > FAITHFULNESS_DROP).select(
        *keys, F.lit("faithfulness_drop").alias("kind"),
        F.concat(F.lit(MSG_FAITHFULNESS), F.format_string("%.1f", F.bround("ref_avg_faithfulness", 1)), F.lit(" -> "),
                 F.format_string("%.1f", F.bround("avg_faithfulness", 1))).alias("message"))
    a2 = summary.where(F.col("no_answer_rate") > NO_ANSWER_RATE_MAX).select(
        *keys, F.lit("no_answer_rate").alias("kind"),
        F.concat(F.lit(MSG_NO_ANSWER), F.format_string("%.0f%%", F.bround(F.col("no_answer_rate") * 100, 0))).alias("message"))
    return a1.unionByName(a2)


def running_counts(counts: DataFrame, key: str, cols: list[str], groups: list[str] | None = None) -> DataFrame:
    """``counts`` with running sums ``cum_<col>`` in the order of ``key``, within ``groups``.

    The rows are range-partitioned by key and summed within each partition; what lies before a
    partition comes from one row per partition and group, so no task sees the whole order.
    """
    groups = groups or []
    rows = counts.repartitionByRange(*groups, key).withColumn("_p", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_p", *groups).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups, F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_p", *groups).agg(*[F.sum(c).alias(c) for c in cols])
    sums = sums.select("_p", *groups, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in cols])
    out = rows
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(inside))
    out = out.join(sums, ["_p", *groups])
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"cum_{c}") + F.col(f"_before_{c}"))
    return out.drop("_p", *[f"_before_{c}" for c in cols])


def column_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """M4: one row per column: count, missing, min, max, mean, sample stddev, quartiles, mode, distinct.

    Quartiles and distinct counts are exact at every size: both follow from one table of counts per
    value, whose running sums are taken over range partitions.  Quartile p is the smallest
    value that at least a share p of the values do not exceed; the mode is the smallest of the most frequent values.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("x")).select("x.*")
    basic = long.groupBy("column_name").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    counts = long.where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("k"))
    ranked = running_counts(counts, "value", ["k"], ["column_name"]).join(F.broadcast(basic.select("column_name", "n")), "column_name")
    spread = ranked.groupBy("column_name").agg(
        *[F.min(F.when(F.col("cum_k") >= p * F.col("n"), F.col("value"))).alias(name)
          for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))],
        F.max_by("value", F.struct("k", -F.col("value"))).alias("mode"), F.count(F.lit(1)).alias("n_distinct"))
    out = basic.join(spread, "column_name", "left")  # one row per column
    return out.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


# ------------------------------------------------------------------ drift (M5)

def _bin_counts(df: DataFrame, col: str, bin_expr) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(bin_expr.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drift_ks(reference: DataFrame, current: DataFrame, col: str = "overall") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value on the values themselves.

    Counts per value (partial aggregate) -> full outer join -> running sums over range partitions.
    """
    b = F.col(col).cast("double")
    r = _bin_counts(reference, col, b).withColumnRenamed("n", "r")
    c = _bin_counts(current, col, b).withColumnRenamed("n", "c")
    j = r.join(c, "bin", "full_outer").fillna(0, ["r", "c"])
    run = running_counts(j, "bin", ["r", "c"])
    total = j.agg(F.sum("r").alias("n1"), F.sum("c").alias("n2"))
    s = with_scalars(run, total).agg(
        F.max(F.abs(F.col("cum_r") / F.nullif("n1", F.lit(0)) - F.col("cum_c") / F.nullif("n2", F.lit(0)))).alias("D"),
        F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    ne = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    L = (F.sqrt(ne) + 0.12 + 0.11 / F.sqrt(ne)) * F.col("D")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("_L") * F.col("_L")))
    out = s.withColumn("_L", L).withColumn(
        "p_value", F.when(F.col("_L") < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))))
    return out.select(F.col("n1").alias("n_reference"), F.col("n2").alias("n_current"), F.col("D").alias("ks_statistic"),
                      "p_value", (F.col("p_value") < 0.05).alias("drift"))


def _bin_shares(reference: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """Shares per bin of width 1 on [0, 10], the first and the last open-ended, all bins present."""
    b = unit_bin(F.col(col))
    r = _bin_counts(reference, col, b).withColumnRenamed("n", "r")
    c = _bin_counts(current, col, b).withColumnRenamed("n", "c")
    spark = reference.sparkSession
    bins = spark.range(BINS).select(F.col("id").alias("bin"))
    j = bins.join(r, "bin", "left").join(c, "bin", "left").fillna(0, ["r", "c"])
    tot = Window.partitionBy(F.lit(1))
    return j.select("bin", (F.col("r") / F.sum("r").over(tot)).alias("rs"), (F.col("c") / F.sum("c").over(tot)).alias("cs"))


def drift_psi(reference: DataFrame, current: DataFrame, col: str = "overall") -> DataFrame:
    """Population stability index over 10 unit bins; empty shares floored at 1e-4; drift when > 0.2."""
    s = _bin_shares(reference, current, col)
    rs = F.greatest(F.col("rs"), F.lit(SHARE_FLOOR))
    cs = F.greatest(F.col("cs"), F.lit(SHARE_FLOOR))
    out = s.agg(F.sum((cs - rs) * F.log(cs / rs)).alias("psi"))
    return out.select("psi", (F.col("psi") > 0.2).alias("drift"))


def drift_js(reference: DataFrame, current: DataFrame, col: str = "overall") -> DataFrame:
    """Jensen-Shannon divergence (base 2) over 10 unit bins; zero terms skipped."""
    s = _bin_shares(reference, current, col)
    m = (F.col("rs") + F.col("cs")) / 2.0
    tr = F.when(F.col("rs") > 0, F.col("rs") * F.log2(F.col("rs") / m)).otherwise(0.0)
    tc = F.when(F.col("cs") > 0, F.col("cs") * F.log2(F.col("cs") / m)).otherwise(0.0)
    return s.agg((0.5 * F.sum(tr) + 0.5 * F.sum(tc)).alias("js_divergence"))


def unit_bin(col) -> Column:
    """The unit bin of a mark on [0, 10], null for null; the first and the last bin are open-ended."""
    mark = F.col(col) if isinstance(col, str) else col
    return F.when(mark.isNotNull(), F.greatest(F.lit(0), F.least(F.floor(mark), F.lit(BINS - 1))).cast("bigint"))


def reference_shares(reference: DataFrame, cols: list[str]) -> dict[str, list[float]]:
    """Share of every unit bin per column: BINS numbers a column, whatever the reference's size; all null counts as zero."""
    counts = [F.count_if(unit_bin(c) == i).alias(f"{j}_{i}") for j, c in enumerate(cols) for i in range(BINS)]
    row = reference.agg(*counts).first()
    n = [[row[f"{j}_{i}"] for i in range(BINS)] for j in range(len(cols))]
    return {c: [x / max(1, sum(n[j])) for x in n[j]] for j, c in enumerate(cols)}


def psi_js(reference: list[float], counts: list[int]) -> tuple[float, float]:
    """Population stability index and Jensen-Shannon divergence of one window's bin counts, as ``drift_psi`` and ``drift_js`` define them."""
    psi = js = 0.0
    total = max(1, sum(counts))
    for r, n in zip(reference, counts):
        c = n / total
        low_r, low_c, mid = max(r, SHARE_FLOOR), max(c, SHARE_FLOOR), (r + c) / 2
        psi += (low_c - low_r) * math.log(low_c / low_r)
        js += sum(x * math.log2(x / mid) / 2 for x in (r, c) if x > 0)
    return psi, js


# ------------------------------------------------------------------ mergeable sketches per day (M5, M9)

SKETCH_K = 200  # values that a KLL sketch keeps exactly; beyond them a rank is off by about 1.7 % of the rows at most
SKETCH_RANK_ERROR = 0.017


def daily_sketches(records: DataFrame, col: str = "overall", ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(day, n, sketch): a quantile sketch of a column for every day, some KB whatever the day's traffic.

    Sketches are built by partial aggregation and can be merged, so a frozen reference is a few of them and drift doesn't read the log again."""
    known = records.where(F.col(col).isNotNull()).select(F.to_date(ts).alias("day"), F.col(col).cast("double").alias("value"))
    return known.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged_sketch(days: DataFrame) -> DataFrame:
    """(n, sketch) of all rows of ``daily_sketches`` together; n is 0 and the sketch null without rows."""
    return days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.when(F.count(F.lit(1)) > 0, F.kll_merge_agg_double("sketch")).alias("sketch"))


def drift_ks_sketch(reference: DataFrame, current: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(n_reference, n_current, ks_statistic) from two merged sketches: exact while both hold at most k values, within twice
    the rank error and one grid step otherwise; null if one side is empty.

    The largest gap is looked for at the quantiles of both sketches on a grid of ranks finer than one value in k."""
    steps = 4 * k
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    both = with_scalars(reference.select(F.col("n").alias("n_reference"), F.col("sketch").alias("_r")), current.select(F.col("n").alias("n_current"), F.col("sketch").alias("_c")))
    at = F.array_distinct(F.concat(F.kll_sketch_get_quantile_double("_r", grid), F.kll_sketch_get_quantile_double("_c", grid)))
    points = both.select(at).first()[0] or []  # the ranks' function takes literals; 8 k + 2 numbers at most
    at = F.array(*[F.lit(v) for v in points]) if points else F.array().cast("array<double>")
    ranks = both.withColumn("_gaps", F.zip_with(
        F.kll_sketch_get_rank_double("_r", at), F.kll_sketch_get_rank_double("_c", at), lambda a, b: F.abs(a - b)))
    return ranks.select("n_reference", "n_current", F.array_max("_gaps").alias("ks_statistic"))


# ------------------------------------------------------------------ daily windows (M7, M8)

def daily_quality(records: DataFrame, ts: str = "ts", duration: str = "1 day") -> DataFrame:
    """M7: per tumbling window: mean faithfulness, no-answer rate, requests."""
    g = records.groupBy(F.window(ts, duration).alias("w")).agg(
        F.avg("faithfulness").alias("avg_faithfulness"),
        F.avg(no_answer_flag("answer").cast("int")).alias("no_answer_rate"),
        F.count(F.lit(1)).alias("n_requests"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "avg_faithfulness", "no_answer_rate", "n_requests")


def quality_trend(daily: DataFrame) -> DataFrame:
    """M8: change of mean faithfulness against the previous window (window over one row per day)."""
    w = Window.orderBy("window_start")
    return daily.select("window_start", "avg_faithfulness",
                        (F.col("avg_faithfulness") - F.lag("avg_faithfulness").over(w)).alias("change"))
