"""Monitoring edge cases: empty windows, absent reference, strict alert thresholds, KS/PSI/JS sanity."""

import datetime as dt

from ragtide.operators import monitor as M

SCHEMA = "ts timestamp, answer string, faithfulness double, overall double"


def _recs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_flag_and_summary(spark):
    t = dt.datetime(2024, 1, 2, 12)
    r = _recs(spark, [(t, "No relevant documents found.", None, 1.0), (t, None, 4.0, 2.0), (t, "fine", 6.0, 3.0)])
    s = M.summarize(r).first()
    assert s["avg_faithfulness"] == 5.0 and abs(s["no_answer_rate"] - 1 / 3) < 1e-12 and s["n_requests"] == 3


def test_empty_current_gives_no_alert_and_absent_reference_falls_back(spark):
    empty = _recs(spark, [])
    s = M.with_reference(M.summarize(empty), empty)
    assert M.alerts(s).count() == 0
    cur = _recs(spark, [(dt.datetime(2024, 1, 2), "x", 3.0, 3.0)])
    r = M.with_reference(M.summarize(cur), empty).first()
    assert r["reference_source"] == "current" and r["ref_avg_faithfulness"] == 3.0


def test_thresholds_are_strict(spark):
    t = dt.datetime(2024, 1, 2)
    ref = _recs(spark, [(t, "x", 7.5, 7.0)])
    # drop exactly 1.5 and no-answer rate exactly 0.15 (3 of 20): no alert
    cur = _recs(spark, [(t, "No relevant documents found", 6.0, 6.0)] * 3 + [(t, "ok", 6.0, 6.0)] * 17)
    assert M.alerts(M.with_reference(M.summarize(cur), ref)).count() == 0
    cur2 = _recs(spark, [(t, "No relevant documents found", 5.9, 6.0)] * 4 + [(t, "ok", 5.9, 6.0)] * 16)
    msgs = sorted(r["message"] for r in M.alerts(M.with_reference(M.summarize(cur2), ref)).collect())
    assert msgs == ["Faithfulness en baisse: 7.5 -> 5.9", "Taux de 'no answer' élevé: 20%"]


def test_window_24h_inclusive(spark):
    base = dt.datetime(2024, 1, 10, 12)
    r = _recs(spark, [(base - dt.timedelta(days=1), "a", 1.0, 1.0), (base - dt.timedelta(days=1, seconds=1), "b", 1.0, 1.0),
                      (base, "c", 1.0, 1.0)])
    assert sorted(x["answer"] for x in M.window_24h(r).collect()) == ["a", "c"]


def test_drift_identical_and_shifted(spark):
    t = dt.datetime(2024, 1, 2)
    a = _recs(spark, [(t, "x", 1.0, float(v % 10)) for v in range(200)])
    k = M.drift_ks(a, a).first()
    assert k["ks_statistic"] == 0.0 and k["p_value"] == 1.0 and not k["drift"]
    assert abs(M.drift_psi(a, a).first()["psi"]) < 1e-12 and M.drift_js(a, a).first()["js_divergence"] == 0.0
    b = _recs(spark, [(t, "x", 1.0, 9.5)] * 200)
    k2 = M.drift_ks(a, b).first()
    assert k2["drift"] and k2["ks_statistic"] > 0.8
    assert M.drift_psi(a, b).first()["drift"]


def test_daily_and_trend(spark):
    rows = [(dt.datetime(2024, 1, d, h), "x", float(d), 1.0) for d in (1, 2, 3) for h in (1, 13)]
    d = M.daily_quality(_recs(spark, rows))
    t = {r["window_start"].day: r["change"] for r in M.quality_trend(d).collect()}
    assert t == {1: None, 2: 1.0, 3: 1.0}


def test_extra_no_answer_markers(spark):
    t = dt.datetime(2024, 1, 2)
    r = _recs(spark, [(t, "Information not found in available documents", 1.0, 1.0), (t, "ok", 1.0, 1.0)])
    base = [x[0] for x in r.select(M.no_answer_flag("answer")).collect()]
    more = [x[0] for x in r.select(M.no_answer_flag("answer", ["not found in available documents"])).collect()]
    assert base == [False, False] and more == [True, False]


def test_values_below_zero_count(spark):
    t = dt.datetime(2024, 1, 2)
    a = _recs(spark, [(t, "x", 1.0, v) for v in (-5.0, -4.0, -3.0, 1.0, 2.0)])
    b = _recs(spark, [(t, "x", 1.0, v) for v in (1.0, 2.0)])
    assert M.drift_psi(a, b).first()["drift"] and M.drift_js(a, b).first()["js_divergence"] > 0.1
    close = M.drift_ks(_recs(spark, [(t, "x", 1.0, 0.01)]), _recs(spark, [(t, "x", 1.0, 0.09)])).first()
    assert close["ks_statistic"] == 1.0  # within what used to be one bin


def test_exact_quartiles_over_many_partitions(spark):
    t = dt.datetime(2024, 1, 2)
    values = [float((i * 7919) % 1000) for i in range(3000)] + [None] * 5
    df = spark.createDataFrame([(t, "x", v, 3.0) for v in values], SCHEMA).repartition(5)
    rows = {r["column_name"]: r for r in M.column_summary(df, ["faithfulness", "overall"]).collect()}
    f, o = rows["faithfulness"], rows["overall"]
    assert (f["n"], f["n_missing"], f["n_distinct"], f["p25"], f["p50"], f["p75"]) == (3000, 5, 1000, 249.0, 499.0, 749.0)
    assert (o["n"], o["n_distinct"], o["p25"], o["p75"]) == (3005, 1, 3.0, 3.0)


def test_messages_round_half_even(spark):
    summary = spark.createDataFrame([(2.25, 0.1, 4.25), (7.0, 0.185, 7.0)], "avg_faithfulness double, no_answer_rate double, ref_avg_faithfulness double")
    assert sorted(r["message"] for r in M.alerts(summary).collect()) == ["Faithfulness en baisse: 4.2 -> 2.2", "Taux de 'no answer' élevé: 18%"]


def test_sketches_per_day(spark):
    """Merged day sketches: exact while small, within the stated error beyond, whatever the order of merging."""
    import datetime as dt
    import random

    rng = random.Random(9)
    day = lambda i: dt.datetime(2024, 1, 1 + i % 6, 12)
    frame = lambda rows: spark.createDataFrame(rows, "ts timestamp, overall double").repartition(3)
    for n, tolerance in ((60, 1e-9), (20_000, 2 * M.SKETCH_RANK_ERROR + 1 / M.SKETCH_K)):
        ref = frame([(day(i), rng.choice([None, float(rng.randrange(11)), rng.gauss(5, 2)])) for i in range(n)])
        cur = frame([(day(i), rng.gauss(5.8, 2)) for i in range(n)])
        got = M.drift_ks_sketch(M.merged_sketch(M.daily_sketches(ref)), M.merged_sketch(M.daily_sketches(cur))).first()
        want = M.drift_ks(ref, cur).first()
        assert (got.n_reference, got.n_current) == (want.n_reference, want.n_current)
        assert abs(got.ks_statistic - want.ks_statistic) <= tolerance
    none = M.merged_sketch(M.daily_sketches(ref.limit(0)))
    assert none.first().n == 0 and M.drift_ks_sketch(none, M.merged_sketch(M.daily_sketches(cur))).first().ks_statistic is None
