"""Drift as a stateful stream: closed days equal the batch figures, alerts have a memory that survives a restart."""

import datetime as dt

from pyspark.sql import functions as F

from ragtide.operators import ingest as I
from ragtide.operators import monitor as M
from ragtide.sources.derived import interaction_records
from ragtide.streaming import jobs as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FIRST = dt.datetime(2024, 1, 1)
# value of the marks on each day: the reference's spread, a shift, half a shift, back
DAYS = ["calm", "calm", "shift", "half", "half", "calm", "half", "shift", "none", "calm", "calm"]


def events():
    """100 records a day; an id divisible by 11 has no marks."""
    rows = []
    for day, kind in enumerate(DAYS):
        for i in range(100):
            value = 70.0 if kind == "shift" or kind == "half" and i < 30 else 10.0 * (i % 8)
            rows.append((day * 1100 + i * 11 + (kind != "none"), FIRST + dt.timedelta(days=day, minutes=i), i, "view", value, "{}"))
    return rows


def result(spark, path):
    return sorted((r.column_name, r.window_start, r.n, round(r.psi, 9), round(r.js, 9), r.alert, r.change) for r in spark.read.parquet(path).collect())


def test_closed_days_and_hysteresis(spark):
    root = I.scratch_path(spark, "test-drift")
    df = spark.createDataFrame(events(), SCHEMA)
    df.coalesce(1).write.parquet(f"{root}/in")
    rec = interaction_records(df)
    ref = rec.where(F.col("ts") < F.lit(FIRST + dt.timedelta(days=2)))
    run = lambda src, name: S.stream_drift(spark, f"{root}/{src}", df.schema, reference=ref, sink=f"{root}/{name}", checkpoint=f"{root}/{name}-ck",
                                           cols=("overall",), raise_at=0.5, clear_at=0.05)
    run("in", "one")
    got = result(spark, f"{root}/one")
    # the last record lies on day 10, so days to the eighth are closed; the day without marks gives no row
    assert [r[1] for r in got] == [FIRST + dt.timedelta(days=i) for i, k in enumerate(DAYS[:9]) if k != "none"]
    for _, day, n, psi, js, _, _ in got:
        cur = rec.where((F.col("ts") >= F.lit(day)) & (F.col("ts") < F.lit(day + dt.timedelta(days=1))))
        assert abs(M.drift_psi(ref, cur).first().psi - psi) < 1e-8 and abs(M.drift_js(ref, cur).first().js_divergence - js) < 1e-8
        assert n == cur.where("overall is not null").count()
    assert [r[6] for r in got] == [None, None, "raised", None, None, "cleared", None, "raised"]
    assert [r[5] for r in got] == [False, False, True, True, True, False, False, True]

    # the same days in two deliveries, the stream stopped in between
    cut = FIRST + dt.timedelta(days=5, hours=1)
    df.where(F.col("ts") < F.lit(cut)).coalesce(1).write.parquet(f"{root}/in2")
    run("in2", "two")
    assert 0 < spark.read.parquet(f"{root}/two").count() < len(got)
    df.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(f"{root}/in2")
    run("in2", "two")
    run("in2", "two")  # nothing new: nothing more
    assert result(spark, f"{root}/two") == got


def test_thresholds_and_shares(spark):
    ref = spark.createDataFrame([(0.5, None), (-3.0, None), (11.0, None), (None, None)], "overall double, faithfulness double")
    shares = M.reference_shares(ref, ["overall", "faithfulness"])
    assert shares["overall"] == [2 / 3] + [0.0] * 8 + [1 / 3] and shares["faithfulness"] == [0.0] * 10
    assert M.psi_js(shares["overall"], [2] + [0] * 8 + [1]) == (0.0, 0.0)
    try:
        S.stream_drift(spark, "x", None, reference=ref, sink="y", checkpoint="z", raise_at=0.1, clear_at=0.2)
        raise AssertionError("thresholds in the wrong order were taken")
    except ValueError:
        pass
