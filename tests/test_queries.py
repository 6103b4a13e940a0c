"""Every registered query runs on sf0.001 with a stable schema; entry() works."""

import importlib

import pytest

from testdata_paths import SF_SMALL
from ragtide.plans.registry import load_all

FAST = [n for n in load_all() if not n.startswith("stream_") and n not in ("recall_at_k", "topk_ivf_all")]


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_runs(spark, name):
    q = load_all()[name]
    df = q.fn(spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert len(df.columns) == len(set(df.columns))
