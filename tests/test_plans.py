"""Plan-shape checks on sf0.001.

Only exchanges an operator requires (ENSURE_REQUIREMENTS) are counted; the explicit
spread of an under-split scan (REPARTITION_BY_NUM) disappears at cluster scale.
"""

import re

from testdata_paths import SF_SMALL
from ragtide.plans.registry import load_all


def _plan(spark, name):
    df = load_all()[name].fn(spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return text.split("\n\n(1)")[0], text


def _shuffles(text):
    return len(re.findall(r"Arguments: [^\n]*ENSURE_REQUIREMENTS", text))


def test_topk_corpus_not_shuffled(spark):
    head, text = _plan(spark, "topk_exact")
    assert _shuffles(text) == 1 and "MapInPandas" in head  # only the final per-question ranking exchange
    assert "CartesianProduct" not in head and "BroadcastNestedLoopJoin" not in head


def test_text_stages_are_narrow(spark):
    for name in ("extract_elements", "parse_tagged", "chunk_fixed", "chunk_recursive", "judge_scores"):
        _, text = _plan(spark, name)
        assert _shuffles(text) == 0, name


def test_hit_metadata_streams_documents(spark):
    head, text = _plan(spark, "source_details")
    assert "SortMergeJoin" not in head and "BroadcastHashJoin" in head
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string,source:string>", text)


def test_pairs_join_on_turn(spark):
    _, text = _plan(spark, "qa_pairs")
    assert re.search(r"Left keys \[2\]: \[conv_id#\d+L, turn#\d+L\]", text)
    assert "Window" not in text.split("\n\n(1)")[0]


def test_filters_pushed_to_scan(spark):
    _, text = _plan(spark, "drift_ks")
    assert "LessThan(ts,2024-01-16T00:00)" in text and "GreaterThanOrEqual(ts,2024-01-16T00:00)" in text


def test_log_window_reaches_the_scan(spark):
    _, text = _plan(spark, "window_24h")
    assert "NestedLoopJoin" not in text and re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(ts", text)


def test_large_tables_are_not_spread(spark, monkeypatch):
    from ragtide.sources import tables

    monkeypatch.setattr(tables, "SPREAD_MAX_BYTES", 1)
    plan = tables.table(spark, SF_SMALL, "documents")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
