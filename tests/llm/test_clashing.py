"""Operators on tables whose other columns bear names that operators use inside, and a map among them."""

from collections import Counter

import pytest

from ragtide.llm import decontaminate, license_scan, line_dedup, setjoin, toxicity
from ragtide.llm.common import read_table
from conftest_llm import SF


def filters(spark):
    items = spark.createDataFrame([(1, "this very line stands in many documents and is long enough"), (None, "x")], "item_id long, text string")
    labels = read_table(spark, SF, "labels")
    return {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels),
        "line_dedup": lambda d: line_dedup.dedup_lines(d),
        "setjoin": lambda d: setjoin.keep_one(d, words=5, percent=80),
        "decontaminate": lambda d: decontaminate.drop_contaminated(d, items),
    }


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "setjoin", "decontaminate"])
def test_other_columns_come_through(spark, odd, clashing, name):
    apply = filters(spark)[name]
    out = apply(clashing)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in apply(odd).collect())
    assert {(r._hits, r._score, r.kept_0) for r in got} == {("c0", "c8", "c13")}
    by_id = {r.doc_id: r for r in odd.collect()}
    assert all(r.a_map == {"k": by_id[r.doc_id].row} for r in got if r.doc_id is not None)


def test_reports_ignore_them(spark, odd, clashing):
    assert sorted(map(str, license_scan.license_report(clashing).collect())) == sorted(map(str, license_scan.license_report(odd).collect()))
    assert sorted(map(str, setjoin.jaccard_groups(clashing).drop("group_key").collect())) == sorted(map(str, setjoin.jaccard_groups(odd).drop("group_key").collect()))


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "some passage here"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "some passage"), (None, "passage here"), (7, "here")], "item_id long, text string")
    import hashlib

    got = {r.doc_id: (r.n_items, r.items_sha256) for r in decontaminate.contamination_report(docs, items).collect()}
    assert got[1] == (2, hashlib.sha256(b",7").hexdigest()) and got[2][0] == 0
