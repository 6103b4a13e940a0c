"""Every registered query and the pipeline run on the small tables; SQL gives the same rows."""

import importlib

import duckdb
import pytest

from conftest_llm import SF
from ragtide.llm.oracles import ORACLES
from ragtide.llm.queries import QUERIES

TABLES = "documents embeddings benchmark labels conversations".split()


def canonical(df):
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert canonical(got) == canonical(con.execute(ORACLES[name]).df())


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as p
    from ragtide.llm.common import read_table

    docs = read_table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        folder = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{counts[-1]}"
        out.write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > counts[0] / 2
    packed = p.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
