"""The dense (Arrow batch) and sparse (JVM explode + aggregate) hashing encoders agree."""

from pyspark.sql import functions as F

from ragtide.operators import encode as E

TEXTS = ["The VAS score: 12.5 at day 3", "éàü Straße naïve café", "", "   ", "A a a A-1 a_1",
         "x" * 3000 + " y", "İstanbul ǅ Ⅻ ﬁ", None]


def test_dense_equals_sparse(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    dense = {r["id"]: r["vec"] for r in E.count_vectors(df, "text", "vec").collect()}
    sparse = {}
    for r in E.sparse_vectors(df, ["id"]).collect():
        sparse.setdefault(r["id"], {})[r["bucket"]] = r["weight"]
    for i in range(len(TEXTS)):
        got = {b: w for b, w in enumerate(dense[i]) if w}
        assert got == {b: float(w) for b, w in sparse.get(i, {}).items()}, TEXTS[i]
        assert len(dense[i]) == E.DIM


def test_token_rule(spark):
    df = spark.createDataFrame([("Dose-12 mg/kg; ÉTUDE 2b",)], "text string")
    assert df.select(E.tokens("text").alias("t")).first()["t"] == ["dose", "12", "mg", "kg", "tude", "2b"]
