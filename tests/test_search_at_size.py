"""Searches whose work and memory must not grow faster than their pairs."""

import numpy as np
import pandas as pd
import pytest

from ragtide.operators import encode as E
from ragtide.operators import ingest as I
from ragtide.operators import retrieve as R
from ragtide.plans.registry import load_all


def brute(Q, C, k, metric):
    S = Q @ C.T if metric == "dot" else -np.sqrt(((Q[:, None, :] - C[None, :, :]) ** 2).sum(2))
    return [[(i, int(j)) for j in np.lexsort((np.arange(len(C)), -np.round(S[i], 9)))[:k]] for i in range(len(Q))]


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_few_score_matrices_are_ranked_whole(metric, monkeypatch):
    """Once a question has k rows, only scores that reach its k-th are looked at again."""
    monkeypatch.setattr(R, "SCORE_CELLS", 4000)
    monkeypatch.setattr(R, "QUESTION_TILE", 40)
    ranked, rank = [], R._block_best
    monkeypatch.setattr(R, "_block_best", lambda S, k: ranked.append(S.size) or rank(S, k))
    rng = np.random.default_rng(5)
    Q, C = rng.normal(size=(90, 8)), rng.normal(size=(3000, 8))
    C[1000:1040] = C[7]  # ties beyond k
    C[2000:2005] = Q[:5]
    best = R._RunningBest(np.arange(90), Q, 6, metric, "qid", ["vec_id"])
    for lo in range(0, 3000, 700):
        part = np.arange(lo, min(3000, lo + 700))[::-1]
        best.add(pd.DataFrame({"vec_id": part}), C[part])
    got = best.frame()
    got["key"] = np.round(got["score"], 9) * (1 if metric == "l2" else -1)
    got = got.sort_values(["qid", "key", "vec_id"])
    want = [x for row in brute(Q, C, 6, metric) for x in row]
    assert list(zip(got["qid"], got["vec_id"])) == want
    assert sum(ranked) < 90 * 3000 / 4


def test_grid_cells_have_partitions_of_their_own(spark, monkeypatch):
    dealt, cogrouped = [], R._cogrouped
    monkeypatch.setattr(R, "_cogrouped", lambda a, b, cell, n, *rest: dealt.append(n) or cogrouped(a, b, cell, n, *rest))
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    qs = rows.selectExpr("vec_id AS qid", "embedding AS qvec")
    hits = R.topk(qs, rows, 3, force="grid", broadcast_bytes=8, block_bytes=3 * 8 * 20, metric="l2")
    assert hits.count() == 180 and dealt == [9]


def test_a_question_goes_once_to_a_block_of_lists(spark, monkeypatch):
    """Not once to every list: with all lists probed that was questions x lists rows with their vectors."""
    sent, cogrouped = [], R._cogrouped
    monkeypatch.setattr(R, "_cogrouped", lambda a, *rest: sent.append(a.count()) or cogrouped(a, *rest))
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)], "vec_id long, embedding array<double>")
    qs = rows.selectExpr("vec_id AS qid", "embedding AS qvec").where("qid < 30")
    assigned, cents = R.ivf_index(rows, n_lists=12, n_rows=200)
    got = R.topk_ivf(qs, assigned, cents, 5, nprobe=12, salt_rows=100)
    blocks = len({b for a, n in R._blocks_of_lists([(r["centroid_id"], r["count"]) for r in assigned.groupBy("centroid_id").count().orderBy("centroid_id").collect()], 100).values()
                  for b in range(a, a + n)})
    assert sorted(map(tuple, got.select("qid", "rank", "vec_id").collect())) == sorted(map(tuple, R.topk(qs, rows, 5).select("qid", "rank", "vec_id").collect()))
    assert sent == [30 * blocks] and blocks < 6


def test_small_arrow_batches_and_token_slices(spark, monkeypatch):
    texts = pd.Series([f"word{i} of text {i % 3}" if i % 7 else None for i in range(50)])
    whole = E._hashed_slice(texts, 32)
    monkeypatch.setattr(E, "TEXTS_AT_ONCE", 8)
    assert (E._hashed_counts(texts, 32) == whole).all() and E._hashed_counts(texts[:0], 32).shape == (0, 32)
    d = I.scratch_path(spark, "test-batches")
    spark.createDataFrame([(i, f"text {i}", "s") for i in range(20)], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        assert load_all()["chunk_recursive"].fn(spark, d).count() == 20
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_hof_path_ranks_few_pairs(spark, metric, monkeypatch):
    """rows that fall short of a question's k-th best score so far are not ranked; ties, null entries and repeated ids as ever."""
    ranked, rank = [], R._rank
    monkeypatch.setattr(R, "_rank", lambda scored, *a, **kw: ranked.append(scored.count()) or rank(scored, *a, **kw))
    rng = np.random.default_rng(9)
    Q, C = rng.normal(size=(10, 4)), rng.normal(size=(1500, 4))
    C[1000:1040] = C[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(C)] + [(5000, [1e6, None, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(Q)], "qid long, qvec array<double>")
    got = R.topk(qs, corpus, 3, metric=metric, force="hof").orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id) for r in got] == [x for row in brute(Q, C, 3, metric) for x in row]
    assert sum(ranked) < 10 * 1500 / 4


def test_hof_condition_is_compiled(spark, monkeypatch):
    """every pair meets the condition, so Spark must compile the join (100 columns at most) and the JVM its loop (8,000 bytes at most)."""
    plans, rank = [], R._rank
    codes = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString
    monkeypatch.setattr(R, "_rank", lambda scored, *a, **kw: plans.append(codes(scored._jdf.queryExecution().executedPlan())) or rank(scored, *a, **kw))
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64)]) for i in range(30)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        R.topk(rows.selectExpr("vec_id AS qid", "embedding AS qvec"), rows, 2, force="hof")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
    assert spark.conf.get("spark.sql.ansi.enabled") == before[1]
    joins = [part for part in plans[-1].split("== Subtree ") if "BroadcastNestedLoopJoin" in part.partition("Generated code")[0]]
    assert joins and all(int(part.partition("maxMethodCodeSize:")[2].partition(";")[0]) < 8000 for part in joins)


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
@pytest.mark.parametrize("dim", [5, 64])
def test_hof_bound_leaves_no_hit_out(spark, metric, dim):
    """Rounded vectors only leave out pairs: vectors of unlike lengths, near ones, zeros and huge ones, against numpy."""
    rng = np.random.default_rng(dim)
    C = rng.normal(size=(700, dim)) * 10.0 ** rng.integers(-3, 4, (700, 1))
    C[300:340] = C[5] * (1 + 1e-7 * rng.normal(size=(40, dim)))
    C[400:403], C[403], C[404, 0] = 0.0, 1e120 * C[7], 1e-200
    Q = np.concatenate([C[:8], C[[5, 400, 403]], rng.normal(size=(4, dim))])
    make = lambda X, spec: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], spec)
    got = {}
    for force in ("hof", None):
        hits = R.topk(make(Q, "qid long, qvec array<double>"), make(C, "vec_id long, embedding array<double>"), 6, metric=metric, force=force)
        got[force or "numpy"] = hits.orderBy("qid", "rank").collect()
    usual = [i for i in range(len(Q)) if i not in ((9, 10) if metric == "cosine" else (10,))]  # the huge one: no digits to compare
    for q in usual:
        a, b = ([(r.score) for r in got[f] if r.qid == q] for f in ("hof", "numpy"))
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-8)
    assert len(got["hof"]) >= 6 * len(usual)


def test_products_are_looked_through_in_single_precision(monkeypatch):
    """only the first rows of a question are multiplied in double precision, and hits closer than single precision tells stay apart."""
    cells, scores = [], R._block_scores
    monkeypatch.setattr(R, "_block_scores", lambda C, Q, *a: cells.append(len(C) * len(Q)) or scores(C, Q, *a))
    rng = np.random.default_rng(8)
    Q, C = rng.normal(size=(50, 16)), rng.normal(size=(6000, 16))
    C[2000:2040] = C[9] * (1 + 3e-8 * np.arange(40))[:, None]
    C[3000:3050] = Q * 3
    C[3100:3150] = C[3000:3050] * (1 - 2e-8)
    best = R._RunningBest(np.arange(50), Q, 4, "dot", "qid", ["vec_id"])
    best.add(pd.DataFrame({"vec_id": np.arange(6000)}), C)
    got = best.frame()
    got["key"] = -np.round(got["score"], 9)
    got = got.sort_values(["qid", "key", "vec_id"])
    assert list(zip(got["qid"], got["vec_id"])) == [x for row in brute(Q, C, 4, "dot") for x in row]
    assert sum(cells) < 50 * 6000 / 10
    # what single precision can't hold is taken in double precision
    C[17] = 1e30 * Q[3]
    best = R._RunningBest(np.arange(50), Q, 4, "dot", "qid", ["vec_id"])
    best.add(pd.DataFrame({"vec_id": np.arange(6000)}), C)
    got = best.frame()
    assert 17 in set(got[got["qid"] == 3]["vec_id"]) and (got.groupby("qid").size() == 4).all()
