"""Posting lists with block maxima against exact dense search."""

import math
import random
from collections import Counter

import pytest

from ragtide.operators import block_max as B
from ragtide.operators import encode as E
from ragtide.operators import retrieve as R
from ragtide.operators.ingest import scratch_path

TOPICS = [[f"{t}{i}" for i in range(60)] for t in ("alpha", "beta", "gamma", "delta")]


def corpus_rows():
    rng = random.Random(5)
    rows = [(i, 0, " ".join(rng.choices(TOPICS[i % 4], k=rng.randrange(5, 60)))) for i in range(600)]
    rows += [(1000 + i, 0, rows[7][2]) for i in range(40)]  # copies: their ties go to the smaller id
    return rows + [(2000, 0, None), (2000, 1, ""), (2000, 2, "?!"), (2001, 0, "alpha1 " * 70_000), (2002, 0, "beta3"), (2002, 1, "beta3")]


def question_rows():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(TOPICS[i % 4], k=8))) for i in range(60)]
    return rows + [(100, corpus_rows()[7][2]), (101, None), (102, ""), (103, "beta3"), (104, "Alpha1 ALPHA1"), (105, "wordless in corpus zzz")]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(corpus_rows(), "doc long, chunk_no int, text string")
    path = scratch_path(spark, "postings")
    B.add_version(chunks.where("doc < 300"), path, 0, c_id=["doc", "chunk_no"])
    B.add_version(chunks.where("doc >= 300"), path, 1, c_id=["doc", "chunk_no"])
    B.add_version(chunks.where("doc >= 300"), path, 1, c_id=["doc", "chunk_no"])  # a retried write
    return path


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(question_rows(), "qid long, question string")


def vector(text):
    import hashlib
    import re

    words = re.findall(E.TOKEN_PATTERN, (text or "").lower())
    return Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % E.DIM for w in words)


def expected(k):
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    chunks = [(d, c, vector(t)) for d, c, t in corpus_rows()]
    out = set()
    for qid, text in question_rows():
        q = vector(text)
        found = [(-round(dot / (norm(q) * norm(v)), 9), d, c) for d, c, v in chunks if (dot := sum(q[b] * v[b] for b in q)) > 0]
        out |= {(qid, i + 1, d, c, round(-s, 6)) for i, (s, d, c) in enumerate(sorted(found)[:k])}
    return out


def rows(df):
    return {(r.qid, r["rank"], r.doc, r.chunk_no, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 12, 2000])
def test_equals_brute_force(asked, index, k):
    assert rows(B.topk_sparse(asked, index, k)) == expected(k)


def test_question_sets_beyond_the_broadcast_budget(asked, index):
    assert rows(B.topk_sparse(asked, index, 12, broadcast_bytes=20 * E.DIM * 8)) == expected(12)


def test_every_chunk_with_tokens_is_stored_once(spark, index):
    stored = [(d, c) for r in B.stored_blocks(spark, index).collect() for d, c in zip(r.id_doc, r.id_chunk_no)]
    assert sorted(stored) == sorted((d, c) for d, c, t in corpus_rows() if vector(t))


def test_blocks_are_skipped(spark, asked, index):
    n = B.stored_blocks(spark, index).count()
    report = B.search_report(asked, index, 3).collect()
    assert len(report) == sum(1 for _, t in question_rows() if vector(t))
    assert all(r.n_blocks == n and r.n_scored <= n for r in report)
    # a question of one topic meets blocks of four
    assert sum(r.n_scored for r in report) < 0.6 * sum(r.n_blocks for r in report)


def test_maxima_bound_every_chunk(spark, index):
    for r in B.stored_blocks(spark, index).collect():
        lo = 0
        for top, hi in zip(r.maxima, r.ends):
            assert all(w / r.norms[p] <= top for p, w in zip(r.places[lo:hi], r.weights[lo:hi]))
            lo = hi


def test_first_pass_reads_the_maxima_only(spark, index):
    plan = B.stored_blocks(spark, index).select("block", "buckets", "maxima")._jdf.queryExecution().executedPlan().toString()
    assert "places" not in plan and "weights" not in plan


def test_empty_tables_and_string_ids(spark, asked, index):
    none = asked.where("qid < 0")
    assert B.topk_sparse(none, index).collect() == [] and B.search_report(none, index).collect() == []
    path = scratch_path(spark, "postings")
    B.add_version(spark.createDataFrame([], "score string, text string"), path, c_id="score")
    assert B.topk_sparse(asked, path).collect() == []
    B.add_version(spark.createDataFrame([("b", "beta3"), ("a", "beta3"), ("c", None)], "score string, text string"), path, 1, c_id="score")
    got = B.topk_sparse(asked.where("qid = 103"), path).toDF("qid", "rank", "id", "cos").collect()
    assert [(r["rank"], r.id) for r in got] == [(1, "a"), (2, "b")]


def test_sparse_arrays_are_the_dense_counts(spark):
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(corpus_rows()[:50] + corpus_rows()[-6:])], "id int, text string")
    for r in E.count_vectors(df).withColumn("s", E.sparse_arrays("text")).collect():
        dense = [0.0] * E.DIM
        for b, w in zip(r.s.buckets, r.s.weights):
            dense[b] = float(w)
        assert dense == r.vec and list(r.s.buckets) == sorted(r.s.buckets)


def test_agrees_with_dense_search(spark, asked, index):
    chunks = E.encode(spark.createDataFrame(corpus_rows(), "doc long, chunk_no int, text string"), "text", "cvec")
    dense = R.topk(E.encode(asked, "question", "qvec"), chunks, 1, c_id=["doc", "chunk_no"], c_vec="cvec", metric="cosine")
    assert rows(dense.where("score > 0")) == rows(B.topk_sparse(asked, index, 1))
