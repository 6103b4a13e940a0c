"""Recursive splitter contract (C1) on edge strings, fixed windows (C2), invariants query."""

import pytest

from ragtide.operators import chunk as C

EDGE = [
    "", "   \n  ", "a" * 1000, "a" * 1001, "x" * 2500, "word " * 400,
    "é" * 1500 + "." + "ü" * 300, "line one.\nline two.\n\npara two " * 60,
    ("Sentence number %d is here. " * 120) % tuple(range(120)),
]


@pytest.mark.parametrize("text", EDGE)
def test_contract(text):
    offs = [(a, text[a:b]) for a, b in C.chunk_spans(text)]
    chunks = [c for _, c in offs]
    assert all(len(c) <= C.CHUNK_SIZE for c in chunks)
    assert all(c.strip() for c in chunks)
    prev_start = prev_end = None
    covered = [False] * len(text)
    for start, c in offs:
        assert start >= 0 and text[start:start + len(c)] == c
        if prev_start is not None:
            assert start > prev_start
            assert prev_end - start <= C.CHUNK_OVERLAP
        prev_start, prev_end = start, start + len(c)
        for i in range(start, start + len(c)):
            covered[i] = True
    assert all(covered[i] or text[i].isspace() for i in range(len(text)))
    if len(text.strip()) <= C.CHUNK_SIZE:
        assert len(chunks) == (1 if text.strip() else 0)


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "a" * 1801), (2, ""), (3, " " * 900 + "b")], "doc_id long, text string")
    rows = sorted((r["doc"], r["chunk_no"], r["start"], r["n_chars"]) for r in C.chunk_fixed(df).collect())
    # starts every 800 chars; the last window is kept even though it lies inside the previous overlap
    assert rows == [(1, 0, 0, 1000), (1, 1, 800, 1000), (1, 2, 1600, 201), (3, 0, 0, 901), (3, 1, 800, 101)]


def test_invariants_dataframe(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "doc_id long, text string")
    r = C.chunk_invariants(df, C.chunk_recursive(df)).first().asDict()
    assert all(v == 0 for v in r.values()), r


def test_stats_count_empty_documents(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "   ")], "doc_id long, text string")
    r = C.chunk_stats(df, C.chunk_fixed(df)).first()
    assert (r["n_documents"], r["n_chunks"], r["chunks_per_document"], r["documents_without_chunks"]) == (2, 1, 0.5, 1)


def test_invariants_detect_violations(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 50 + " tail")], "doc_id long, text string")
    bad = spark.createDataFrame(
        [(1, 0, 0, "abcdefghij" * 30, 300), (1, 1, 10, "abcdefghij" * 30, 300), (1, 2, 5, "zzz", 3)],
        "doc long, chunk_no int, start int, text string, n_chars int")
    r = C.chunk_invariants(docs, bad).first().asDict()
    assert r["overlap_too_big"] >= 1 and r["not_increasing"] == 1 and r["not_substring"] == 1
    assert r["uncovered"] >= 1 and r["docs_lost"] == 0
