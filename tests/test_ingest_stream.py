"""Incremental ingestion on disk and streaming edge fixtures (duplicates, late events)."""

import datetime as dt

from pyspark.sql import functions as F

from ragtide.operators import chunk as C
from ragtide.operators import ingest as I
from ragtide.streaming import jobs as S


def _raw(spark, docs):
    df = spark.createDataFrame(docs, "doc long, text string")
    return df.select("doc", F.concat(F.lit("docs/"), F.col("doc").cast("string"), F.lit(".pdf")).alias("path"),
                     F.md5("text").alias("fingerprint"), "text")


def _index(spark, idx, man):
    return sorted((r["doc"], r["chunk_no"], r["text"]) for r in I.read_index(spark, idx, man).collect())


def test_replace_by_document_and_rerun(spark):
    root = I.scratch_path(spark, "test-ingest")
    idx, man = f"{root}/index", f"{root}/manifest"
    to_chunks = lambda df: C.chunk_fixed(df, doc="doc")
    v1 = [(1, "a" * 1500), (2, "b" * 500), (3, "c" * 10)]
    assert I.ingest_batch(spark, _raw(spark, v1), index_path=idx, manifest_path=man, to_chunks=to_chunks) == 3
    v2 = [(1, "A" * 900), (2, "b" * 500), (4, "d" * 20)]  # 1 modified (fewer chunks), 3 deleted, 4 new
    assert I.ingest_batch(spark, _raw(spark, v2), index_path=idx, manifest_path=man, to_chunks=to_chunks) == 3
    expect = sorted((r["doc"], r["chunk_no"], r["text"])
                    for r in to_chunks(spark.createDataFrame(v2, "doc long, text string")).collect())
    assert _index(spark, idx, man) == expect  # no stale chunk of doc 1, nothing of doc 3
    assert I.ingest_batch(spark, _raw(spark, v2), index_path=idx, manifest_path=man, to_chunks=to_chunks) == 0
    assert _index(spark, idx, man) == expect


def test_emptied_and_deleted_documents_vanish(spark):
    """Few documents: whole old versions fall away; files written follow the delta."""
    root = I.scratch_path(spark, "test-vanish")
    idx, man = f"{root}/index", f"{root}/manifest"
    to_chunks = lambda df: C.chunk_recursive(df, doc="doc")
    run = lambda docs: I.ingest_batch(spark, _raw(spark, docs), index_path=idx, manifest_path=man, to_chunks=to_chunks)
    big = [(i, f"text of {i} " * 200) for i in range(3, 60)]
    assert run([(1, "one"), (2, "two"), *big]) == 59
    assert run([(1, ""), *big]) == 2  # 1 emptied, 2 deleted
    assert {r[0] for r in _index(spark, idx, man)} == set(range(3, 60))
    assert {r["path"] for r in I.read_manifest(spark, man).collect()} == {f"docs/{i}.pdf" for i in [1, *range(3, 60)]}
    assert run([(1, ""), *big]) == 0
    assert run([(1, "back"), *big]) == 1
    last = I.read_manifest(spark, man).where("path = 'docs/1.pdf'").first().version
    added = spark.read.parquet(f"{idx}/version={last}")
    assert added.count() == 1 and (1, 0, "back") in _index(spark, idx, man)
    before = _index(spark, idx, man)
    version = I.compact(spark, idx, man)
    assert _index(spark, idx, man) == before and spark.read.parquet(f"{idx}/version={version}").count() == len(before)


def test_unfinished_batch_is_invisible(spark):
    root = I.scratch_path(spark, "test-crash")
    idx, man = f"{root}/index", f"{root}/manifest"
    to_chunks = lambda df: C.chunk_fixed(df, doc="doc")
    I.ingest_batch(spark, _raw(spark, [(1, "a")]), index_path=idx, manifest_path=man, to_chunks=to_chunks)
    I.write_index(to_chunks(spark.createDataFrame([(1, "lost")], "doc long, text string")), idx, 1)  # then it died
    assert _index(spark, idx, man) == [(1, 0, "a")]
    I.ingest_batch(spark, _raw(spark, [(1, "b")]), index_path=idx, manifest_path=man, to_chunks=to_chunks)
    assert _index(spark, idx, man) == [(1, 0, "b")]


def test_two_writers_both_survive(spark, monkeypatch):
    """Two batches that began on one state: each takes a commit and an index version of its own."""
    root = I.scratch_path(spark, "test-writers")
    idx, man = f"{root}/index", f"{root}/manifest"
    to_chunks = lambda df: C.chunk_fixed(df, doc="doc")
    first = [(1, "one"), (2, "two")]
    I.ingest_batch(spark, _raw(spark, first), index_path=idx, manifest_path=man, to_chunks=to_chunks)
    inner = []

    def slow(df):  # another writer commits while this one makes its chunks
        if not inner:
            inner.append(1)
            I.ingest_batch(spark, _raw(spark, [(3, "three")]), index_path=idx, manifest_path=man, to_chunks=to_chunks, detect_deletions=False)
        return to_chunks(df)

    I.ingest_batch(spark, _raw(spark, [(1, "one more"), (2, "two")]), index_path=idx, manifest_path=man, to_chunks=slow, detect_deletions=False)
    assert _index(spark, idx, man) == [(1, 0, "one more"), (2, 0, "two"), (3, 0, "three")]
    assert I.log.newest(spark, man) == 2
    # both ask for one number: the store lets one have it
    rows = I.log.actions(I.read_manifest(spark, man))
    assert I.log.commit(spark, man, rows, exactly=3) == 3
    try:
        I.log.commit(spark, man, rows, exactly=3)
        raise AssertionError("a commit number was given twice")
    except I.log.Taken:
        pass


def test_log_as_of_checkpoints_and_dead_writers(spark):
    root = I.scratch_path(spark, "test-log")
    idx, man = f"{root}/index", f"{root}/manifest"
    to_chunks = lambda df: C.chunk_fixed(df, doc="doc")
    run = lambda docs: I.ingest_batch(spark, _raw(spark, docs), index_path=idx, manifest_path=man, to_chunks=to_chunks)
    for i in range(12):
        assert run([(1, "same"), (2, f"text {i}"), (3, "x")][: 2 + i % 2]) == (2 if i else 2)
    assert I.log._names(spark, f"{man}/checkpoints").keys() == {f"{9:020d}"}
    at = lambda n: sorted(tuple(r) for r in I.read_index(spark, idx, man, as_of=n).collect())
    texts = lambda n: {r[-1] for r in [(r["doc"], r["text"]) for r in I.read_index(spark, idx, man, as_of=n).collect()]}
    for n in (0, 3, 8, 9, 10, 11):
        assert texts(n) == {"same", f"text {n}"} | ({"x"} if n % 2 else set())
    assert at(None) == at(11)
    I.log._put_if_absent(spark, f"{man}/commits/{12:020d}", "")  # a writer that died
    assert at(None) == at(11) and run([(1, "same"), (2, "after"), (3, "x")]) == 1 and I.log.newest(spark, man) == 13
    size = sum(I.log._names(spark, f"{man}/actions/{n}").get("_SUCCESS", 0) == 0 for n in I.log._names(spark, f"{man}/actions"))
    assert size == 13


def test_one_key_one_path(spark):
    root = I.scratch_path(spark, "test-keys")
    idx, man = f"{root}/index", f"{root}/manifest"
    to_chunks = lambda df: C.chunk_fixed(df, doc="doc")
    raw = lambda rows: spark.createDataFrame(rows, "doc long, path string, text string").withColumn("fingerprint", F.md5("text"))
    run = lambda rows, **o: I.ingest_batch(spark, raw(rows), index_path=idx, manifest_path=man, to_chunks=to_chunks, **o)
    try:
        run([(1, "a/x.pdf", "old"), (1, "b/x.pdf", "other")])
        raise AssertionError("a key under two paths was taken")
    except ValueError as e:
        assert "a/x.pdf" in str(e)
    run([(1, "a/x.pdf", "old"), (2, "a/y.pdf", "two")])
    run([(1, "b/x.pdf", "new")], detect_deletions=False)  # the key moves to its new path
    assert _index(spark, idx, man) == [(1, 0, "new"), (2, 0, "two")]
    assert {r.path for r in I.read_manifest(spark, man).collect()} == {"b/x.pdf", "a/y.pdf"}


def test_stream_dedup_and_late(spark):
    root = I.scratch_path(spark, "test-stream")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    base = dt.datetime(2024, 1, 5)
    ev = [(i, base + dt.timedelta(hours=i), 1, "view", 1.0, "{}") for i in range(48)]
    df = spark.createDataFrame(ev, schema)
    df.coalesce(1).write.parquet(f"{root}/in")
    df.where("event_id % 4 = 0").coalesce(1).write.mode("append").parquet(f"{root}/in")
    S.stream_dedup(spark, f"{root}/in", df.schema, sink=f"{root}/out", checkpoint=f"{root}/ck")
    got = sorted(r[0] for r in spark.read.parquet(f"{root}/out").select("event_id").collect())
    assert got == list(range(48))

    ev3 = [(i, base + dt.timedelta(hours=i), 1, "view", 1.0, "{}") for i in range(72)]
    spark.createDataFrame(ev3, schema).coalesce(1).write.parquet(f"{root}/in2")
    S.stream_late(spark, f"{root}/in2", df.schema, sink=f"{root}/o2", checkpoint=f"{root}/ck2")
    late = spark.createDataFrame([(100, base - dt.timedelta(days=3), 1, "view", 1.0, "{}")], schema)
    late.coalesce(1).write.mode("append").parquet(f"{root}/in2")
    S.stream_late(spark, f"{root}/in2", df.schema, sink=f"{root}/o2", checkpoint=f"{root}/ck2")
    days = {r["window_start"].day: r["n"] for r in spark.read.parquet(f"{root}/o2").collect()}
    assert days == {5: 24}  # watermark Jan 6 23:00: day 6 still open; the late event (day 2) is dropped
