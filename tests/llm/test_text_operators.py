"""Line and substring deduplication and decontamination against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import odd_rows
from ragtide.llm import decontaminate, line_dedup, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def lines_by_hand(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        if doc is not None:
            for x in (text or "").split("\n"):
                if len(key(x)) >= min_chars:
                    holders[key(x)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(odd):
    got = rows_of(line_dedup.line_report(odd), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == lines_by_hand(odd_rows())
    assert sum(r[2] for r in got) > 5


def test_lines_hot_key_over_many_partitions(spark):
    """One line in every document: its rows straddle partitions and Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    hot = "A line that each and every document of this table holds."
    rows = [(i, f"{hot}\nown line of document number {i % 40} with enough letters\n{hot}") for i in range(200)]
    got = rows_of(line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == lines_by_hand(rows)


def test_lines_keep_columns(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 0 and text is null").count() == 1
    assert line_dedup.dedup_lines(none).count() == 0


def substrings_by_hand(rows, length):
    starts = defaultdict(list)
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                starts[raw[i: i + length]].append(doc)
    first = {k: min(v) for k, v in starts.items()}
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1 if doc is not None else 0):
            if first[raw[i: i + length]] < doc:
                gone[i: i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 33])
def test_substrings(odd, length, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 700)
    got = rows_of(substring_dedup.substring_report(odd, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == substrings_by_hand(odd_rows(), length)
    assert sum(r[3] for r in got) > 10


@pytest.mark.parametrize("length,contexts", [(50, 5), (33, 1)])
def test_substrings_of_a_hot_anchor(spark, length, contexts, monkeypatch):
    """A short template before unlike texts: its many contexts are not asked for in one bucket, with the same result."""
    monkeypatch.setattr(substring_dedup, "HOT_CONTEXTS", contexts)
    monkeypatch.setattr(substring_dedup, "TASK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 700)
    rows = odd_rows() + [(100 + i, f"own{i * 7919} By our staff reporter in town: {i * i * 31} {'same end of twos and threes ' * (i % 3)}{i // 2}") for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    got = rows_of(substring_dedup.substring_report(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == substrings_by_hand(rows, length)
    assert sum(r[3] for r in got if (r[0] or 0) >= 100) > 10
    # round one of one anchor with 40 groups and one with 2
    g, s = np.array([7] * 40 + [9] * 2, np.uint32), substring_dedup._six(np.arange(42, dtype=np.uint64))
    blob = substring_dedup.packed(np.arange(42), g, s)
    out = [r for b in substring_dedup._settle(3)(0, {substring_dedup.GROUPS: [blob]}, iter(())) for r in b.to_pylist()]
    asked = [substring_dedup.unpacked([r["data"]], "<u4", "(6,)u1")[1] for r in out if r["kind"] == substring_dedup.ASK]
    assert all(7 not in x for x in asked) and (contexts == 1 or sum((x == 9).sum() for x in asked) == 2)


def test_substrings_empty(none):
    assert substring_dedup.substring_report(none).count() == 0


def test_unlike_anchors_do_not_meet(spark):
    """of texts that share nothing, no anchor asks for a second round, however many there are (32 bits alone clash from 65,000 on)."""
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, bytearray(rng.bytes(2 << 20))) for i in range(8)], "doc long, data binary")
    kinds = set()
    for r in substring_dedup._sorted(substring_dedup.groups_sent(docs, 50, 400)).mapInArrow(
            substring_dedup._task(substring_dedup._settle(400)), substring_dedup._SPEC).toLocalIterator():
        kinds.add(r.kind)
    assert kinds == set()


def test_texts_are_dealt_out_once(spark, odd):
    """both rounds that need the texts read one exchange."""
    spans = substring_dedup.removed_spans(odd)
    spans.collect()
    plan = spans._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count(" Exchange hashpartitioning") - plan.count("ReusedExchange") == 4


def contamination_by_hand(rows, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            x = words(body)
            m = min(n, len(x))
            windows = {tuple(x[i: i + m]) for i in range(len(x) - m + 1)} if x else set()
            for i in range(len(w) - m + 1 if x else 0):
                if tuple(w[i: i + m]) in windows:
                    hit.update(range(i, i + m))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination(spark, odd, none):
    rows = odd_rows()
    cut = (rows[25][1] or "").split()
    items = [(1, " ".join(cut[15:45]).upper()), (2, None), (3, ""), (4, "two, words"), (5, "one"), (6, rows[4][1] + " nowhere"),
             (7, " ".join((rows[12][1] or "").split()[3:16])), (8, "..."), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_hits", F.lit(1))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = contamination_by_hand(rows, items)
    assert rows_of(decontaminate.contamination_report(odd, bench), *cols) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    # small blocks: several broadcasts, the same hits
    marked = decontaminate.mark_contamination(odd.select("doc_id", "text"), bench, block_bytes=100)
    hits = {(r.doc_id, r.n) for r in marked.select("doc_id", decontaminate.covered_words("_hits").alias("n")).collect()}
    assert hits == {(r[0], r[2]) for r in want}
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == sum(not r[-1] for r in want)
    assert decontaminate.contamination_report(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination_report(none, bench).count() == 0


def test_short_texts_are_numbered_together(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [(i, bytes(rng.integers(97, 100, int(n)).astype(np.uint8))) for i, n in enumerate(rng.integers(0, 400, 300))]
    texts += [(300, None), (None, b"x" * 90), (301, b"y" * 49), (302, b"y" * 50), (303, texts[7][1] * 300), (7, b"")]
    calls = []
    plain = substring_dedup.anchors
    monkeypatch.setattr(substring_dedup, "anchors", lambda *a: calls.append(1) or plain(*a))
    got = list(substring_dedup.anchored(iter(texts), 50))
    assert len(calls) <= 4  # one for each text before
    assert [(doc, raw) for doc, raw, _ in got] == texts
    for doc, raw, parts in got:
        want = [(offset, plain(data, 50)) for offset, data in substring_dedup.segments(raw or b"", 50)] if doc is not None else []
        assert len(parts) == len(want)
        for (offset, _, groups), (at, own) in zip(parts, want):
            assert offset == at
            for x, y in zip(groups, own):
                np.testing.assert_array_equal(x, y)
