"""Licence scans against plain word comparison."""

import random
import re

import pytest

from conftest_llm import SF, odd_rows
from ragtide.llm import license_scan as scan
from ragtide.llm.common import read_table
from ragtide.llm.license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    w, places = plain_words(text), []
    for label, phrase in PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def plain_matches(w, t):
    """All (end in text, end in template, words) of runs that no template or phrase lets extend, in template ``t``."""
    every = [plain_words(x) for _, x in [*TEMPLATES, *PHRASES]]
    runs = [" " + " ".join(x) + " " for x in every]
    inside = lambda a, b: any(" " + " ".join(w[a:b]) + " " in r for r in runs)
    out, start = [], 0
    for end in range(1, len(w) + 1):
        while start < end and not inside(start, end):
            start += 1
        grows = end < len(w) and start < end and inside(start, end + 1)
        size = end - start
        if not grows and size > 1 and (size >= scan.LONG or any(size == len(x) and w[start:end] == x for x in every[: len(TEMPLATES)])):
            out += [(end, at, size) for at in range(size, len(t) + 1) if t[at - size : at] == w[start:end]]
    return sorted(out)


def texts():
    rng = random.Random(4)
    mit = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 99)
    words = mit.split()
    cut = [w for i, w in enumerate(words) if i % 17 != 5]
    filler = lambda n: " ".join(rng.choice("the of and license under software copy apple pear".split()) for _ in range(n))
    return [None, "", " \n", "CC-BY cc by-nc 4.0", "All Rights\nReserved. all rights reserved", "general public license general public", "cc bys", "cc. by",
            mit, filler(60) + " " + " ".join(cut) + " " + filler(60) + " " + mit, " ".join(words[:20]), " ".join(words[:40]) + " " + filler(5) + " " + " ".join(words[44:]),
            "Released under the MIT License. " * 3, "released under the gpl license", "straße cc by é", "x" * 5000, filler(400),
            "Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License, version 2.", "a cc by b " * 30]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 7])
def test_statistics_and_chains(monkeypatch, slice_bytes):
    monkeypatch.setattr(scan, "SLICE", slice_bytes)
    a = scan.Automaton(TEMPLATES, PHRASES)
    for text in texts():
        s, w = scan.scanned(text and text.encode(), a), plain_words(text)
        assert s.n_words == len(w)
        spans = {k: [x[1:] for x in s.spans() if x[0] == k] for k in range(len(TEMPLATES))}
        for k, (_, t) in enumerate(TEMPLATES):
            assert spans[k] == scan.chains(plain_matches(w, plain_words(t))), (text, t)


def brute_chain(found):
    """Most words that a chain covers, over all subsets."""
    best = 0
    for mask in range(1, 1 << len(found)):
        sub = sorted(m for i, m in enumerate(found) if mask >> i & 1)
        ok = all(a[0] < b[0] and a[1] < b[1] and b[0] - b[2] - a[0] <= scan.GAP and b[1] - b[2] - a[1] <= scan.GAP for a, b in zip(sub, sub[1:]))
        if ok:
            best = max(best, sub[0][2] + sum(min(b[2], b[0] - a[0], b[1] - a[1]) for a, b in zip(sub, sub[1:])))
    return best


def test_chain_covers_most():
    rng = random.Random(1)
    for _ in range(200):
        found = sorted({(rng.randrange(3, 40), rng.randrange(3, 40), rng.randrange(2, 4)) for _ in range(rng.randrange(1, 9))})
        assert max(c[2] for c in scan.chains(found)) == brute_chain(found)


def test_report(spark):
    rows = [(i, t, f"s{i}", i) for i, t in enumerate(texts())] + [(None, "cc by", None, None), (3, texts()[3], "again", 3)]
    rows += [(100 + i, r[1], "odd", 0) for i, r in enumerate(odd_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, state long").repartition(3)
    got = scan.license_report(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    for i, t, *_ in rows:
        want = plain_base(t)
        assert any(x[:5] == want for x in by[i]), t
    for x in got:
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    label = {i: next(iter(v))[5] for i, v in by.items() if len(v) == 1}
    assert label[8] == "mit" and label[9] == "mit" and label[10] == "" and label[11] == "mit" and label[12] == "mit" and label[13] == ""
    assert label[17] == "apache,gnu,gpl" and label[3] == "cc-by,cc-by-nc" and label[0] == label[1] == ""
    spans = scan.license_spans(df).where("doc_id = 9").orderBy("first_word").collect()
    n = len(plain_words(texts()[8]))
    assert [s.label for s in spans] == ["mit", "mit"] and spans[1].end_word - spans[1].first_word == n and spans[1].share == 1.0


def test_report_of_a_table(spark):
    docs = read_table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = scan.license_report(docs).collect()
    assert len(got) == len(text)
    for r in got:
        assert tuple(r)[1:6] == plain_base(text[r.doc_id])
    assert {"apache", "mit", "cc-by-nc", "gpl"} <= {x for r in got for x in r.labels.split(",")}


def test_nothing(spark):
    assert scan.license_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert scan.license_spans(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        scan.Automaton([("a", "word")], PHRASES)
