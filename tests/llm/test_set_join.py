"""N-gram Jaccard groups against all pairs; components; copies and common passages."""

import random
import re

import numpy as np
import pytest

from conftest_llm import odd_rows
from ragtide.llm import setjoin
from ragtide.llm.common import stored
from ragtide.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_by_hand(rows, words=4, percent=85):
    sets = []
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append((doc, {tuple(w[i: i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, s) in enumerate(sets):
        if s and doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((doc, len(s), low.get(find(i), doc) if s else doc) for i, (doc, s) in enumerate(sets)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_groups(odd, none):
    want = groups_by_hand(odd_rows())
    assert result(setjoin.jaccard_groups(odd)) == want
    assert len({r[2] for r in want}) < len(want) - 5
    assert setjoin.jaccard_groups(none).count() == 0


@pytest.mark.parametrize("words,percent,longest", [(4, 85, 4000), (5, 80, 2), (2, 50, 4000)])
def test_random_families(spark, words, percent, longest, monkeypatch):
    """Families of edited copies, some edited again, with one passage in every text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    monkeypatch.setattr(setjoin, "LIST_SETS", longest)  # both ways of pairing a list
    rng = random.Random(words)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for family in range(12):
        text = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))] + common
        for _ in range(rng.randrange(1, 9)):
            text = list(text)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(60)}"
            rows.append((len(rows) * 3 % 97 + 100 * len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(setjoin.jaccard_groups(df, words, percent)) == groups_by_hand(rows, words, percent)


def test_keep_one(odd):
    kept = setjoin.keep_one(odd, 4, 85)
    assert kept.columns == odd.columns
    gone = {r[0] for r in groups_by_hand(odd_rows()) if r[0] is not None and r[0] != r[2]}
    ids = [r.doc_id for r in kept.collect()]
    assert gone and not gone & set(ids) and {r[0] for r in odd_rows()} - gone == set(ids)


def test_keep_one_counts_rows(spark):
    """One row of each group stays, whatever ids the rows have: null, repeated, or one id for two texts."""
    base, other, alone, clean = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    near = lambda t, k: " ".join([*t[:k], "edit", *t[k + 1:]])
    text = {k: " ".join(t) for k, t in zip(("base", "other", "alone", "clean"), (base, other, alone, clean))}
    rows = [(5, text["base"], "x"), (None, near(base, 0), "x"), (None, text["base"], "x"),  # nulls beside a named row
            (None, text["other"], "x"), (None, near(other, 0), "x"), (None, text["other"], "x"),  # a group of nulls only
            (7, text["alone"], "z"), (7, text["alone"], "y"), (7, text["alone"], "y"),  # one row, repeated
            (8, near(base, 59), "x"), (8, text["clean"], "x"),  # two texts of one id, one of them a near copy
            (9, None, "x"), (9, None, "x"), (None, "  ", "x")]  # without shingles
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [tuple(r) for r in setjoin.keep_one(docs, 5, 80).collect()]
    others = [r for r in kept if r[0] is None and r[1] and r[1].strip()]
    assert len(others) == 1 and others[0] in rows[3:6]
    want = [(5, text["base"], "x"), (7, text["alone"], "y"), (8, text["clean"], "x"), (9, None, "x"), (9, None, "x"), (None, "  ", "x")]
    assert sorted((r for r in kept if r not in others), key=str) == sorted(want, key=str)


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_linked_sets_share_their_prefixes():
    """``prefix_needed`` is what linked sets share at least, in whatever common order the prefixes are taken."""
    rng, links = np.random.default_rng(0), 0
    for _ in range(6000):
        n = int(rng.integers(1, 160))
        a = rng.choice(1000, n, replace=False)
        b = a.copy()
        edits = int(rng.integers(0, n // 5 + 1))
        b[rng.choice(n, edits, replace=False)] = rng.choice(np.arange(1000, 2000), edits, replace=False)
        b = b[: max(1, n - int(rng.integers(0, n // 8 + 1)))]
        order = rng.permutation(2000)
        for percent in (80, 85):
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                x, y = (v[np.argsort(order[v])][: setjoin.prefix_length(len(v), percent)] for v in (a, b))
                assert len(np.intersect1d(x, y)) >= setjoin.prefix_needed(len(a), len(b), percent)
                links += 1
    assert links > 1000


def test_stored_tables_are_files(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, None)], "x long, y long, z string")
    got = stored(df)
    assert got.schema == df.schema and sorted(got.collect(), key=str) == sorted(df.collect(), key=str)
    assert "parquet" in got._jdf.queryExecution().executedPlan().toString().lower()
    none = stored(df.where("x = 0"))
    assert none.schema == df.schema and none.count() == 0


def test_lists_tasks_send_no_pair_that_bitmaps_rule_out(spark):
    rng = np.random.default_rng(5)
    sets = {}
    for i, n in enumerate([20, 40, 70, 150, 150, 150, 300]):
        sets[i + 1] = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    sets[8] = np.append(sets[4][:-3], np.uint64(7))  # links with 4
    folded = {i: setjoin.folded(setjoin.parity_bits(h), setjoin.SIGNED).tobytes() for i, h in sets.items()}
    names = list(sets)
    bits = setjoin.apart([folded[i] for i in names])
    for x, i in enumerate(names):
        for y, d in enumerate(bits(x, np.arange(len(names))).tolist()):
            assert d <= len(np.setxor1d(sets[i], sets[names[y]]))
    rows = [(i, token, i, len(sets[i]), i, 20, folded[i]) for token in range(20) for i in (4, 5, 6, 8)]
    rows = [(4, *r[1:]) for r in rows]
    lists = spark.createDataFrame(rows, "low long, token long, s long, n long, root long, r long, sig binary")
    got = {(r.a, r.b) for r in setjoin.short_list_pairs(lists, 85).collect()}
    assert got == {(4, 8)}


def test_components_of_few_links_run_in_few_tasks(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(8)
        tracker, seen = spark.sparkContext.statusTracker(), 0
        spark.sparkContext.setJobGroup("few-links", "")
        got = {r.node: r.root for r in components(links).collect()}
        for job in tracker.getJobIdsForGroup("few-links"):
            for stage in tracker.getJobInfo(job).stageIds:
                info = tracker.getStageInfo(stage)
                seen += info.numCompletedTasks if info else 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: 0 for i in range(41)}
    assert seen <= 300  # 779 when every shuffle of a round had all its partitions
