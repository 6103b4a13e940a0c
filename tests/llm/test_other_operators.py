"""Top-k, toxicity, sharding and chat formatting."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import SF, odd_rows
from ragtide.llm import chat, sharding, topk_bsi, toxicity
from ragtide.llm.common import read_table


def top_by_hand(rows, k, asks):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if asks(i)}):
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_topk(spark, block, monkeypatch):
    monkeypatch.setattr(topk_bsi, "BLOCK_ROWS", 40)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 170)]  # ties
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6),
             (205, [1.0, 2.0]), (210, [2.0, -3.0]), (10, [0.1] * 6), (20, rows[20][1]), (None, [0.1] * 6), (0, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("q", F.lit(1)).repartition(3)
    got = topk_bsi.topk(df, F.col("vec_id") % 10 == 0, 5, query_block=block)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == top_by_hand(rows, 5, lambda i: i % 10 == 0)
    assert topk_bsi.topk(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0
    with pytest.raises(Exception, match="62-bit"):
        topk_bsi.topk(spark.createDataFrame([(0, [1e15, 1.0]), (1, [-1e15, 2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_sharding(spark, odd, none, tmp_path):
    got = sharding.assign_shards(odd, 4, 64).collect()
    rows = odd_rows()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    places = Counter()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        places[s] = 1
    assert set(places) <= set(range(4)) and {r.law for r in got} == {"bytes"}
    assert sharding.assign_shards(none, 4, 64).count() == 0
    path = str(tmp_path / "maps")
    sharding.assign_shards(odd, 4, 64, map_path=path).count()
    first, second = sharding.load_map(spark, path, 1), sharding.load_map(spark, path)
    assert first == [s % 4 for s in range(64)] and second != first
    again = {(r.doc_id, r.shard) for r in sharding.assign_shards(odd, 4, 64, map_path=path).collect()}
    assert sharding.load_map(spark, path, 2) == second and again


def test_rebalancing_is_even_and_frugal():
    rng = random.Random(5)
    size = [rng.randrange(50, 3000) for _ in range(8192)]
    start = sharding.first_map(8192, 40)
    end = sharding.rebalanced(start, size, 40)
    load = [sum(s for s, k in zip(size, end) if k == j) for j in range(40)]
    assert max(load) - min(load) < 60 and sum(a != b for a, b in zip(start, end)) < 2500
    assert sharding.rebalanced(end, size, 40) == end
    assert sharding.rebalanced([0, 1], [0, 0], 2) == [0, 1]


def chats_by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role, text))
    low = lambda x: (x is not None, x)
    lists = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (low(x[0]), low(x[1]), low(x[2])))] for c, v in convs.items()}
    out = []
    for c, v in lists.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in lists.values())
        copies = [d for d, w in lists.items() if w == v]
        if not longer and c == min(copies):
            out.append((c, len(v), len(copies), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in v)))
    return sorted(out)


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
            (3, 2, "user", "more"), (4, 5, "user", "hi"), (4, 9, "assistant", "yes"), (4, 9, "assistant", "yes"), (5, 0, None, "hi"),
            (6, 0, "", "hi"), (7, 0, "user", None), (7, None, "user", "hi"), (8, 0, "user", ""), (None, 0, "user", "x"), (9, 0, "user", "z" * 5000),
            (10, 0, "user", "end"), (11, 0, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x")).withColumn("p1", F.lit(0))
    got = sorted((r.conv_id, r.n_turns, r.n_copies, r.text) for r in chat.format_chats(df).collect())
    assert got == chats_by_hand(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_run_no_python(spark):
    plan = chat.format_chats(read_table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def toxic_corpus(n=400):
    rng = random.Random(2)
    clean = ["".join(rng.choice(["an", "the", "re", "ion", "er", "th", "on", "st"]) for _ in range(3)) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        y = int(i % 4 == 0)
        for _ in range(rng.randrange(1, 4) if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dunce"]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, y))
    return rows, labels


def test_toxicity(spark, odd, none):
    rows, labels = toxic_corpus()
    labels += [(None, 1), (3, None), (5, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("_score", F.lit(1))
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, marks).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) >= 0.95
    model = toxicity.toxicity_model(docs, marks)
    score = lambda t: float(model.score(toxicity.decisions([t], model))[0])
    for spelled in ("blockhead", "BLOCKHEAD!", "b.l.o.c.k.h.e.a.d", "block-head", "b l o c k h e a d", "bl0ckhead"):
        assert score(f"the onthean {spelled} erionst there") >= 0.7, spelled
    assert score("") < 0.3 and score("the onthean erionst there") < 0.3
    scored = toxicity.score_texts(odd, model)
    assert scored.count() == odd.count() and scored.columns == [*odd.columns, "_score"]
    kept = toxicity.drop_toxic(odd, marks.limit(0))  # no label: nothing to reject
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.drop_toxic(docs, marks).where("doc_id % 4 = 0").count() < 10
    assert toxicity.toxicity_report(none, marks).count() == 0
    assert toxicity.toxicity_report(docs, marks.limit(0)).where("predicted = 1").count() == 0


def test_scores_ignore_ids_and_labels(spark):
    """Equal texts get equal scores whatever their ids."""
    rows, labels = toxic_corpus(200)
    docs = spark.createDataFrame(rows + [(i + 10_000, t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i] == got[i + 10_000] for i, _ in rows)


def test_kernel_values_match_the_weights():
    words = [toxicity.folded(w) for w in ("idiot", "blockhead", "alphabet", "abcd", "ab")]
    marks = toxicity.Landmarks(words[:3])
    kernel = marks.kernel(words)
    assert np.allclose(kernel[:3, :3], kernel[:3, :3].T) and (kernel[4] == 0).all()
    beta = np.array([0.5, -1.0, 2.0])
    assert np.allclose(toxicity.weighted_sums(words, marks.weights(beta)), kernel @ beta, atol=1e-5)
