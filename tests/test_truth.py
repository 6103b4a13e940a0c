"""Documents that hold a passage, against plain substring search."""

import random

from ragtide.operators import truth as T


def test_containment(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta omega zeta kappa".split()) + str(rng.randrange(6))
    passages = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 5, 8, 20)] + ["", None, "été à Zürich, 東京 x", "a (b) c; d", "  spaced  out  text here "]
    docs = []
    for i in range(120):
        t = " ".join(word() for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            t += rng.choice(["", " ", "x"]) + (passages[i % len(passages)] or "") + rng.choice(["", "y tail", " end"])
        docs.append((i, t))
    docs += [(500, None), (501, ""), (0, docs[0][1])] + [(600 + i, "the very " + passages[5] + " again") for i in range(40)]
    ps = spark.createDataFrame(list(enumerate(passages)), "qid int, passage string")
    ds = spark.createDataFrame(docs, "doc int, text string").repartition(3)
    got = [tuple(r) for r in T.containing_documents(ps, ds).collect()]
    want = {(q, d) for q, p in enumerate(passages) if p for d, t in docs if t and p in t}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_ranked_recall(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (3, 30)], "qid int, doc int")
    hits = spark.createDataFrame([(1, 1, 11), (1, 2, 11), (1, 3, 99), (1, 4, 10), (2, 1, 98), (9, 1, 1)], "qid int, rank int, doc int")
    got = {r.qid: r for r in T.ranked_recall(hits, truth, 4).collect()}
    from math import log2

    ideal = 1 + 1 / log2(3) + 1 / log2(4)
    assert got[1].n_relevant == 3 and got[1].n_found == 2 and got[1].recall == 0.666667 and got[1].reciprocal_rank == 1.0
    assert abs(got[1].ndcg - (1 + 1 / log2(5)) / ideal) < 1e-6
    assert (got[2].recall, got[2].reciprocal_rank, got[2].ndcg) == (0, 0, 0) and set(got) == {1, 2, 3}
