"""Content-defined chunks: cover, bounds, and what an edit moves."""

import random

from ragtide.operators import content_chunks as C


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_cuts_cover_and_resume_after_an_edit():
    rng = random.Random(1)
    for text in ["", "x", "a" * 5000, "é日😀" * 900, text_of(rng, 3000)]:
        ends = C.cut_points(text)
        assert (ends == [] and not text) or (ends[-1] == len(text) and ends == sorted(set(ends)))
        assert all(b - a <= C.MAX_SIZE for a, b in zip([0, *ends], ends))
        assert all(b - a >= C.MIN_SIZE for a, b in zip([0, *ends[:-1]], ends[:-1]))
    text = text_of(rng, 6000)
    edited = text[:9000] + "an inserted sentence " + text[9000:]
    pieces = lambda t: [t[a:b] for a, b in zip([0, *C.cut_points(t)], C.cut_points(t))]
    old, new = pieces(text), pieces(edited)
    assert len(set(new) - set(old)) <= 4 < len(old) / 4


def test_only_unseen_chunks_are_encoded(spark):
    rng = random.Random(2)
    v1 = [(i, text_of(rng, 900)) for i in range(8)] + [(8, None), (9, "")]
    v2 = [(i, t[:2000] + "new words here " + t[2000:] if i == 3 else t) for i, t in v1]
    frame = lambda rows: spark.createDataFrame(rows, "doc int, text string")
    first, second = C.chunk_by_content(frame(v1)), C.chunk_by_content(frame(v2))
    fake = lambda df: df.selectExpr("chunk_id", "array(length(text)) as embedding")
    none = fake(first.limit(0))
    stored = fake(C.unseen_chunks(first, none)).checkpoint()
    fresh = C.unseen_chunks(second, stored)
    assert 0 < fresh.count() <= 4 and {r.doc for r in second.join(fresh.select("chunk_id"), "chunk_id").collect()} == {3}
    index = C.with_vectors(second, stored.unionByName(fake(fresh)))
    got = {}
    for r in index.orderBy("doc", "chunk_no").collect():
        got[r.doc] = got.get(r.doc, "") + r.text
        assert r.embedding == [len(r.text)]
    assert got == {i: t for i, t in v2 if t} and index.count() == second.count()
