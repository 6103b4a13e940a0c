"""Vector codes and whitening against plain numpy over the whole table."""

import hashlib

import numpy as np
import pytest

from conftest_llm import SF
from ragtide.llm import secular, vector_codes, whitening
from ragtide.llm.common import read_table
from ragtide.llm.metric_tree import Tree

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, component int, `n` long"


def vector_rows(dim=16, seed=3):
    """Copies, a hot vector, null ids and labels, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(90, dim)).astype(np.float32)
    rows = [(int(i * 3 % 101), [float(v) for v in base[i]], int(i % 4) if i % 5 else None) for i in range(90)]
    rows += [(200 + i, rows[0][1], 1) for i in range(60)]  # one vector in a third of all rows
    rows += [rows[4], rows[4], (None, rows[7][1], None), (None, None, 2), (300, [], 2), (301, [1.0] * (dim - 1), 2)]
    rows += [(302, [float("nan")] + [0.0] * (dim - 1), 0), (303, [None] + [0.0] * (dim - 1), 0), (304, [float("inf")] + [0.5] * (dim - 1), 0), (305, [1e30] * dim, 0)]
    return [(*r, "x", "c", 1, 2) for r in rows]


def taken(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(v is not None and np.isfinite(v) and abs(v) < 1e6 for v in r[1])]


def plain_codes(rows, dim, parts=16, entries=64, rounds=2):
    ids = [r[0] for r in rows]
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i] or 0, list(x[i])))
    codes, errors, books = [], 0, []
    for p in np.split(x, parts, axis=1):
        c = p[order[:entries]].copy()
        near = lambda: ((p[:, None] - c[None]) ** 2).sum(2)
        for _ in range(rounds):
            own = near().argmin(1)
            for e in range(len(c)):
                if (own == e).any():
                    c[e] = p[own == e].sum(0) // (own == e).sum()
        codes.append(near().argmin(1))
        errors = errors + near().min(1)
        books += [str(int(v)) for v in c.ravel()]
    label = {}
    for r, e in zip(rows, errors):
        label[r[2]] = label.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted(((r[0] is None, r[0] or 0, "".join(f"{k[i]:02x}" for k in codes), int(errors[i]), label[r[2]], sha) for i, r in enumerate(rows)))


def got_codes(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("dim", [16, 64])
def test_codes(spark, dim):
    rows = vector_rows(dim)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got_codes(vector_codes.code_report(df)) == plain_codes(taken(rows, dim), dim)


def test_codes_of_a_table(spark):
    df = read_table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got_codes(vector_codes.code_report(df)) == plain_codes(rows, 64)


def test_codes_with_joined_labels(spark, monkeypatch):
    rows = vector_rows()
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert got_codes(vector_codes.code_report(spark.createDataFrame(rows, SCHEMA))) == plain_codes(taken(rows, 16), 16)


def test_few_none_and_odd_lengths(spark):
    few = vector_rows()[:3]
    assert got_codes(vector_codes.code_report(spark.createDataFrame(few, SCHEMA))) == plain_codes(few, 16)
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.code_report(empty).count() == 0 == whitening.whiten(empty).count()
    with pytest.raises(ValueError):
        vector_codes.code_report(spark.createDataFrame([(1, [0.5] * 17, 1, "", "", 1, 1)], SCHEMA))


def test_tree_owns_balls_and_prunes():
    rng = np.random.default_rng(0)
    for m, k in ((1, 3), (50, 4), (3000, 2), (3000, 4)):
        p = np.floor(40 * rng.normal(size=(m, k))).astype(np.int64)
        p[: m // 3] = p[0]
        entries = np.concatenate([p[-30:], p[-3:]])  # the last ones are equal to others and win nothing
        tree = Tree.of(Tree(p).plain())
        code, sums, counts, distances = tree.nearest(entries)
        own = ((p[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (code[tree.row_of] == own).all()
        for e in range(len(entries)):
            assert counts[e] == (own == e).sum() and (sums[e] == p[own == e].sum(0)).all()
        if m == 3000:
            assert distances < len(tree.points) * len(entries) / (4 if k == 2 else 1.5)


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_rank_one_updates(k):
    rng = np.random.default_rng(k)
    d, u, total = np.zeros((3, k)), np.tile(np.eye(k), (3, 1, 1)), np.zeros((3, k, k))
    for i in range(200):
        v = rng.normal(size=(3, k)) * 10.0 ** rng.integers(-3, 3)
        v[:, : k // 2] *= i % 3 > 0  # zeros in z
        v[1] *= i % 2  # nothing new in one chain
        v[2] = np.round(v[2])
        total += v[:, :, None] * v[:, None, :]
        d, u = secular.update(d, u, v)
    size = np.abs(total).max()
    assert np.abs(u.transpose(0, 2, 1) @ u - np.eye(k)).max() < 1e-12
    assert np.abs(u * d[:, None] @ u.transpose(0, 2, 1) - total).max() < 1e-12 * size
    assert np.abs(d - np.linalg.eigvalsh(total)).max() < 1e-12 * size


def plain_white(rows, components=16):
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.atleast_2d(np.cov(fit.T.astype(float), bias=True)))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    total = (n * x - s) ** 2
    shifted = (x - s / n) @ axes / np.sqrt(values)
    trace = np.cov(fit.T.astype(float), bias=True).trace()
    return n, total.sum(1), shifted, values / trace


def check_white(df, rows):
    n, deviation, white, explained = plain_white(rows)
    k = white.shape[1]
    got = df.collect()
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    signs = {}
    want = {}
    for r, dev, w in zip(rows, deviation, white):
        want.setdefault((r[0], int(dev), tuple(np.round(np.abs(w), 6))), 0)
        want[r[0], int(dev), tuple(np.round(np.abs(w), 6))] += 1
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
    for r, dev, w in zip(rows, deviation, white):
        found = by[r[0], int(dev)]
        for c in range(k):
            if abs(w[c]) > 1e-6:
                near = min(found[c + 1], key=lambda v: abs(abs(v) - abs(w[c])))
                assert abs(abs(near) - abs(w[c])) < 1e-8
                assert signs.setdefault(c, np.sign(near * w[c])) == np.sign(near * w[c])


def test_whitening(spark):
    rows = vector_rows(20)
    check_white(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)), taken(rows, 20))


def test_whitening_of_a_table(spark):
    df = read_table(spark, SF, "embeddings")
    check_white(whitening.whiten(df), [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_without_variance(spark):
    one = [(i, [0.5, 0.25, -1.0], 0, "", "", 0, 0) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(one, SCHEMA)).collect()
    assert len(got) == 12 and {(r.n, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in got} == {(1, None, 0.0, None, 0)}
    flat = [(i, [float(i), 0.25, 2.0 * i], 0, "", "", 0, 0) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and max(r.identity_error for r in got) < 1e-9


def test_spectra_take_later_vectors(spark):
    """A stored spectrum and the spectrum of new vectors merge into that of all of them."""
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(-300, 300, size=(400, 6)), axis=0)
    frame = lambda part: spark.createDataFrame([(p.tolist(),) for p in part], "x array<long>").repartition(3)
    both = frame(x[:250]).sparkSession
    old, new = whitening.spectra(frame(x[:250])), whitening.spectra(frame(x[250:]))
    state = whitening.merged(old.union(new.selectExpr("slot + 3 as slot", "state")), lambda p: whitening.combined([whitening.Spectrum(*s) for s in p]).plain())
    n, sums, values, vectors = state
    assert both is spark and n == len(x) and sums == x.sum(0).tolist()
    scatter = np.cov(x.T.astype(float), bias=True) * n
    assert np.abs(vectors * values @ vectors.T - scatter).max() < 1e-9 * np.abs(scatter).max()
