"""Rank-one changes of symmetric eigendecompositions, several chains at a time.

Arrays carry a leading axis of chains: ``d`` (chain, k) ascending eigenvalues, ``u`` (chain, k, k)
with eigenvectors as columns.  ``update`` gives the decomposition of ``u diag(d) u' + v v'``: entries
that the change doesn't reach are deflated, the others are the roots of the secular equation
``1 + sum(z_j^2 / (d_j - x)) = 0``.  Each root is held as a distance from its nearer pole, and the
eigenvectors come from the z that these roots solve exactly, so they stay orthogonal (Gu and
Eisenstat 1994; Bunch, Nielsen and Sorensen 1978).
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
STEPS = 60  # a root halves its bracket at worst; most need 4 to 8 steps


def update(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decomposition after adding ``v v'`` (one vector a chain; a zero vector changes nothing)."""
    z = np.matmul(v[:, None, :], u)[:, 0]
    norm = np.sqrt((z * z).sum(1))
    tol = 8 * EPS * np.maximum(np.abs(d).max(1), norm * norm)
    small = np.sqrt(tol * EPS)  # z_j^2 of this size is lost beside the largest eigenvalue
    z = np.where(np.abs(z) * norm[:, None] <= tol[:, None], 0.0, z)
    z = np.where(np.abs(z) <= small[:, None], 0.0, z)
    u = _merge_equal(d, u, z, tol)
    live = z != 0
    if not live.any():
        return d, u
    roots, gaps = _roots(d, z, live)
    z = _exact_z(d, z, live, gaps)
    new = np.where(live, roots, d)
    w = np.where(live[:, :, None], z[:, None, :] / np.where(live[:, :, None] & live[:, None, :], gaps, 1.0), 0.0)
    w /= np.maximum(np.sqrt((w * w).sum(2, keepdims=True)), np.finfo(float).tiny)
    w += np.where(live, 0.0, 1.0)[:, :, None] * np.eye(d.shape[1])
    order = np.argsort(new, axis=1, kind="stable")
    w = np.take_along_axis(w, order[:, :, None], axis=1)
    return np.take_along_axis(new, order, axis=1), np.matmul(u, w.transpose(0, 2, 1))


def _merge_equal(d, u, z, tol) -> np.ndarray:
    """Deflate equal eigenvalues: rotate each pair so that z stays in the later one only (z is changed in place)."""
    close = (d[:, 1:] - d[:, :-1] <= tol[:, None])
    if not (close & (z[:, :-1] != 0)).any():
        return u
    u = u.copy()
    for j in np.flatnonzero(close.any(0)):
        at = np.flatnonzero(close[:, j] & (z[:, j] != 0))
        if len(at):
            a, b = z[at, j], z[at, j + 1]
            r = np.hypot(a, b)
            c, s = (b / r)[:, None], (a / r)[:, None]
            z[at, j], z[at, j + 1] = 0.0, r
            left, right = u[at, :, j], u[at, :, j + 1]
            u[at, :, j], u[at, :, j + 1] = c * left - s * right, s * left + c * right
    return u


def _roots(d, z, live):
    """Roots of the live entries, and gaps[chain, i, j] = d_j - root_i without cancellation."""
    chains, k = d.shape
    z2 = np.where(live, z * z, 0.0)
    total = z2.sum(1, keepdims=True)
    above = np.where(live, d, np.inf)
    after = np.full_like(d, np.inf)
    after[:, :-1] = np.minimum.accumulate(above[:, ::-1], axis=1)[:, ::-1][:, 1:]
    last = live & np.isinf(after)
    width = np.where(last, total * (1 + 4 * EPS), np.where(np.isinf(after), 1.0, after - d))

    chain, i = np.nonzero(live)  # from here on a row for each root
    below = (np.arange(k)[None, :] <= np.arange(k)[:, None]).astype(float)[i]
    diff, z2, last, width = d[chain] - d[chain, i][:, None], z2[chain], last[chain, i], width[chain, i]

    def parts(gap, z2, below):
        q = z2 / np.where(gap == 0, np.finfo(float).tiny, gap)
        q2 = q / np.where(gap == 0, np.finfo(float).tiny, gap)
        psi, dpsi = np.einsum("ij,ij->i", q, below), np.einsum("ij,ij->i", q2, below)
        return psi, q.sum(1) - psi, dpsi, q2.sum(1) - dpsi

    with np.errstate(all="ignore"):
        half = width / 2
        psi, phi, *_ = parts(diff - half[:, None], z2, below)
        beyond = 1 + psi + phi < 0
        right = beyond & ~last  # the root lies nearer to the next pole
        base = diff - np.where(right, width, 0.0)[:, None]
        mine, nxt = np.where(right, -width, 0.0), np.where(right, 0.0, width)  # both poles as seen from the origin
        lo, hi = np.where(right, -half, 0.0), np.where(right, 0.0, np.where(last & beyond, width, half))
        lo = np.where(last & beyond, half, lo)
        x = (lo + hi) / 2
        at = np.arange(len(x))
        for _ in range(STEPS):
            xs, end = x[at], last[at]
            psi, phi, dpsi, dphi = parts(base[at] - xs[:, None], z2[at], below[at])
            f = 1 + psi + phi
            lo[at], hi[at] = np.where(f < 0, xs, lo[at]), np.where(f >= 0, xs, hi[at])
            wide = (np.abs(f) > 16 * EPS * (1 + phi - psi)) & (hi[at] - lo[at] > 2 * EPS * np.maximum(np.abs(lo[at]), np.abs(hi[at])))
            if not wide.any():
                break
            at, xs, end, psi, phi, dpsi, dphi, f = (v[wide] for v in (at, xs, end, psi, phi, dpsi, dphi, f))
            a, b = mine[at] - xs, nxt[at] - xs
            s, q = a * a * dpsi, np.where(end, 0.0, b * b * dphi)
            c = 1 + (psi - a * dpsi) + np.where(end, 0.0, phi - b * dphi)
            p, r = c * (a + b) + s + q, a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * r, 0))
            new = xs + np.where(end, a + s / c, np.where(p <= 0, (p - root) / (2 * c), 2 * r / (p + root)))
            x[at] = np.where(np.isfinite(new) & (new > lo[at]) & (new < hi[at]), new, (lo[at] + hi[at]) / 2)
    roots, gaps = d.copy(), np.ones((chains, k, k))
    roots[chain, i] = d[chain, i] + np.where(right, width, 0.0) + x
    gaps[chain, i] = base - x[:, None]
    return roots, gaps


def _exact_z(d, z, live, gaps):
    """The z whose secular equation has exactly these roots: z_j^2 = prod(root_i - d_j) / prod(d_i - d_j)."""
    k = d.shape[1]
    pair = live[:, :, None] & live[:, None, :]
    num = np.where(pair, -gaps, 1.0)  # [i, j] root_i - d_j
    den = np.where(pair & ~np.eye(k, dtype=bool), d[:, :, None] - d[:, None, :], 1.0)  # [i, j] d_i - d_j
    ratio = np.abs(num / np.where(den == 0, 1.0, den))
    return np.where(live, np.sqrt(ratio.prod(1)) * np.where(z < 0, -1.0, 1.0), 0.0)


def merge(d1, u1, d2, u2, link):
    """Decomposition of the sum of two scatters plus ``link link'``: each axis of the second is one rank-one change."""
    keep = d2 > 0
    for j in np.flatnonzero(keep.any(0)):
        d1, u1 = update(d1, u1, u2[:, :, j] * np.sqrt(np.where(keep[:, j], d2[:, j], 0.0))[:, None])
    return update(d1, u1, link)
