"""Anchors-hierarchy metric trees over integer points, with cached sums and counts.

A tree is grown middle-out (Moore 2000): some sqrt(m) anchors take the points nearest to them, each new
anchor being the point farthest from its owner and stealing only points that the triangle inequality leaves
open; the anchors' balls are then paired up, closest hull first, to a root, and each anchor's own points are
split the same way until a ball holds at most ``LEAF`` distinct points.

A tree is four arrays: ``points`` (distinct, grouped so that a ball's points are one slice), ``weights`` (copies of
each), ``balls`` (left, right, first point, end; leaves have left -1) and the balls' centres and radii.  Sums and counts
of balls are prefix sums over the slices.
"""

from __future__ import annotations

import numpy as np

LEAF = 40
SLACK = 1e-9  # relative; a candidate is only dropped if it loses by more than rounding can explain


class Tree:
    def __init__(self, points: np.ndarray):
        """``points`` (m, k) of longs; ``row_of`` maps each of them to its distinct point."""
        distinct, back, counts = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        self.balls: list[tuple[int, int, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.order: list[np.ndarray] = []
        self.filled = 0
        self.all = distinct.astype(float)
        self.root = self._grow(np.arange(len(distinct)))
        order = np.concatenate(self.order)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.points, self.weights, self.row_of = distinct[order], counts[order], place[back.ravel()]
        self.finish()

    def plain(self) -> tuple:
        """Without this class, as trees are kept in tables."""
        return self.points, self.weights, self.row_of, np.array(self.balls), np.array(self.centres), np.array(self.radii), self.root

    @classmethod
    def of(cls, state: tuple) -> "Tree":
        tree = cls.__new__(cls)
        tree.points, tree.weights, tree.row_of, tree.balls, tree.centres, tree.radii, tree.root = state
        tree.finish()
        return tree

    def finish(self) -> None:
        """The cached sums and counts, as prefix sums."""
        zero = np.zeros((1, self.points.shape[1]), dtype=np.int64)
        self.sums = np.concatenate([zero, np.cumsum(self.points * self.weights[:, None], axis=0)])
        self.counts = np.concatenate([[0], np.cumsum(self.weights)])

    def _ball(self, left: int, right: int, first: int, end: int, rows: np.ndarray) -> int:
        own = self.all[rows]
        centre = own.mean(0)
        self.balls.append((left, right, first, end))
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())) * (1 + SLACK))
        return len(self.balls) - 1

    def _leaf(self, rows: np.ndarray) -> int:
        first = self.filled
        self.order.append(rows)
        self.filled += len(rows)
        return self._ball(-1, -1, first, self.filled, rows)

    def _grow(self, rows: np.ndarray) -> int:
        """Ball of these points, laid out as one slice."""
        if len(rows) <= LEAF:
            return self._leaf(rows)
        groups = self._anchors(rows)
        if len(groups) < 2:
            return self._leaf(rows)
        plan = self._paired(groups)
        return self._laid(plan, groups)[0]

    def _anchors(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of each anchor; middle-out, sqrt(m) of them."""
        p = self.all[rows]
        far = np.sqrt(((p - p[0]) ** 2).sum(1))
        owner, anchors = np.zeros(len(rows), dtype=np.int64), [p[0]]
        for k in range(1, int(np.ceil(np.sqrt(len(rows))))):
            new = int(far.argmax())
            if far[new] == 0:
                break
            centre = p[new]
            apart = np.sqrt(((np.array(anchors) - centre) ** 2).sum(1))
            open_ = np.flatnonzero(far >= apart[owner] / 2 * (1 - SLACK))  # others are nearer to their own anchor
            away = np.sqrt(((p[open_] - centre) ** 2).sum(1))
            won = away < far[open_]
            taken = open_[won]
            owner[taken], far[taken] = k, away[won]
            anchors.append(centre)
        return [rows[own] for k in range(len(anchors)) if len(own := np.flatnonzero(owner == k))]

    def _paired(self, groups: list[np.ndarray]):
        """Nested pairs of group numbers: the two balls whose hull is smallest go together, up to one."""
        own = [self.all[g] for g in groups]
        centre = np.array([g.mean(0) for g in own])
        radius = np.array([np.sqrt(((g - c) ** 2).sum(1).max()) for g, c in zip(own, centre)])
        size, names = np.array([float(len(g)) for g in own]), list(range(len(groups)))
        apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
        hull = np.maximum((apart + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(hull, np.inf)
        for _ in range(len(groups) - 1):
            a, b = divmod(int(hull.argmin()), len(groups))
            names[a], names[b] = (names[a], names[b]), None
            radius[a] = hull[a, b]
            centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            hull[b], hull[:, b] = np.inf, np.inf
            alive = np.isfinite(hull[a])
            alive[a] = False
            away = np.sqrt(((centre - centre[a]) ** 2).sum(1))
            hull[a] = hull[:, a] = np.where(alive, np.maximum((away + radius + radius[a]) / 2, np.maximum(radius, radius[a])), np.inf)
        return names[a]

    def _laid(self, plan, groups: list[np.ndarray]) -> tuple[int, np.ndarray]:
        """Ball number and rows of a nested pair of groups; iterative, as pairs may nest deeply."""
        done: list[tuple[int, np.ndarray]] = []
        todo = [(plan, False)]
        while todo:
            node, ready = todo.pop()
            if not isinstance(node, tuple):
                rows = groups[node]
                done.append((self._grow(rows), rows))
            elif ready:
                (right, b), (left, a) = done.pop(), done.pop()
                rows = np.concatenate([a, b])
                done.append((self._ball(left, right, self.balls[left][2], self.balls[right][3], rows), rows))
            else:
                todo += [(node, True), (node[1], False), (node[0], False)]
        return done[0]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of each distinct point (ties to the lower), sums and counts by entry, and distances taken.

        A ball inherits its parent's candidates and drops those that lose to another on every point of it; a ball with
        one candidate left is owned and gives its cached sum and count.  Points of leaves are settled in integers.
        """
        code = np.zeros(len(self.points), dtype=np.int64)
        sums, counts = np.zeros((len(entries), self.points.shape[1]), dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        where, taken = entries.astype(float), 0
        todo = [(self.root, np.arange(len(entries)))]
        while todo:
            ball, cand = todo.pop()
            left, right, first, end = self.balls[ball]
            from_centre = ((where[cand] - self.centres[ball]) ** 2).sum(1)
            taken += len(cand)
            best = int(from_centre.argmin())
            apart = np.sqrt(((where[cand] - where[cand[best]]) ** 2).sum(1))
            # another entry is out if the plane halfway to the best one doesn't touch the ball; an equal one has the higher number
            lead = from_centre - from_centre[best] - 2 * apart * self.radii[ball]
            stays = (lead <= SLACK * (1 + from_centre)) & (apart > 0)
            stays[best] = True
            cand = cand[stays]
            if len(cand) > 1 and left >= 0:
                todo += [(right, cand), (left, cand)]
                continue
            if len(cand) > 1:
                gap = self.points[first:end, None, :] - entries[None, cand]
                own = cand[(gap * gap).sum(2).argmin(1)]
                taken += (end - first) * len(cand)
                code[first:end] = own
                np.add.at(sums, own, self.points[first:end] * self.weights[first:end, None])
                np.add.at(counts, own, self.weights[first:end])
            else:
                code[first:end] = cand[0]
                sums[cand[0]] += self.sums[end] - self.sums[first]
                counts[cand[0]] += self.counts[end] - self.counts[first]
        return code, sums, counts, taken
