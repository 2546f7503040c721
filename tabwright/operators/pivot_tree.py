"""A tree of pivots over vectors: cells split by their own pivots until they are small, radii at every level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

FAN_OUT = 24
LLOYD_ROUNDS = 3


def numbers(vectors: np.ndarray, codes: int) -> np.ndarray:
    """All but the last ``codes`` places."""
    return vectors[:, :vectors.shape[1] - codes]


def distances(vectors: np.ndarray, points: np.ndarray, codes: int = 0) -> np.ndarray:
    """Distances of all vectors to all points by one matrix product; callers allow for its rounding.

    The last ``codes`` places are level codes: a differing level adds 2 to the
    square, as in one-hot vectors, which are never laid out.
    """
    v, p = numbers(vectors, codes), numbers(points, codes)
    d2 = (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2.0 * v @ p.T
    d2 = np.maximum(d2, 0.0)
    for c in range(vectors.shape[1] - codes, vectors.shape[1]):
        d2 += 2.0 * (vectors[:, c][:, None] != points[:, c])
    return np.sqrt(d2)


def _centres(sample: np.ndarray, wanted: int, codes: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``wanted`` distinct points in the middle of groups of the sample: means of numbers, commonest codes."""
    points = np.unique(sample[rng.permutation(len(sample))[: 4 * wanted]], axis=0)
    points = points[rng.permutation(len(points))[:wanted]]
    for _ in range(LLOYD_ROUNDS if len(points) > 1 else 0):
        own = distances(sample, points, codes).argmin(axis=1)
        middle = [np.concatenate([numbers(part, codes).mean(axis=0), [_commonest(part[:, c]) for c in range(sample.shape[1] - codes, sample.shape[1])]])
                  for part in (sample[own == j] for j in np.unique(own))]
        points = np.unique(np.array(middle), axis=0)
    return points


def _commonest(values: np.ndarray) -> float:
    found, n = np.unique(values, return_counts=True)
    return found[n.argmax()]


@dataclass
class PivotTree:
    """Vectors of ``width`` places, the last ``codes`` of them level codes. Node 0 is the root.

    The children of a node lie one after another; a node without children is a cell.
    """

    width: int
    codes: int = 0
    pivots: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    kids: np.ndarray = field(init=False)

    def __post_init__(self):
        self.pivots = np.zeros((1, self.width))
        self.first, self.kids = np.zeros(1, "int64"), np.zeros(1, "int64")

    def __len__(self) -> int:
        return len(self.first)

    def state(self) -> tuple:
        """The tree as plain values: a broadcast class would ask workers for the package."""
        return self.width, self.codes, self.pivots, self.first, self.kids

    @classmethod
    def of(cls, width: int, codes: int, pivots: np.ndarray, first: np.ndarray, kids: np.ndarray) -> PivotTree:
        tree = cls(width, codes)
        tree.pivots, tree.first, tree.kids = pivots, first, kids
        return tree

    def split(self, node: int, points: np.ndarray) -> range:
        start = len(self)
        self.first[node], self.kids[node] = start, len(points)
        self.pivots = np.concatenate([self.pivots, points])
        self.first = np.concatenate([self.first, np.zeros(len(points), "int64")])
        self.kids = np.concatenate([self.kids, np.zeros(len(points), "int64")])
        return range(start, start + len(points))

    def grow(self, node: int, sample: np.ndarray, rows: int, leaf_rows: int, fan_out: int, max_nodes: int) -> bool:
        """Split a cell of ``rows`` rows by a sample of them until cells should hold ``leaf_rows`` or the sample is used up."""
        rng = np.random.default_rng(node + 1)
        per_row, todo, grown = rows / max(len(sample), 1), [(node, sample)], False
        while todo:
            at, part = todo.pop()
            expected = len(part) * per_row
            if expected <= leaf_rows or len(part) < 4 or len(self) + fan_out > max_nodes:
                continue
            points = _centres(part, int(min(fan_out, max(2, np.ceil(1.5 * expected / leaf_rows)), max(2, len(part) // 2))), self.codes, rng)
            if len(points) < 2:
                continue
            own = distances(part, points, self.codes).argmin(axis=1)
            todo += [(child, part[own == j]) for j, child in enumerate(self.split(at, points))]
            grown = True
        return grown

    def descend(self, vectors: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level (rows, child, distance): where rows that stand at ``nodes`` go, to the nearest child each time."""
        rows = np.arange(len(vectors))
        while True:
            inner = self.kids[nodes] > 0
            rows, nodes = rows[inner], nodes[inner]
            if not len(rows):
                return
            order = np.argsort(nodes, kind="stable")
            rows, nodes = rows[order], nodes[order]
            child, dist = np.empty(len(rows), "int64"), np.empty(len(rows))
            cuts = np.flatnonzero(np.diff(nodes, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:]):
                start, n = self.first[nodes[a]], self.kids[nodes[a]]
                d = distances(vectors[rows[a:b]], self.pivots[start:start + n], self.codes)
                child[a:b], dist[a:b] = start + d.argmin(axis=1), d.min(axis=1)
            yield rows, child, dist
            nodes = child

    def cells(self, node: int) -> np.ndarray:
        """All cells below a node, or the node itself."""
        out, todo = [], [node]
        while todo:
            at = todo.pop()
            if self.kids[at]:
                todo += range(self.first[at], self.first[at] + self.kids[at])
            else:
                out.append(at)
        return np.array(out, "int64")

    def homes(self, vectors: np.ndarray, count: np.ndarray, need: int) -> np.ndarray:
        """For each vector the deepest node on its way down that holds ``need`` rows (the root if none does)."""
        at = np.zeros(len(vectors), "int64")
        todo = np.arange(len(vectors))
        while len(todo):
            todo = todo[self.kids[at[todo]] > 0]
            todo = todo[np.argsort(at[todo], kind="stable")]
            cuts = np.flatnonzero(np.diff(at[todo], prepend=-1, append=-1))
            moved = []
            for a, b in zip(cuts, cuts[1:]):
                rows = todo[a:b]
                start, n = self.first[at[rows[0]]], self.kids[at[rows[0]]]
                full = np.flatnonzero(count[start:start + n] >= need)
                if len(full):
                    at[rows] = start + full[distances(vectors[rows], self.pivots[start + full], self.codes).argmin(axis=1)]
                    moved.append(rows)
            todo = np.concatenate(moved) if moved else todo[:0]
        return at

    def within(self, vectors: np.ndarray, reach: np.ndarray, home: np.ndarray, count: np.ndarray, far: np.ndarray, near: np.ndarray):
        """(rows, cell) pairs: all cells outside ``home`` that may hold a row within ``reach`` of the vector.

        A child is left out with all below it if its rows' distances to its pivot
        (``near`` to ``far``) put them out of reach, or the plane between its
        pivot and the nearest sibling's does. Both allow for rounding.
        """
        size = np.sqrt((numbers(vectors, self.codes) ** 2).sum(axis=1))
        scale = 1.0 + np.sqrt((numbers(self.pivots, self.codes) ** 2).sum(axis=1)).max()
        todo = [(0, np.flatnonzero(home != 0))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.kids[node]:
                yield rows, node
                continue
            kids = np.arange(self.first[node], self.first[node] + self.kids[node])
            d = distances(vectors[rows], self.pivots[kids], self.codes)
            own = d.argmin(axis=1)
            slack = 1e-6 * (scale + size[rows])[:, None]
            low = np.maximum(d - far[kids], near[kids] - d)
            span = distances(self.pivots[kids], self.pivots[kids], self.codes)[own]
            wide = span > 1e3 * slack
            near_d = d[np.arange(len(d)), own][:, None]
            plane = (d * d - near_d * near_d) / (2 * np.where(wide, span, 1.0))
            low = np.where(wide, np.maximum(low, plane), low)
            slack = slack * (1.0 + np.where(wide, d / np.where(wide, span, 1.0), 0.0))
            visit = (low - slack <= reach[rows][:, None]) & (count[kids] > 0) & (home[rows][:, None] != kids)
            todo += [(kid, rows[visit[:, j]]) for j, kid in enumerate(kids.tolist())]
