"""A generative model of overlapping voters, fitted by expectation-maximisation on counts of vote patterns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ABSTAIN, NO, YES = 0, 1, 2


def pattern_code(votes: list[int]) -> int:
    """A row of votes as one number to the base of three."""
    code = 0
    for v in votes:
        code = 3 * code + v
    return code


def pattern_votes(codes: np.ndarray, voters: int) -> np.ndarray:
    return np.asarray(codes, dtype=np.int64)[:, None] // 3 ** np.arange(voters - 1, -1, -1) % 3


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | class) or P(vote | vote of its parent, class)."""

    prior: np.ndarray  # of no and yes
    parents: list[int]  # -1: none
    tables: np.ndarray  # voter, vote of the parent, vote, class

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        total = np.full(len(votes), np.log(self.prior[1] / self.prior[0]))
        for j, p in enumerate(self.parents):
            t = np.log(self.tables[j])
            given = votes[:, p] if p >= 0 else 0
            total += t[given, votes[:, j], 1] - t[given, votes[:, j], 0]
        return total

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))

    def accuracies(self) -> np.ndarray:
        """P(vote is right | voter votes) of each voter, under its parent's usual votes."""
        t = self.tables.mean(axis=1)
        right = t[:, YES, 1] * self.prior[1] + t[:, NO, 0] * self.prior[0]
        return right / (right + t[:, NO, 1] * self.prior[1] + t[:, YES, 0] * self.prior[0])


def _tree(one_hot: np.ndarray, weights: np.ndarray) -> list[int]:
    """Parents by Chow and Liu: the spanning tree of the highest mutual information given the class."""
    m = one_hot.shape[1]
    info = np.zeros((m, m))
    for w in weights.T:
        joint = np.einsum("p,pia,pjb->ijab", w, one_hot, one_hot) + 1e-9
        total = joint.sum(axis=(2, 3), keepdims=True)
        joint /= total
        a, b = joint.sum(axis=3, keepdims=True), joint.sum(axis=2, keepdims=True)
        info += w.sum() / weights.sum() * (joint * np.log(joint / a / b)).sum(axis=(2, 3))
    parents, inside = [-1] * m, {0}
    while len(inside) < m:
        i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: info[e])
        parents[j] = i if info[i, j] > 1e-4 else -1
        inside.add(j)
    return parents


def fit(votes: np.ndarray, counts: np.ndarray, correlated: bool = False, known: np.ndarray | None = None,
        prior: float = 0.5, rounds: int = 60, belief: float = 8.0,
        weights: tuple[float, float] = (1.0, 1.0)) -> LabelModel:
    """Fit to distinct vote patterns and their counts; ``known`` gives 0, 1 or -1 (unknown) for each pattern.

    The first posterior is the majority of the votes, NO and YES counting by
    ``weights``: where voters look for single kinds of junk, one NO outweighs
    the YES of those that look for others. Each round then estimates
    accuracies (and, if ``correlated``, which voters lean on which) from the
    posterior and the posterior from these. ``belief`` pseudo-rows of each class,
    in which voters are right more often than wrong, and as many split by
    ``prior`` keep few rows from turning the classes round; no patterns leave
    them alone.
    """
    m = votes.shape[1]
    one_hot = np.eye(3)[votes]
    lean = weights[1] * (votes == YES).sum(1) - weights[0] * (votes == NO).sum(1)
    yes = 1 / (1 + np.exp(-(lean + np.log(prior / (1 - prior)))))
    known = np.full(len(votes), -1) if known is None else known
    trust = belief * np.array([[0.5, 0.5], [0.4, 0.1], [0.1, 0.4]])  # vote, class
    for _ in range(rounds):
        yes = np.where(known < 0, yes, known)
        rows = np.stack([counts * (1 - yes), counts * yes], axis=1)
        share = (rows.sum(0) + belief * np.array([1 - prior, prior])) / (rows.sum() + belief)
        parents = _tree(one_hot, rows) if correlated and len(votes) else [-1] * m
        tables = np.empty((m, 3, 3, 2))
        for j, p in enumerate(parents):
            flat = np.einsum("pv,pc->vc", one_hot[:, j], rows) + trust
            flat /= flat.sum(0)
            flat[NO, 1] = min(flat[NO, 1], flat[NO, 0] / 2)  # no voter is taken to be worse than chance
            flat[YES, 0] = min(flat[YES, 0], flat[YES, 1])
            flat /= flat.sum(0)
            if p < 0:
                tables[j] = flat
            else:  # a rare vote of the parent falls back on the voter alone
                joint = np.einsum("pa,pv,pc->avc", one_hot[:, p], one_hot[:, j], rows) + belief * flat
                tables[j] = joint / joint.sum(1, keepdims=True)
        model = LabelModel(share, parents, tables)
        before, yes = yes, model.posterior(votes)
        if np.abs(before - yes).max(initial=0) < 1e-6:
            break
    return model


def fit_linear(index: np.ndarray, value: np.ndarray, row: np.ndarray, target: np.ndarray, size: int,
               penalty: float = 1e-4, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft targets; entries (row, index, value), Adam steps on the whole sample."""
    w, n = np.zeros(size + 1), max(1, len(target))
    index, value, row = (np.concatenate(x) for x in ((index, np.full(len(target), size)), (value, np.ones(len(target))), (row, np.arange(len(target)))))
    index, row = index.astype(np.int64), row.astype(np.int64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1) if len(target) else ():
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[index], n), -30, 30)))
        g = np.bincount(index, value * (p - target)[row], size + 1) / n
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])
