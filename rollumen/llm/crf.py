"""A linear-chain conditional random field of two labels over binary features: fitted by maximum likelihood, decoded by Viterbi.

A sequence is a list of feature lists. A label's score at a place is the sum of its features' weights (for label 1; label 0 has none), and
each step adds a weight of the pair of labels. Likelihood and its gradient come from forward and backward sums over all sequences at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """weights of features (an unknown one has 0), steps[a][b] of label a before b, and what a chain that begins with each label has."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    first: tuple[float, float]

    def labels(self, scores: list[float]) -> list[int]:
        """The likeliest labels of a chain whose places have these scores; of equally likely ones the path with zeros at its end."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.steps
        a, b = self.first[0], self.first[1] + scores[0]
        back = []
        for x in scores[1:]:
            from0, from1 = b + s10 > a + s00, b + s11 > a + s01
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + x
        out = [1 if b > a else 0]
        for step in reversed(back):
            out.append(1 if step[out[-1]] else 0)
        return out[::-1]


def _lse(x: np.ndarray) -> np.ndarray:
    """log(exp(x0) + exp(x1)) over the last axis."""
    return np.logaddexp(x[..., 0], x[..., 1])


def likelihood(scores: np.ndarray, there: np.ndarray, labels: np.ndarray, steps: np.ndarray, first: np.ndarray):
    """For padded sequences (rows) of at least one place: the log-likelihood of the labels, each place's probability of label 1, and the expected
    numbers of steps and first labels, minus those seen, as (value, p, steps, first)."""
    n, width = scores.shape
    e = np.zeros((n, width, 2))
    e[:, :, 1] = scores
    ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    ahead[:, 0] = first + e[:, 0]
    for t in range(1, width):
        new = _lse(np.swapaxes(ahead[:, t - 1, :, None] + steps, 1, 2)) + e[:, t]
        ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
    total = _lse(ahead[:, -1])
    for t in range(width - 2, -1, -1):
        new = _lse(steps + (e[:, t + 1] + behind[:, t + 1])[:, None, :])
        behind[:, t] = np.where(there[:, t + 1, None], new, 0.0)
    p = np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], 0)) * there
    both = there[:, 1:]
    joint = np.exp(ahead[:, :-1, :, None] + steps + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
    begin = np.exp(ahead[:, 0] + behind[:, 0] - total[:, None])
    seen_first = np.bincount(labels[:, 0], minlength=2)
    pair = (labels[:, :-1] * 2 + labels[:, 1:])[both]
    seen_steps = np.bincount(pair, minlength=4).reshape(2, 2)
    value = (scores * labels * there).sum() + (steps * seen_steps).sum() + (first * seen_first).sum() - total.sum()
    return value, p, joint.sum(axis=(0, 1)) - seen_steps, begin.sum(axis=0) - seen_first


def fit(sequences: list[list[list[str]]], labels: list[list[int]], least: int = 3, ridge: float = 0.1, rounds: int = 150, rate: float = 0.15) -> Chain:
    """Weights of the features that at least `least` sequences have, by Adam on the penalised likelihood of all sequences; no randomness."""
    pairs = sorted(((s, y) for s, y in zip(sequences, labels) if s), key=lambda x: len(x[0]))
    holders = Counter(f for s, _ in pairs for f in {f for place in s for f in place})
    names = sorted(f for f, n in holders.items() if n >= least)
    at = {f: i for i, f in enumerate(names)}
    lots = []  # sequences of like lengths together, so that padding stays small
    for i in range(0, len(pairs), 256):
        lot = pairs[i : i + 256]
        width = len(lot[-1][0])
        there = np.zeros((len(lot), width), bool)
        y = np.zeros((len(lot), width), int)
        ids, places = [], []
        for k, (s, own) in enumerate(lot):
            there[k, : len(s)], y[k, : len(s)] = True, own
            for t, place in enumerate(s):
                known = [at[f] for f in place if f in at]
                ids += known
                places += [k * width + t] * len(known)
        lots.append((there, y, np.array(ids, int), np.array(places, int)))
    x = np.zeros(len(names) + 6)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        w, steps, first = x[:-6], x[-6:-2].reshape(2, 2), x[-2:]
        g = ridge * x
        for there, y, ids, places in lots:
            scores = np.bincount(places, w[ids], there.size).reshape(there.shape)
            _, p, d_steps, d_first = likelihood(scores, there, y, steps, first)
            off = ((p - y) * there).ravel()
            g[:-6] += np.bincount(ids, off[places], len(names))
            g[-6:-2] += d_steps.ravel()
            g[-2:] += d_first
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    s = x[-6:-2].tolist()
    return Chain({f: float(x[i]) for f, i in at.items()}, ((s[0], s[1]), (s[2], s[3])), (float(x[-2]), float(x[-1])))
