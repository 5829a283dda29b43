"""The learners of operators 4 and 6 on tiny input: trees against a plain learner, pools against their formula, and the ordinal fit
against the slope of its likelihood."""

from __future__ import annotations

import numpy as np
import pytest

from rollumen.llm.quality import Ordinal
from rollumen.llm.toxicity import Boosted, isotonic


def cuts_of(c, bins):
    q = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))
    return np.unique(np.append(q, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1]) if (c > 0).any() else []))


def plain_margins(x, y, rounds, depth, rate, bins, l2, least):
    """Each node tries every cut of every feature, sums over its rows, and keeps the first of the best."""
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    at = [float(np.log(p / (1 - p)))] * len(y)
    cuts = [cuts_of(c, bins) for c in x.T]
    for _ in range(rounds):
        prob = [1 / (1 + np.exp(-a)) for a in at]
        g = [q - t for q, t in zip(prob, y)]
        h = [max(q * (1 - q), 1e-6) for q in prob]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best, chosen = 1e-9, None
                gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for j, own in enumerate(cuts):
                    for cut in own:
                        left = [i for i in rows if x[i, j] < cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl < least or ht - hl < least:
                            continue
                        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                        if gain > best + 1e-12:
                            best, chosen = gain, (j, cut)
                j, cut = chosen if chosen else (0, np.inf)
                below += [[i for i in rows if not x[i, j] >= cut], [i for i in rows if x[i, j] >= cut]]
            nodes = below
        for rows in nodes:
            step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + l2)
            for i in rows:
                at[i] += step
    return np.array(at)


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_a_plain_learner(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(60, 3)) * (rng.random((60, 3)) < 0.6), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=60) * 0.3 > 0.2).astype(float)
    options = {"rounds": 4, "depth": 3, "rate": 0.3, "bins": 8, "l2": 1.0, "least": 1.0}
    got = Boosted(**options).fit(x, y)
    assert np.allclose(got.margin(x), plain_margins(x, y, **options))


@pytest.mark.parametrize("seed", range(3))
def test_pools_equal_their_formula(seed):
    rng = np.random.default_rng(seed)
    m, y = np.sort(rng.normal(size=40)), (rng.random(40) < np.linspace(0.1, 0.9, 40)).astype(float)
    means = lambda j, k: y[j : k + 1].mean()
    want = [max(min(means(j, k) for k in range(i, 40)) for j in range(i + 1)) for i in range(40)]
    at, p = isotonic(m, y)
    sizes = np.array([np.isclose(want, v).sum() for v in np.unique(np.round(want, 12))])
    assert np.allclose(p, (np.unique(np.round(want, 12)) * sizes + 0.5 * y.mean()) / (sizes + 0.5)) and (np.diff(at) > 0).all()


def log_likelihood(rows, at, value, y, w, theta):
    eta = np.bincount(rows, value * w[at], len(y))
    tails = np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(theta - eta[:, None])), np.zeros((len(y), 1))], 1)
    i = np.arange(len(y))
    return np.log(tails[i, y] - tails[i, y + 1]).mean()


@pytest.mark.parametrize("grades", [2, 4])
def test_ordinal_fit_ends_where_its_likelihood_is_flat(grades):
    rng = np.random.default_rng(grades)
    n, used = 400, 3
    dense = rng.random((n, used))
    y = np.clip(np.round((dense @ [2.0, -1.0, 0.5] + rng.logistic(size=n) * 0.8 + 0.5)), 0, grades - 1).astype(int)
    rows, at, value = np.repeat(np.arange(n), used), np.tile(np.arange(used), n), dense.ravel()
    got = Ordinal(list(range(grades))).fit(rows, at, value, y, steps=6000, l2=0.0)
    base = log_likelihood(rows, at, value, y, got.w, got.theta)
    for k in range(used):
        for step in (1e-4, -1e-4):
            moved = got.w.copy()
            moved[k] += step
            assert abs(log_likelihood(rows, at, value, y, moved, got.theta) - base) / 1e-4 < 2e-3
    for k in range(grades - 1):
        moved = got.theta.copy()
        moved[k] += 1e-4
        assert abs(log_likelihood(rows, at, value, y, got.w, moved) - base) / 1e-4 < 2e-3
    assert (np.diff(got.theta) > 0).all()
    start = Ordinal(list(range(grades))).fit(rows, at, value, y, steps=1, l2=0.0)
    assert base > log_likelihood(rows, at, value, y, start.w, start.theta)
