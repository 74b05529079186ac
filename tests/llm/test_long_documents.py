"""Messages between the repeats of a token in long documents."""

from __future__ import annotations

import time

import numpy as np
import pytest

from ordinate.llm import pii


def field(odds, bias):
    """Two kinds (0 and 1) as good as alone; repeats prefer agreement by the bias."""
    f = pii.Field()
    f.bias = np.array([0.0, np.log(odds), -40, -40, -40])
    f.skip = np.where(np.eye(5) > 0, bias, 0.0)
    return f


def exact(f, n, fixed):
    """Marginals on a path of n tokens, forwards and backwards."""
    node = np.broadcast_to(f.bias, (n, 5)).copy()
    for i, k in enumerate(fixed):
        if k >= 0:
            node[i] = -20
            node[i, k] = 20
    p, pot = np.exp(node - node.max(axis=1, keepdims=True)), np.exp(f.skip)
    a, b = np.ones((n, 5)), np.ones((n, 5))
    for i in range(1, n):
        a[i] = (a[i - 1] * p[i - 1]) @ pot
        a[i] /= a[i].sum()
        b[n - 1 - i] = pot @ (b[n - i] * p[n - i])
        b[n - 1 - i] /= b[n - 1 - i].sum()
    out = a * b * p
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("odds, bias", [(0.1, 1.9), (0.11, 1.9), (0.5, 2.5), (0.9, 3.0)])
@pytest.mark.parametrize("n", [40, 600])
def test_beliefs_reach_every_repeat(n, odds, bias):
    f = field(odds, bias)
    fixed = np.full(n, -1)
    fixed[0] = 1
    skip = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
    got = f.beliefs(np.zeros((n, 1), np.int64), np.zeros((0, 2), np.int64), skip, fixed)
    assert np.abs(got - exact(f, n, fixed)).max() < 0.01


def test_beliefs_come_to_rest_on_loops():
    rng = np.random.default_rng(0)
    n = 3000
    f = pii.Field()
    f.chain, f.skip = rng.normal(size=(5, 5)) * 3, -3 * np.eye(5)
    f.weights = rng.normal(size=f.weights.shape)
    edges = rng.integers(0, n, size=(6000, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    began = time.time()
    got = f.beliefs(rng.integers(0, pii.FEATURES, size=(n, 8)), edges[:3000], edges[3000:], np.full(n, -1))
    assert np.allclose(got.sum(axis=1), 1) and time.time() - began < 60
