"""Bounds after a centroid was left before its own group was scanned; components whose squares no long holds."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_words_vectors_urls import brute_kmeans
from tracemill.llm import yinyang


def test_bounds_hold_for_a_centroid_that_was_left():
    for seed in range(40):
        r = np.random.default_rng(seed)
        x = np.floor(64 * (r.normal(size=(5, 4))[r.integers(0, 5, 400)] + r.normal(size=(400, 4)))).astype(np.int64)
        c = x[:16].copy()
        group = yinyang.grouped(c, 4)
        state = yinyang.first_state(x, c, group)
        for _ in range(4):
            own = state[0]
            new = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(16)])
            moved, c = np.sqrt(yinyang.squared(new, c)) * (1 + yinyang.SLACK), new
            state = yinyang.next_state(x, *state, c, moved, group)
            d = np.stack([yinyang.squared(x, y) for y in c], axis=1)
            assert (state[0] == d.argmin(1)).all(), seed
            for g in range(state[2].shape[1]):
                others = np.where((group[None, :] == g) & (np.arange(16)[None, :] != state[0][:, None]), np.sqrt(d), np.inf).min(1)
                assert (state[2][:, g] <= others + 1e-6).all(), seed


@pytest.mark.parametrize("most", [1.0, 4e6, 3e9, 5e15])
def test_large_components(spark, most):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(120, 4)))] + [(1000 + i, [most * (i + 1), 0.0, -most, 0.5]) for i in range(4)]
    got = yinyang.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=6, dims=4).collect()
    v = np.array([[int(c * 64 // 1) for c in e] for _, e in rows], dtype=object)
    own, d, c = brute_kmeans([i for i, _ in rows], v, 6, 3)
    held = lambda n: n if n < 1 << 63 else None
    sums = Counter()
    for j, e in zip(own, d, strict=True):
        sums[j] += e
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    want = {i: (own[n], held(d[n]), held(sums[own[n]]), held(sum(d)), sha[own[n]]) for n, (i, _) in enumerate(rows)}
    # A sum of distances of which one is not held isn't held either.
    assert {g.vec_id: tuple(g)[1:] for g in got} == want
