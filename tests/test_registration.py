"""Registration of point patterns against all correspondences."""

import time
from itertools import permutations

import numpy as np
import pytest

from partloom.functions import registration


def least(p, q):
    p, q = p - p.mean(0), q - q.mean(0)
    orders = np.array(list(permutations(range(len(p)))))
    return float(registration.residuals(p, q[orders])[0].min())


def pattern(draw, n, span, flat):
    p = draw.uniform(-span / 2, span / 2, (n, 3))
    p[:, 2] *= 0 if flat else 1
    return p


def moved(draw, p, noise):
    turn = np.linalg.qr(draw.normal(size=(3, 3)))[0]
    turn[:, 0] *= np.sign(np.linalg.det(turn))
    return draw.permutation((p + draw.uniform(-noise, noise, p.shape)) @ turn.T + draw.normal(size=3) * 50)


def test_small_patterns_equal_all_correspondences():
    draw = np.random.default_rng(1)
    for _ in range(2000):
        p = pattern(draw, draw.integers(2, 7), draw.uniform(2, 60), draw.random() < 0.7)
        q = moved(draw, p, draw.uniform(0, 0.2))
        assert registration.register(p, q)[0] == pytest.approx(least(p, q), abs=1e-9)


def test_larger_patterns_equal_all_correspondences():
    draw = np.random.default_rng(2)
    for k in range(60):
        span = draw.uniform(4, 60)
        p = pattern(draw, 7, span, k % 2)
        if k % 3 == 0:  # nearly regular: many motions fit about equally
            a = np.arange(7) * 2 * np.pi / 7
            p = np.stack([span / 2 * np.cos(a), span / 2 * np.sin(a), 0 * a], axis=1) + draw.normal(size=(7, 3)) * [0.05, 0.05, 0]
        q = moved(draw, p, draw.uniform(0, 0.2))
        assert registration.register(p, q)[0] == pytest.approx(least(p, q), abs=1e-9)


def test_a_ring_of_96_is_quick():
    a = np.arange(96) * 2 * np.pi / 96
    ring = np.stack([30 * np.cos(a), 30 * np.sin(a), 0 * a], axis=1)
    draw = np.random.default_rng(3)
    q = moved(draw, ring, 0.05)
    registration.register(ring, q)
    begin = time.perf_counter()
    rmsd, mirrored = registration.register(ring, q)
    assert time.perf_counter() - begin < 0.3 and rmsd < 0.06 and not mirrored
