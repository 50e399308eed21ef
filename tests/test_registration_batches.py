"""Small patterns are registered in batches, not pair by pair."""

import numpy as np

from partloom.functions import registration


def test_a_batch_of_small_patterns_is_decomposed_at_once(monkeypatch):
    draw = np.random.default_rng(4)
    mine = [draw.uniform(-20, 20, (4, 3)) for _ in range(300)]
    theirs = [p[draw.permutation(4)] + draw.normal(size=3) if k % 3 else p * [1, 1, -1] for k, p in enumerate(mine)]
    calls, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **k: calls.append(1) or svd(*a, **k))
    flat = lambda rows: [list(p.ravel()) for p in rows]
    rmsd, mirrored, _ = registration.compare(flat(mine), flat(mine), flat(theirs))
    assert len(calls) < 10  # two for every pair before
    assert (rmsd[np.arange(300) % 3 > 0] < 1e-9).all() and not mirrored[np.arange(300) % 3 > 0].any()
    assert mirrored[::3].all() and (rmsd[::3] > 1e-3).all()


def test_batches_equal_single_pairs():
    draw = np.random.default_rng(5)
    for n in range(1, 7):
        p = draw.uniform(-30, 30, (25, n, 3))
        p[::2, :, 2] = 0
        q = p[:, draw.permutation(n)] + draw.uniform(-0.2, 0.2, p.shape)
        proper, mirrored = registration.register_small(p, q)
        for k in range(25):
            orders = registration._orders(n)
            a, b = p[k] - p[k].mean(0), q[k] - q[k].mean(0)
            least = [registration.residuals(a, b[orders], mirror)[0].min() if n > 1 else 0.0 for mirror in (False, True)]
            assert abs(proper[k] - least[0]) < 1e-9 and mirrored[k] == (least[1] < least[0] - 1e-9)
