"""Where one small point pattern can be laid on another: numpy helpers for Arrow batches.

A rigid motion is fixed by where it takes two points, seen from the centroid. So a pattern's
two anchors (its farthest point, and the point that spans the widest triangle with it) are
laid on every pair of the other pattern that fits them about as well as the best pair
does, or within what the tolerance lets points be off. A ring of n holes has some 2 n such motions, an
irregular pattern few; each names a correspondence, by nearest points or by assignment,
and correspondences are refined by least squares until they stay. Of up to ``ALL`` points every
correspondence is tried.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np

ALL = 6  # points of which all correspondences are tried: 720
TOLERANCE = 0.2  # how far points may be off, if a caller doesn't say
ASSIGNED = 64  # motions without a whole correspondence that get one by assignment
SLACK = 0.05  # of the pattern's size: how much worse than the best pair an anchor pair may fit
_FLAT = 1e-9
_CELLS = 1 << 21  # distances held at once


def _frames(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Right-handed frames (k, 3, 3), columns along ``a`` and towards ``b`` from it. Where
    they leave a direction open, any one is taken."""
    first = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    first[np.linalg.norm(a, axis=1) < 1e-12] = (1.0, 0.0, 0.0)
    side = b - (b * first).sum(1, keepdims=True) * first
    open_ = np.linalg.norm(side, axis=1) <= 1e-9 * np.maximum(np.linalg.norm(b, axis=1), 1e-300)
    if open_.any():
        unit = np.eye(3)[np.abs(first[open_]).argmin(1)]
        side[open_] = unit - (unit * first[open_]).sum(1, keepdims=True) * first[open_]
    second = side / np.linalg.norm(side, axis=1, keepdims=True)
    return np.stack([first, second, np.cross(first, second)], axis=2)


def motions(p: np.ndarray, q: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Turns (k, 3, 3), mirror images included, that lay centred ``p`` on centred ``q`` by its anchors. Three
    distances are compared, each of which two points that are off by ``tolerance`` change by twice as much."""
    reach = np.linalg.norm(p, axis=1)
    one = int(reach.argmax())
    two = int(np.linalg.norm(np.cross(p, p[one]), axis=1).argmax())
    if two == one:
        two = int(np.linalg.norm(p - p[one], axis=1).argmax())
    far = np.linalg.norm(q, axis=1)
    apart = np.linalg.norm(q[:, None] - q[None], axis=2)
    misfit = np.abs(far - reach[one])[:, None] + np.abs(far - reach[two])[None] + np.abs(apart - np.linalg.norm(p[one] - p[two]))
    misfit[np.diag_indices(len(q))] = np.inf
    i, j = np.nonzero(misfit <= misfit.min() + max(SLACK * reach[one], 6 * tolerance, _FLAT))
    own = _frames(p[[one]], p[[two]])[0]
    there = _frames(q[i], q[j])
    return np.concatenate([there @ own.T, (there * np.array([1.0, 1.0, -1.0])) @ own.T])


def nearest(placed: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stacks (k, n, 3): each point's nearest target, its distance, and whether no target is taken twice."""
    order = []
    step = max(_CELLS // max(placed.shape[1] ** 2, 1), 1)
    for at in range(0, len(placed), step):
        own, t = placed[at:at + step], target[at:at + step] if target.ndim == 3 else target[None]
        order.append(((t**2).sum(2)[:, None] - 2 * own @ np.swapaxes(t, 1, 2)).argmin(2))
    order = np.concatenate(order)
    taken = np.take_along_axis(target, order[:, :, None], 1) if target.ndim == 3 else target[order]
    return order, np.linalg.norm(placed - taken, axis=2), (np.sort(order, axis=1) == np.arange(order.shape[1])).all(1)


def residuals(p: np.ndarray, q: np.ndarray, mirror: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Root mean square left over by the best proper turn of centred ``p`` onto each centred ``q`` of a
    stack (``mirror``: or mirror image), and whether a mirror image would fit better. A flat pattern can
    turn over, so it is never mirrored."""
    left, size, right = np.linalg.svd(np.swapaxes(q, 1, 2) @ p)
    turned = np.linalg.det(left @ right) < 0
    if not mirror:
        left[:, :, 2] *= np.where(turned, -1.0, 1.0)[:, None]
    rest = q - p @ np.swapaxes(left @ right, 1, 2)
    return np.sqrt((rest**2).sum((1, 2)) / len(p)), turned & (size[:, 2] > _FLAT * np.maximum(size[:, 0], 1e-300))


def both_residuals(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root mean squares left over by the best proper turn of centred ``p`` onto each centred ``q`` of a
    stack, and by the best turn or mirror image, from one decomposition."""
    left, _, right = np.linalg.svd(np.swapaxes(q, -1, -2) @ p)
    turned = np.linalg.det(left @ right) < 0
    free = _left_over(p, q, left @ right)
    left[..., 2] *= np.where(turned, -1.0, 1.0)[..., None]
    return np.where(turned, _left_over(p, q, left @ right), free), free


def _left_over(p: np.ndarray, q: np.ndarray, turn: np.ndarray) -> np.ndarray:
    rest = q - p @ np.swapaxes(turn, -1, -2)
    return np.sqrt((rest**2).sum((-1, -2)) / p.shape[-2])


@lru_cache(maxsize=ALL)
def _orders(n: int) -> np.ndarray:
    return np.array(list(permutations(range(n))), int).reshape(-1, n)


def _refined(p: np.ndarray, q: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Correspondences, each fitted and named anew by nearest points until it stays."""
    done = []
    for _ in range(8):
        left, _, right = np.linalg.svd(np.swapaxes(q[order], 1, 2) @ p)
        after, _, whole = nearest(p @ np.swapaxes(left @ right, 1, 2), q)
        moved = whole & (after != order).any(1)
        done.append(order)
        if not moved.any():
            break
        order = np.unique(after[moved], axis=0)
    return np.unique(np.concatenate(done), axis=0)


def register(p: np.ndarray, q: np.ndarray, tolerance: float = TOLERANCE) -> tuple[float, bool]:
    """Least residual of laying ``p`` on the equally large ``q`` by a proper turn, and whether a mirror image fits better."""
    if len(p) <= ALL:
        proper, mirrored = register_small(p[None], q[None])
        return float(proper[0]), bool(mirrored[0])
    p, q = p - p.mean(0), q - q.mean(0)
    placed = np.swapaxes(motions(p, q, tolerance) @ p.T, 1, 2)
    order, apart, whole = nearest(placed, q)
    rest = np.flatnonzero(~whole)
    rest = rest[np.argsort((apart[rest]**2).sum(1), kind="stable")[:ASSIGNED if whole.any() else 4 * ASSIGNED]]
    # where two points are nearest to one, the motion's correspondence is the least assignment
    own = [assign(np.linalg.norm(placed[k][:, None] - q[None], axis=2)) for k in rest if not whole.any() or (apart[k]**2).sum() < 4 * (apart[whole]**2).sum(1).min() + len(p) * tolerance**2]
    order = _refined(p, q, np.unique(np.concatenate([order[whole], np.array(own, int).reshape(-1, len(p))]), axis=0))
    proper, free = (r.min() for r in both_residuals(p, q[order]))
    return float(proper), bool(free < proper - 1e-9)


def register_small(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`register` for stacks (k, n, 3) of patterns of up to ``ALL`` points: every correspondence of many pairs at once."""
    k, n = p.shape[:2]
    if n == 1:
        return np.zeros(k), np.zeros(k, bool)
    p, q, order = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True), _orders(n)
    proper, free = np.empty(k), np.empty(k)
    step = max(_CELLS // (order.size * 24), 1)
    for at in range(0, k, step):
        each = both_residuals(p[at:at + step, None], q[at:at + step][:, order])
        proper[at:at + step], free[at:at + step] = (r.min(1) for r in each)
    return proper, free < proper - 1e-9


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost, by an auction: unassigned
    rows bid for their best column as much as it is better than their second best."""
    n = len(cost)
    price, owner, column = np.zeros(n), np.full(n, -1), np.full(n, -1)
    scale = max(float(cost.max()), _FLAT)
    for step in scale * np.array([1e-2, 1e-5, 1e-9]) / n:  # within n steps of the least cost
        owner[:], column[:] = -1, -1
        while (free := np.flatnonzero(column < 0)).size:
            worth = -cost[free] - price
            best = worth.argmax(1)
            top = worth[np.arange(len(free)), best]
            worth[np.arange(len(free)), best] = -np.inf
            bid = price[best] + top - (worth.max(1) if n > 1 else top) + step
            for c in np.unique(best):
                who = np.flatnonzero(best == c)
                won = free[who[bid[who].argmax()]]
                if owner[c] >= 0:
                    column[owner[c]] = -1
                owner[c], column[won], price[c] = won, c, bid[who].max()
    return column


def worst_misses(placed: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For stacks (k, n, 3): the largest distance between assigned points. Where every point
    is nearest to another target, that is the assignment."""
    _, apart, whole = nearest(placed, target)
    out = apart.max(1)
    for k in np.flatnonzero(~whole):
        d = np.linalg.norm(placed[k][:, None] - target[k][None], axis=2)
        out[k] = d[np.arange(len(d)), assign(d)].max()
    return out


def compare(mine: list, placed: list, theirs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rmsd, mirrored, worst miss) of rows of flat point lists; nan, False and nan without
    equal point sets. Rows of one size go together, equal pairs of patterns once."""
    rmsd, mirrored, miss = np.full(len(mine), np.nan), np.zeros(len(mine), bool), np.full(len(mine), np.nan)
    sizes = np.array([0 if a is None or c is None or len(a) != len(c) else len(a) // 3 for a, c in zip(mine, theirs)], int)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        p, w, q = (np.array([np.asarray(x[r], float) for r in rows]).reshape(len(rows), n, 3) for x in (mine, placed, theirs))
        pairs, back = np.unique(np.concatenate([p, q], axis=1).reshape(len(rows), -1), axis=0, return_inverse=True)
        pairs = pairs.reshape(len(pairs), 2 * n, 3)
        found = register_small(pairs[:, :n], pairs[:, n:]) if n <= ALL else np.array([register(x[:n], x[n:]) for x in pairs]).T
        rmsd[rows], mirrored[rows] = found[0][back.ravel()], found[1][back.ravel()].astype(bool)
        miss[rows] = worst_misses(w, q)
    return rmsd, mirrored, miss
