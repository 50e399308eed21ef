"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from partloom.llm import nearest

SHAPE = "vec_id long, embedding array<float>"


def plain(rows, every=20, count=20):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vectors[i] = min(vectors[i], tuple(v)) if i in vectors else tuple(v)
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            near = [(-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(near)[:count]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, dim, seed, scale=None):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) + 2 * draw.normal(size=(12, dim))[draw.integers(0, 12, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * (1 if scale is None else draw.uniform(*scale, size=(n, 1)))).astype(np.float32).tolist()


@pytest.mark.parametrize("n, dim, scale", [(3000, 32, None), (1500, 16, (0.2, 5.0))])
def test_recall_of_brute_force(spark, n, dim, scale):
    rows = list(enumerate(vectors(n, dim, n, scale)))
    x = np.array([v for _, v in rows], np.float64)
    got = found(nearest.nearest(spark.createDataFrame(rows, SHAPE).repartition(4)))
    assert sorted(got) == list(range(0, n, 20))
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in near} & set(np.argsort(-s)[:20].tolist()))
        assert len(near) == 20 and q not in dict(near)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(near, near[1:]))
        assert np.allclose([v for _, v in near], [s[i] for i, _ in near], rtol=0, atol=1e-12)
    assert hits / (20 * len(got)) >= 0.95


def test_equal_vectors_are_all_found(spark):
    one, rest = vectors(1, 8, 1)[0], vectors(90, 8, 2)
    rows = [(i, one) for i in range(0, 200)] + [(200 + i, v) for i, v in enumerate(rest)]
    got, want = found(nearest.nearest(spark.createDataFrame(rows, SHAPE))), plain(rows)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}


def test_odd_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (3, [inf, 1.0]),
            (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 0.0, 0.0]), (120, [1.0])]
    table = spark.createDataFrame(rows, SHAPE).selectExpr("*", "vec_id AS node", "vec_id AS q", "1 AS rank")
    got, want = found(nearest.nearest(table)), plain([r for r in rows])
    assert got == {q: [(i, pytest.approx(s)) for i, s in near] for q, near in want.items() if near}
    assert nearest.nearest(table.limit(0)).count() == 0


def test_graph_finds_true_neighbours(spark):
    rows = list(enumerate(vectors(800, 24, 9)))
    df = spark.createDataFrame(rows, SHAPE).selectExpr("vec_id AS node", "24 AS dim", "embedding AS vector", "1.0D AS largest")
    codes = df.mapInArrow(nearest._encode, "node long, dim int, code binary")
    got = nearest.graph(codes, k=12, reverse=8, tables=2).collect()
    x = np.array([v for _, v in rows])
    near = x @ x.T
    np.fill_diagonal(near, -1)
    true = np.argsort(-near, axis=1)[:, :12]
    assert sum(r["b"] in true[r["a"]] for r in got) >= 0.9 * 12 * 800
