"""The toxicity classifier against a plain recount of n-grams, classes, test and descent."""

import math
import zlib

import numpy as np
import pytest

from partloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def plain_features(text):
    """Hashes of all 3 to 5-grams, once each; newlines end nothing inside a text."""
    folded = [c.lower() if c.isalpha() else " " for c in text]
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(folded) - n + 1):
            h = ord(folded[i])
            for c in folded[i + 1:i + n]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            h = ((h ^ (h >> 15)) * 0x9E3779B1 + n) % 2**32
            out.add((h * 0x85EBCA6B) % 2**32 >> (32 - toxicity.BITS))
    return out


@pytest.fixture()
def small(documents, spark, prose):
    rows = [(k, prose(25, k) + (" Snarlfang vexwort" if k % 4 == 0 else "") + "\n!") for k in range(240)]
    labels = [(k, 1, int(k % 4 == 0 and k % 20 != 0)) for k in range(240)]
    return rows, labels, documents(rows), spark.createDataFrame(labels, LABELS)


def test_features_as_counted_plainly(prose):
    texts = [prose(20, 1), "", "ab", "Ab-C\nd", "ÄÖü 12", "x" * 50]
    doc, f = toxicity.once(texts, np.ones(1 << toxicity.BITS, bool))
    for i, t in enumerate(texts):  # beside these there are grams that reach into the gap
        assert plain_features(t) <= set(f[doc == i].tolist())


def test_fit_agrees_with_a_plain_recount(small):
    rows, labels, docs, table = small
    model = toxicity.fit(docs, table)
    known = [(t, y) for (k, t), (_, _, y) in zip(rows, labels, strict=True) if zlib.crc32(str(k).encode()) % 3 != 1]
    doc, f = toxicity.once([t for t, _ in known], np.ones(1 << toxicity.BITS, bool))
    y = np.array([v for _, v in known])
    n1, n = int(y.sum()), len(y)
    n0 = n - n1
    kept = {}
    for x in np.unique(f):
        held = doc[f == x]
        p = int(y[held].sum())
        q = len(held) - p
        if p + q < 3:
            continue
        cells = [(p, n1 * (p + q)), (q, n0 * (p + q)), (n1 - p, n1 * (n - p - q)), (n0 - q, n0 * (n - p - q))]
        g = 2 * sum(o * math.log(o * n / e) for o, e in cells if o)
        if math.sqrt(max(g, 0.0)) >= 4.0:
            kept[int(x)] = math.log((p + 1) / (n1 + 2)) - math.log((q + 1) / (n0 + 2))
    assert sorted(kept) == model.feature.tolist() and len(kept) > 20
    # the same descent over one dense table
    place = {x: i for i, x in enumerate(model.feature.tolist())}
    inputs = np.zeros((n, len(place) + 1))
    inputs[:, -1] = 1
    for d, x in zip(doc, f, strict=True):
        if int(x) in place:
            inputs[d, place[int(x)]] = kept[int(x)]
    w = toxicity.descend(lambda w: inputs.T @ (1 / (1 + np.exp(-inputs @ w)) - y) / n + 1e-4 * np.append(w[:-1], 0), len(place) + 1)
    assert np.allclose(model.weight, w[:-1] * inputs.max(0, initial=0)[:-1] + w[:-1] * inputs.min(0, initial=0)[:-1], atol=1e-4)
    assert abs(model.intercept - w[-1]) < 1e-4


def test_more_features_than_a_thousand(documents, spark, prose):
    """Every feature that passes the test is kept: there is no width."""
    bad = [prose(150, 7).replace(" ", "q") + "zz"] * 60
    rows = [(k, bad[k % 60] if k % 2 else prose(20, k)) for k in range(120)]
    model = toxicity.fit(documents(rows), spark.createDataFrame([(k, 1, k % 2) for k in range(120)], LABELS))
    assert len(model.feature) > 1024 and model.scores([bad[0]])[0] > 0.9 and model.scores([prose(20, 999)])[0] < 0.1


def test_split_of_rows_changes_nothing(small, spark):
    _, _, docs, table = small
    a, b = toxicity.fit(docs, table), toxicity.fit(docs.repartition(7, "text"), table)
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.weight, b.weight) and a.intercept == b.intercept
