"""The numpy pieces of the sampled chains against plain numpy, and bands that go back many at a time."""

import math

import numpy as np

from partloom.operators import tolerance

from .test_rules import CHAIN, MEMBER


def test_ends_are_the_quantiles_of_all_totals():
    rng = np.random.default_rng(5)
    for n in (1, 2, 17, 500, 20_000):
        for total in (rng.normal(size=n), rng.random(n), np.round(rng.normal(size=n), 1), np.zeros(n), np.sort(rng.normal(size=n)), np.where(np.arange(n) % 16, -9.0, 9.0)):
            assert np.array_equal(tolerance._ends(total), np.quantile(total, tolerance.BAND_PERCENTILES))
    assert np.isnan(tolerance._ends(np.full(20, np.nan))).all()


def test_turned_is_the_cosine_and_sine_of_a_turn():
    part = np.concatenate([(np.arange(100_000) + 0.5) / 100_000, [0.5 / 2**32, 1 - 0.5 / 2**32, 0.25, 0.5, 0.75]])
    cos, sin = tolerance._turned(part)
    assert abs(cos - np.cos(2 * math.pi * part)).max() < 1e-15 and abs(sin - np.sin(2 * math.pi * part)).max() < 1e-15


def test_draws_follow_the_plain_formulas():
    numbers = np.arange(1, 1001, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = tolerance._bits(np.uint64(77), numbers)
        u = (np.concatenate([bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)]).astype(float) + 0.5) / 4294967296.0
        flat, peak, bell = (tolerance._draws(77, d, 3.0, 0.2, 0.05, numbers) for d in ("uniform", "triangular", "normal"))
    assert np.array_equal(flat, 3.0 - 0.2 + 2 * 0.2 * u)
    assert np.array_equal(peak, 3.0 + 0.2 * np.where(u < 0.5, np.sqrt(2 * u) - 1, 1 - np.sqrt(2 * (1 - u))))
    far, turn = 0.05 * np.sqrt(-2 * np.log(u[:1000])), 2 * math.pi * u[1000:]
    assert abs(bell - 3.0 - np.concatenate([far * np.cos(turn), far * np.sin(turn)])).max() < 1e-14


def test_bands_of_many_chains_return_in_few_batches(spark, monkeypatch):
    monkeypatch.setattr(tolerance, "CHAINS_A_BATCH", 7)
    chain = spark.createDataFrame([(f"c{i}", f"c{i}", 9.9, None, "monte_carlo") for i in range(40)], CHAIN)
    member = spark.createDataFrame([(f"c{i}", s, "p", 5.0, 0.1, 0.1, 1, 3.0, "uniform") for i in range(40) for s in (1, 2)], MEMBER)
    got = tolerance.monte_carlo(chain, member, 400).collect()
    assert len({r.chain_id for r in got}) == len(got) == 40 and all(abs(r.mc_mean - 10) < 0.05 and 0 < r.mc_failure_rate < 0.5 for r in got)
    assert [len(x) for x in tolerance._in_batches(iter([(1,)] * 10), ["a"])] == [7, 3]
