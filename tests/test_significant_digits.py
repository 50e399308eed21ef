"""The registered query of significant digits keeps the rows that lie half-way."""

import math

from verification import checks

SMALL = "/root/testdata/sf0.001"


def test_ties_are_in_the_query_and_round_half_even(spark):
    got = checks.QUERIES["f06_significant_digits"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    ties = 0
    for r in got:
        price = r["l_extendedprice"]
        scaled = price * 10.0 ** (2 - math.floor(math.log10(price)))
        ties += scaled % 1 == 0.5
        assert r["lead3"] == round(scaled) and r["lead"] == round(price * 10.0 ** (8 - math.floor(math.log10(price))))
    assert ties
