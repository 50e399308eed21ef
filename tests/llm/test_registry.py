"""What is registered."""

import re

import __spark_entry__ as entry


def test_queries_of_the_package():
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{k}" for k in range(1, 14)] + ["pipeline"])
    assert set(entry.oracle_sql()) <= set(entry.queries())
