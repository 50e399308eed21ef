"""Tables derived from line items: numbered and shuffled once, whoever reads them."""

import pytest

from verification.fixtures import Fixtures

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, " \
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string"


@pytest.fixture
def fx(spark, tmp_path):
    rows = [(1, 5, 7, 1, 2.0, 9.0, 0.1, 0.2, "R", "F"), (1, 6, 32, 2, 3.0, 9.0, 0.1, 0.2, "N", "O"), (1, 6, 32, 2, 3.0, 8.0, 0.1, 0.2, "N", "O"),
            (2, 5, 32, 1, 4.0, 9.0, 0.1, 0.2, "A", "F"), (2, 5, 7, None, 4.0, 9.0, 0.1, 0.2, "A", "F"), (2, None, None, 3, 4.0, 9.0, 0.1, 0.2, "A", "F"),
            (3, 5, 7, 2, 4.0, 9.0, 0.1, 0.2, "A", "F")]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    return Fixtures(spark, str(tmp_path))


def test_line_items_are_numbered_once(fx):
    assert set(fx.dimension.inputFiles()) == set(fx.validation.inputFiles())
    assert sorted((r.chain_id, r.seq, r.part_id) for r in fx.dimension.filter("part_id IS NOT NULL").collect()) == [
        (1, 1, 5), (1, 2, 6), (1, 3, 6), (2, 1, 5), (2, 2, 5), (3, 1, 5)]
    assert sorted((r.commit_id, r.validation_id, r.stage, r.passed) for r in fx.validation.collect()) == [
        (1, 1, "concurrency", 0), (1, 2, "declaration", 1), (1, 3, "declaration", 1),
        (2, 1, "chain", 1), (2, 2, "concurrency", 1), (2, 3, "classification", 1), (3, 1, "declaration", 1)]


def test_subscriptions_are_made_distinct_by_numbers(fx):
    plan = fx.subscription._jdf.queryExecution().optimizedPlan().toString()
    keys = plan[plan.index("Aggregate ["):].split("]")[0]
    assert "team_id" not in keys and "interface_name" not in keys
    found = [tuple(r) for r in fx.subscription.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {("Brand#8", 5, "foot"), ("Brand#8", 6, "face"), ("Brand#8", 5, "face"), (None, None, None)}
