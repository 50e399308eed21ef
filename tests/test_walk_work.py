"""Walks move their frontiers, not the edges; chains are looked up for the asked parts only."""

import pytest
from pyspark.sql import functions as F

from partloom.operators import graph, impact

EDGE = "occurrence_id string, parent_rev string, child_rev string, quantity int"


def plans_of(monkeypatch, module):
    """Plans of the tables that ``module`` writes from now on."""
    seen, write = [], module.cut

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(module, "cut", noted)
    return seen


@pytest.mark.parametrize("walk", ["reachable", "containing", "heights", "quantities"])
def test_a_walk_finds_its_edges_in_place(spark, monkeypatch, walk):
    rows = [(f"o{d}{i}{k}", f"n{d}", f"n{d + 1}", k + 1) for d in range(4) for i in range(2) for k in range(2)] + [("x", "n0", None, 1), ("y", None, "n4", 1)]
    occ = spark.createDataFrame(rows, EDGE)
    rev = spark.createDataFrame([(f"n{d}", f"p{d}") for d in range(5)], "revision_id string, part_id string")
    root = spark.createDataFrame([("n0",)], "root_rev string")
    plans = plans_of(monkeypatch, graph)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {"reachable": lambda: graph.reachable(root, occ).filter("revision_id IS NOT NULL").count(), "heights": lambda: graph.heights(rev, occ).agg(F.max("height")).first()[0],
               "containing": lambda: graph.containing(spark.createDataFrame([("p4",)], "part_id string"), occ, rev).filter("revision_id IS NOT NULL").count(),
               "quantities": lambda: graph.quantities(root, occ).filter("revision_id = 'n4'").first().quantity}[walk]()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"reachable": 5, "containing": 4, "heights": 4, "quantities": 6 ** 4}[walk]
    assert len(plans) > 4 and all("Bucketed: true" in p for p in plans[1:])


def test_only_members_of_asked_chains_are_made_distinct(spark, monkeypatch):
    rows = [(i % 7, f"p{i % 5}") for i in range(60)] + [(None, "p1"), (3, None), (3, None)]
    member = spark.createDataFrame(rows, "chain_id int, part_id string")
    asked = spark.createDataFrame([("p1",), ("p1",), (None,), ("zz",)], "part_id string")
    plans = plans_of(monkeypatch, impact)
    got = impact.chain_partners(asked, member)
    want = {(p, c, q) for c, p in rows for d, q in rows if p == "p1" and c is not None and c == d}
    assert sorted(map(str, got.select("source_part", "chain_id", "part_id").collect())) == sorted(
        f"Row(source_part={p!r}, chain_id={c}, part_id={q!r})" for p, c, q in want)
    assert plans[0].index("Aggregate") < plans[0].index("LeftSemi")
