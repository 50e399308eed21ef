"""Proposed structure against a full recount of every commit."""

import pytest
from pyspark.sql import functions as F

from partloom.functions import pose
from partloom.operators import hashing, rollup, sockets
from partloom.plans import overlay, proposals
from partloom.session import cut

from . import small
from .test_proposals import make

CHILD = "commit_id string, part_id string, child_part_id string, instance_name string, quantity int, transform_key string, " + ", ".join(f"{c} double" for c in pose.COLUMNS)


def child(commit, part, of, qty=1, **at):
    m = {**small.EYE, **at}
    return (commit, part, of, "", qty, "t:" + "|".join(str(round(m[c] * 1000)) for c in ("m03", "m13", "m23")), *[float(m[c]) for c in pose.COLUMNS])


@pytest.fixture(scope="module")
def case(spark):
    p = make(spark)
    p.part = p.part.unionByName(small.part(spark, ["pin", "kit"]))
    ask = spark.createDataFrame([("swap", "sub", None, None), ("pin", "top", None, None), ("pin", "pin", "nut2", 3.0), ("kit", "kit", None, None), ("kit", "sub", None, None), ("kit", "lid", "fat", None),
                                 ("none", "sub", None, None), ("body", "lid", "fat", None), ("loop", "sub", None, None), ("self", "sub", None, None), ("lost", "sub", None, None), ("two", "kit", None, None), ("two", "sub", None, None)],
                                "commit_id string, part_id string, new_fingerprint string, new_density double").withColumn("author", F.lit("ann"))
    new = spark.createDataFrame([
        child("swap", "sub", "nut", 3, m03=5.0), child("swap", "sub", "lid", 1, m13=2.0),
        child("pin", "top", "sub"), child("pin", "top", "nut"), child("pin", "top", "pin", 4, m00=0.0, m01=-1.0, m10=1.0, m11=0.0, m23=7.0),
        child("kit", "kit", "lid", 2, m03=1.0), child("kit", "kit", "nut", 1), child("kit", "sub", "kit", 2, m13=-3.0),
        child("none", "sub", None), child("loop", "sub", "top"), child("self", "sub", "sub"), child("lost", "sub", "ghost"), child("lost", "lid", "nut"),
        child("two", "kit", "sub"), child("two", "sub", "kit")], CHILD)
    prepared = proposals.prepare(ask, p).withColumn("is_assembly", F.when(F.col("part_id").isin("kit"), 1).otherwise(F.col("is_assembly")))
    prepared = cut(overlay.with_own_state(prepared, p))
    edges, problems = overlay.proposed_edges(prepared, new, p)
    return p, prepared, cut(edges), problems


def test_cycles_and_problems_are_named(spark, case):
    p, _, edges, problems = case
    got = {(r.commit_id, r.parent, r.child) for r in overlay.cycles(edges, overlay.base_edges(p)).collect()}
    assert got == {("loop", "sub1", "top1"), ("self", "sub1", "sub1"), ("two", "sub1", "two/kit"), ("two", "two/kit", "sub1")}
    assert {(r.commit_id, r.problem.split()[-1]) for r in problems.collect()} == {("lost", "known"), ("lost", "it")}


def test_hashes_totals_and_edges_equal_a_full_recount(spark, case):
    p, prepared, edges, _ = case
    good = ["swap", "pin", "kit", "none", "body"]
    prepared, edges = prepared.filter(F.col("commit_id").isin(good)), edges.filter(F.col("commit_id").isin(good))
    h, roll = cut(hashing.node_hashes(p.rev, p.occ, p.contract)), cut(rollup.rollup(p.occ, p.rev, p.shape, p.contract))
    found = cut(overlay.totals(prepared, edges, p, h, roll))
    revs, occ = overlay.rebuilt(prepared, edges, found, p)
    got = {(r.commit_id, r.node): r for r in found.collect()}
    assert len(got) == found.count() and {c for c, n in got if n == "top1"} == set(good)
    names = {(r.commit_id, r.new_rev): r.old_rev for r in revs.collect()}
    assert len(names) == len(got)
    state = revs.join(p.rev.withColumnRenamed("revision_id", "old_rev"), "old_rev", "left").join(
        prepared.select("new_rev", F.col("fingerprint").alias("_f"), F.col("density").alias("_d"), F.lit(True).alias("_c")), "new_rev", "left").select(
        F.col("new_rev").alias("revision_id"), F.coalesce("part_id", F.substring_index("new_rev", "/", -1)).alias("part_id"), F.lit(2).alias("revision_index"),
        F.when(F.col("_c"), F.col("_f")).otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("_c") & F.col("_f").isNotNull(), 0).otherwise(1).alias("is_assembly"),
        F.when(F.col("_c"), F.col("_d")).otherwise(F.col("density")).alias("density"), F.when(F.col("part_id").isNotNull(), "steel").alias("material"))
    rev = cut(p.rev.select(*state.columns).unionByName(state))
    # new revisions are named by their commit, so one recount holds the products of all commits
    every = cut(p.occ.select("parent_rev", "child_rev", "transform_key", "quantity", *pose.COLUMNS).unionByName(occ.drop("commit_id")))
    contract = cut(p.contract.select("revision_id", "contract_hash", "attributes").unionByName(
        revs.select(F.col("new_rev").alias("revision_id"), "old_rev").join(p.contract.select(F.col("revision_id").alias("old_rev"), "contract_hash", "attributes"), "old_rev").drop("old_rev")))
    again = {r.revision_id: r.node_hash for r in hashing.node_hashes(rev, every, contract).collect()}
    weigh = {r.revision_id: r for r in rollup.rollup(every, rev, p.shape, contract).collect()}
    for (c, new), old in names.items():
        assert got[c, old].new_hash == again[new], (c, old)
        assert got[c, old].mass == pytest.approx(weigh[new].mass_g)
        for a in "xyz":
            assert got[c, old]["s" + a] == pytest.approx((weigh[new]["cg_" + a] or 0.0) * weigh[new].mass_g)


def test_validation_of_proposed_structure(spark, case):
    p, _, _, _ = case
    p.contract = p.contract.withColumn("cg_window", F.when(F.col("revision_id") == "sub1", '{"min": [-50, -50, -50], "max": [50, 50, 5]}'))
    h, roll = cut(hashing.node_hashes(p.rev, p.occ, p.contract)), cut(rollup.rollup(p.occ, p.rev, p.shape, p.contract))
    at = cut(sockets.targets(p.socket, p.occ, p.rev, p.part))
    ask = spark.createDataFrame([("light", "sub", None, None, None), ("heavy", "sub", None, None, None), ("tall", "sub", None, None, None), ("tall", "pin", "nut2", 3.0, "hp"), ("bare", "pin", "nut2", 3.0, None), ("loop", "sub", None, None, None)],
                                "commit_id string, part_id string, new_fingerprint string, new_density double, new_contract_hash string").withColumn("author", F.lit("ann"))
    new = spark.createDataFrame([child("light", "sub", "nut", 3), child("heavy", "sub", "lid", 4), child("loop", "sub", "top"),
                                 child("tall", "sub", "pin", 4, m23=80.0)], CHILD)
    r = proposals.validate(ask, p, h, roll, at, children=new)
    v = {x.commit_id: x for x in r["verdicts"].collect()}
    assert {k: (x.verdict, x.failed_stage) for k, x in v.items()} == {
        "light": ("landed", None), "heavy": ("rejected", "budget"), "tall": ("rejected", "budget"), "bare": ("rejected", "declaration"), "loop": ("rejected", "declaration")}
    assert "40.0 g" in v["heavy"].reason and "balance" in v["tall"].reason and "holds it" in v["loop"].reason
    assert v["light"].new_root and v["light"].new_root != h.filter("revision_id = 'top1'").first().node_hash
