from pyspark.sql import functions as F

from partloom.operators import graph, hashing, rollup, sockets
from partloom.plans import proposals
from partloom.plans.base import Product
from partloom.session import cut

from . import small

PTS = "points array<struct<x:double,y:double,z:double>>"


def make(spark):
    occ = small.occ(spark, [("top1", "sub1", dict(name="sub")), ("sub1", "lid1", dict(name="lid", qty=2)), ("top1", "nut1", dict(name="nut"))])
    rev = small.rev(spark, [("top1", "top", None, None), ("sub1", "sub", None, None), ("lid1", "lid", "lid", 1.0), ("nut1", "nut", "nut", 1.0)])
    shape = spark.createDataFrame([("lid", 10.0, None, 0.0, 0.0, 0.0), ("fat", 40.0, None, 0.0, 0.0, 0.0), ("nut", 1.0, None, 0.0, 0.0, 0.0), ("nut2", 1.5, None, 0.0, 0.0, 0.0), ("wide", 1.0, None, 0.0, 0.0, 0.0)], small.SHAPE)
    for a in "xyz":
        shape = shape.withColumn(f"bbox_{a}min", F.lit(0.0)).withColumn(f"bbox_{a}max", F.lit(1.0)).withColumn(f"bbox_d{a}", F.when(F.col("fingerprint") == "wide", 6.0).otherwise(1.0))
    contract = spark.createDataFrame([("sub1", "c1", "hs", "{}", 30.0, "declared", 1), ("lid1", "c2", "hl", "{}", None, "declared", 1), ("nut1", "c3", "hn", "{}", None, "declared", 1)], small.CONTRACT).select(
        "*", *[F.when(F.col("revision_id") == "nut1", 5.0).alias(f"envelope_d{a}") for a in "xyz"], F.lit(None).cast("string").alias("cg_window"))
    iface = spark.createDataFrame([], f"revision_id string, name string, kind string, hole_count int, hole_radius double, fastener string, fit_class string, radius_tol double, spacing_tol double, nx double, ny double, nz double, {PTS}")
    sock = spark.createDataFrame([("k", "sub1", "lid", "bolt_pattern", "lid", None, None, None, None, None, None, None, 35.0, None, None, None, None, None, None, None, None, None)],
                                 "socket_id string, revision_id string, name string, kind string, fills string, interface_name string, hole_count int, hole_radius double, fastener string, fit_class string, "
                                 f"radius_tol double, spacing_tol double, mass_budget double, power_budget double, thermal_budget double, nx double, ny double, nz double, {PTS}, allow_dx double, allow_dy double, allow_dz double")
    chain = spark.createDataFrame([("k1", "gap", 0.0, 1.0, "worst_case")], "chain_id string, name string, target_low double, target_high double, method string")
    member = spark.createDataFrame([("k1", 1, "nut", 5.0, 0.1, 0.1, 1, 3.0, "normal"), ("k1", 2, "lid", 4.5, 0.1, 0.1, -1, 3.0, "normal")], "chain_id string, seq int, part_id string, nominal double, tol_plus double, tol_minus double, direction int, sigma_span double, distribution string")
    sub = spark.createDataFrame([("fans", "nut", None)], "team_id string, part_id string, interface_name string")
    root = spark.createDataFrame([("top1",)], "root_rev string")
    return Product(part=small.part(spark, ["top", "sub", "lid", "nut"]), rev=rev, occ=occ, shape=shape, contract=contract, interface=iface, socket=sock, chain=chain,
                   member=member, subscription=sub, root=root, live=cut(graph.reachable(root, occ)))


def test_each_commit_is_judged_alone(spark):
    p = make(spark)
    h = cut(hashing.node_hashes(p.rev, p.occ, p.contract))
    roll, at = cut(rollup.rollup(p.occ, p.rev, p.shape, p.contract)), cut(sockets.targets(p.socket, p.occ, p.rev, p.part))
    ask = spark.createDataFrame([("heavy", "lid", "ann", "fat", None), ("quiet", "nut", "bob", "nut2", None), ("loud", "nut", "bob", "nut2", "hn2"), ("same", "nut", "bob", None, None), ("wide", "nut", "bob", "wide", None),
                                 ("long", "nut", "bob", "nut2", None)],
                                "commit_id string, part_id string, author string, new_fingerprint string, new_contract_hash string")
    longer = spark.createDataFrame([("long", "k1", 1, 6.0, 0.1, 0.1)], "commit_id string, chain_id string, seq int, nominal double, tol_plus double, tol_minus double")
    r = proposals.validate(ask, p, h, roll, at, dimensions=longer)
    v = {x.commit_id: x for x in r["verdicts"].collect()}
    assert {k: x.verdict for k, x in v.items()} == {"heavy": "rejected", "quiet": "landed", "loud": "landed", "same": "landed", "wide": "rejected", "long": "rejected"}
    assert v["wide"].failed_stage == "envelope" and v["long"].failed_stage == "chain" and "too high" in v["long"].reason
    assert {x.other_team for x in r["steps"].filter("stage = 'chain'").collect()} == {"team-l, team-n"}
    assert v["heavy"].failed_stage == "budget" and "80.0 g" in v["heavy"].reason
    kinds = {x.commit_id: x.classification for x in r["classifications"].collect()}
    assert kinds == {"heavy": "internal", "quiet": "internal", "loud": "breaking", "same": "no_op", "wide": "internal", "long": "internal"}
    told = {(x.commit_id, x.team_id) for x in r["notifications"].collect()}
    assert told == {("loud", "fans"), ("loud", "team-t"), ("loud", "team-l")}
    base = h.filter("revision_id = 'top1'").first().node_hash
    assert v["same"].new_root == base and v["quiet"].new_root != base != v["loud"].new_root != v["quiet"].new_root
    stages = {x.stage for x in r["steps"].filter("commit_id = 'heavy'").collect()}
    assert "swap" not in stages and "chain" not in stages and {"declaration", "classification", "socket", "budget"} <= stages
    # A full recount of the changed product gives the same root.
    rev2 = p.rev.withColumn("fingerprint", F.when(F.col("revision_id") == "nut1", "nut2").otherwise(F.col("fingerprint")))
    again = hashing.node_hashes(rev2, p.occ, p.contract).filter("revision_id = 'top1'").first().node_hash
    assert v["quiet"].new_root == again
