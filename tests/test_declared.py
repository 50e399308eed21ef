"""Commits that bring bodies: contracts derived from them, and sockets of the parent read off them again."""

import pytest
from pyspark.sql import functions as F

from partloom.operators import contracts, graph, hashing, rollup, sockets
from partloom.plans import declared, overlay, proposals
from partloom.plans.base import Product
from partloom.session import cut

from . import small

PTS = "points array<struct<x:double,y:double,z:double>>"
HOLES = [(10.0, 10.0), (50.0, 10.0), (50.0, 30.0), (10.0, 30.0)]
BODIES = {  # holes and seat height of every body
    "plate": (HOLES, 10.0), "plate_thin": (HOLES, 10.0), "plate_moved": ([(12.0, 10.0), *HOLES[1:]], 10.0), "plate_shifted": ([(x + 2, y) for x, y in HOLES], 10.0),
    "plate_three": (HOLES[:3], 10.0), "plate_wide": ([(x * 1.5, y) for x, y in HOLES], 10.0), "block": (HOLES, 0.0), "block_wide": ([(x * 1.5, y) for x, y in HOLES], 0.0)}
DECL = ("name string, fastener string, fit_class string, radius double, radius_tol double, count int, " + ", ".join(f"{c} double" for c in declared.SELECTOR[6:]))


def selector(name, up):
    return (name, "M6", "clearance", 3.3, 0.3, 4, *[None] * 7, 0.0, 0.0, up, None)


def points(body):
    return [dict(x=x, y=y, z=BODIES[body][1]) for x, y in sorted(BODIES[body][0])]


@pytest.fixture(scope="module")
def case(spark):
    occ = small.occ(spark, [("root1", "top1", dict(name="machine")), ("top1", "base1", dict(name="base")), ("top1", "block1", dict(name="block"))])
    rev = small.rev(spark, [("root1", "root", None, None), ("top1", "top", None, None), ("base1", "base", "plate", 1.0), ("block1", "block", "block", 1.0)])
    shape = spark.createDataFrame([(b, 10.0, None, 0.0, 0.0, 0.0) for b in BODIES], small.SHAPE)
    for a in "xyz":
        shape = shape.withColumn(f"bbox_{a}min", F.lit(0.0)).withColumn(f"bbox_{a}max", F.lit(1.0)).withColumn(f"bbox_d{a}", F.lit(1.0))
    contract = small.contract(spark, [("top1", "ht", "{}"), ("base1", "hb", "{}"), ("block1", "hk", "{}")]).select(
        "*", *[F.lit(None).cast("double").alias(f"envelope_d{a}") for a in "xyz"], F.lit(None).cast("string").alias("cg_window"))
    face = "revision_id string, interface_id string, name string, kind string, hole_count int, hole_radius double, fastener string, fit_class string, radius_tol double, spacing_tol double, nx double, ny double, nz double, " + PTS
    iface = spark.createDataFrame([("base1", "i1", "seat", "bolt_pattern", 4, 3.3, "M6", "clearance", 0.1, 0.1, 0.0, 0.0, 1.0, points("plate")),
                                   ("block1", "i2", "foot", "bolt_pattern", 4, 3.3, "M6", "clearance", 0.1, 0.1, 0.0, 0.0, -1.0, points("block")),
                                   ("base1", "i3", "by_hand", "face", 0, None, None, "clearance", None, None, 0.0, 0.0, 1.0, [])], face)
    sock = spark.createDataFrame([("k", "top1", "mount", "bolt_pattern", "block", "foot", "base", "seat", 4, 3.3, "M6", "clearance", 0.2, 0.2, None, None, None, 0.0, 0.0, 1.0, points("plate"), None, None, None)],
                                 "socket_id string, revision_id string, name string, kind string, fills string, interface_name string, from_instance string, from_interface string, hole_count int, hole_radius double, "
                                 f"fastener string, fit_class string, radius_tol double, spacing_tol double, mass_budget double, power_budget double, thermal_budget double, nx double, ny double, nz double, {PTS}, "
                                 "allow_dx double, allow_dy double, allow_dz double")
    # the block stands on the plate
    occ = occ.withColumn("m23", F.when(F.col("child_rev") == "block1", 10.0).otherwise(F.col("m23")))
    chain = spark.createDataFrame([], "chain_id string, name string, target_low double, target_high double, method string")
    member = spark.createDataFrame([], "chain_id string, seq int, part_id string, nominal double, tol_plus double, tol_minus double, direction int, sigma_span double, distribution string")
    sub = spark.createDataFrame([], "team_id string, part_id string, interface_name string")
    root = spark.createDataFrame([("root1",)], "root_rev string")
    p = Product(part=small.part(spark, ["root", "top", "base", "block"]), rev=rev, occ=occ, shape=shape, contract=contract, interface=iface, socket=sock, chain=chain,
                member=member, subscription=sub, root=root, live=cut(graph.reachable(root, occ)))
    bore = spark.createDataFrame([(b, i, True, 3.3, 0.0, 0.0, 1.0, x, y, 0.0) for b, (holes, _) in BODIES.items() for i, (x, y) in enumerate(holes)],
                                 "fingerprint string, bore_id long, complete boolean, radius double, dx double, dy double, dz double, qx double, qy double, qz double")
    plane = spark.createDataFrame([(b, 2400.0, 0.0, 0.0, s, 0.0, 0.0, z) for b in BODIES for s, z in ((1.0, 10.0), (-1.0, 0.0))],
                                  "fingerprint string, area double, nx double, ny double, nz double, ox double, oy double, oz double")
    selectors = spark.createDataFrame([("base1", *selector("seat", 1.0)), ("block1", *selector("foot", -1.0))], "revision_id string, " + DECL)
    ask = spark.createDataFrame([("thin", "base", "plate_thin"), ("moved", "base", "plate_moved"), ("shifted", "base", "plate_shifted"), ("three", "base", "plate_three"),
                                 ("wide", "base", "plate_wide"), ("both", "base", "plate_wide"), ("both", "block", "block_wide"), ("away", "base", "plate_thin")],
                                "commit_id string, part_id string, new_fingerprint string").withColumn("author", F.lit("ann"))
    brought = spark.createDataFrame([("away", "base", *selector("other", 1.0))], "commit_id string, part_id string, " + DECL)
    return p, ask, bore, plane, selectors, brought


def test_bodies_are_judged_by_what_they_offer(spark, case):
    p, ask, bore, plane, selectors, brought = case
    h, roll = cut(hashing.node_hashes(p.rev, p.occ, p.contract)), cut(rollup.rollup(p.occ, p.rev, p.shape, p.contract))
    at = cut(sockets.targets(p.socket, p.occ, p.rev, p.part))
    r = proposals.validate(ask, p, h, roll, at, bore=bore, plane=plane, selectors=selectors, declarations=brought)
    v = {x.commit_id: x for x in r["verdicts"].collect()}
    assert {k: (x.verdict, x.failed_stage) for k, x in v.items()} == {
        "thin": ("landed", None), "moved": ("rejected", "socket"), "shifted": ("rejected", "socket"), "three": ("rejected", "contract"), "wide": ("rejected", "socket"),
        "both": ("landed", None), "away": ("rejected", "contract")}
    assert v["moved"].reason.endswith("pattern") and "off by 2.00 mm" in v["shifted"].reason and "4 holes are declared, 3" in v["three"].reason
    assert "offers no interface called 'seat'" in v["away"].reason
    blamed = {(x.other_part, x.other_team) for x in r["steps"].filter("stage = 'socket' AND commit_id = 'moved' AND NOT passed").collect()}
    assert blamed == {("BLOCK", "team-b")}
    kinds = {(x.commit_id, x.part_id): x.classification for x in r["classifications"].collect()}
    assert kinds["thin", "base"] == "internal" and kinds["both", "base"] == kinds["both", "block"] == kinds["moved", "base"] == "breaking"


def test_public_faces_and_the_root_equal_a_full_recount(spark, case):
    p, ask, bore, plane, selectors, _ = case
    ask = ask.filter("commit_id IN ('both', 'thin', 'wide')")
    prepared = cut(proposals.prepare(ask, p))
    interfaces, problems = declared.proposed_interfaces(prepared, p, bore, plane, selectors)
    assert problems.isEmpty() and {x.name for x in interfaces.filter("part_id = 'base'").collect()} == {"seat", "by_hand"}
    derived, unread = declared.proposed_sockets(prepared, p, interfaces)
    assert unread.isEmpty() and {(x.commit_id, x.socket_id, round(x.ox, 6)) for x in derived.collect()} == {("thin", "k", 30.0), ("wide", "k", 45.0), ("both", "k", 45.0)}
    faces = declared.proposed_hashes(prepared, p, interfaces, derived)
    got = {(x.commit_id, x.node): x.contract_hash for x in faces.collect()}
    assert set(got) == {("both", "base1"), ("both", "block1"), ("both", "top1"), ("wide", "base1"), ("wide", "top1")}
    # the same product written out whole, its sockets read off once more
    both = prepared.filter("commit_id = 'both'")
    swap = {"base1": "plate_wide", "block1": "block_wide"}
    wide = p.interface.withColumn("points", F.transform("points", lambda q: F.struct((q["x"] * 1.5).alias("x"), q["y"].alias("y"), q["z"].alias("z"))))
    again, _ = contracts.derive_sockets(p.socket, p.occ, p.rev, p.part, wide)
    whole = declared.with_patterns(p.socket, again, ["socket_id"])
    want = {x.revision_id: x.contract_hash for x in contracts.contract_hash(p.contract, wide, whole).collect()}
    assert all(got["both", n] == want[n] for n in ("base1", "block1", "top1"))
    h, roll = cut(hashing.node_hashes(p.rev, p.occ, p.contract)), cut(rollup.rollup(p.occ, p.rev, p.shape, p.contract))
    at = cut(sockets.targets(p.socket, p.occ, p.rev, p.part))
    roots = {x.commit_id: x.new_root for x in proposals.validate(ask, p, h, roll, at, bore=bore, plane=plane, selectors=selectors)["new_roots"].collect()}
    contract = p.contract.withColumn("contract_hash", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n in want for x in (n, want[n])]), F.col("revision_id")), "contract_hash"))
    rev = p.rev.withColumn("fingerprint", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in swap.items() for x in kv]), F.col("revision_id")), "fingerprint"))
    assert roots["both"] == hashing.node_hashes(rev, p.occ, contract).filter("revision_id = 'root1'").first().node_hash
    # what landing would write has the hashes that were promised
    revs, _ = overlay.rebuilt(both, spark.createDataFrame([], "commit_id string, parent string, child string, sign int").select("*", *[F.lit(None).cast(p.occ.schema[c].dataType).alias(c) for c in overlay.EDGE]),
                              cut(overlay.totals(cut(overlay.with_own_state(both, p)), spark.createDataFrame([], "commit_id string, parent string, child string, sign int").select(
                                  "*", *[F.lit(None).cast(p.occ.schema[c].dataType).alias(c) for c in overlay.EDGE]), p, h, roll, faces)), p)
    tables = declared.public_tables(revs, both, p, interfaces, derived)
    written = {x.revision_id: x.contract_hash for x in contracts.contract_hash(tables["contract"], tables["interface"], tables["socket"]).collect()}
    assert {x.old_rev: written[x.new_rev] for x in revs.filter("old_rev <> 'root1'").collect()} == {n: got["both", n] for n in ("base1", "block1", "top1")}
