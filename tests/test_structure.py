import random

import pytest
from pyspark.sql import functions as F

from partloom.functions.ranking import rank_within
from partloom.operators import diff, graph, hashing, rollup

from . import small


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def chain_of_three(spark):
    return small.occ(spark, [("a1", "b1"), ("b1", "c1")])


def test_cycles_are_found_and_a_diamond_is_fine(spark):
    occ = chain_of_three(spark)
    ask = spark.createDataFrame([("1", "c1", "a1"), ("2", "b1", "a1"), ("3", "a1", "a1"), ("4", "a1", "c1")], "edge_id string, parent_rev string, child_rev string")
    assert pairs(graph.cycle_test(ask, occ), "edge_id", "closes_cycle") == [("1", True), ("2", True), ("3", True), ("4", False)]
    assert graph.is_acyclic(occ.unionByName(small.occ(spark, [("a1", "c1")])))
    assert pairs(graph.cyclic_nodes(occ.unionByName(small.occ(spark, [("c1", "b1"), ("x1", "a1")]))), "revision_id") == [("b1",), ("c1",)]


def test_rollup_equals_bom_and_counts_power_once(spark):
    occ = small.occ(spark, [("top1", "sub1", dict(qty=2, m03=10.0)), ("sub1", "motor1", dict(qty=3)), ("top1", "motor1", dict(m13=5.0)), ("sub1", "foam1", {})])
    rev = small.rev(spark, [("top1", "top", None, None), ("sub1", "sub", None, None), ("motor1", "motor", "m", 0.5), ("foam1", "foam", "f", None)])
    shape = spark.createDataFrame([("m", 9.0, 10.0, 1.0, 0.0, 0.0), ("f", 4.0, None, 0.0, 0.0, 0.0)], small.SHAPE)
    contract = small.contract(spark, [("motor1", "h", '{"power_w": 750}'), ("sub1", "h", '{"power_w": 2250}'), ("foam1", "h", "not json")])
    root = spark.createDataFrame([("top1",)], "root_rev string")
    part = small.part(spark, ["top", "sub", "motor", "foam"])
    roll = {r.revision_id: r for r in rollup.rollup(occ, rev, shape, contract).collect()}
    bom = rollup.bill_of_materials(root, occ, rev, part, shape)
    assert {r.part_number: r.total_qty for r in bom.collect()} == {"MOTOR": 7, "FOAM": 2}
    assert roll["top1"].mass_g == sum(r.total_mass_g or 0 for r in bom.collect()) == 35.0
    assert roll["top1"].power_w == 7 * 750 and roll["sub1"].power_w == 2250
    assert abs(roll["top1"].cg_x - (6 * 11 + 1) / 7) < 1e-12 and abs(roll["top1"].cg_y - 5 / 7) < 1e-12
    assert pairs(rollup.without_density(root, occ, rev, part, shape, contract), "part_number") == [("FOAM",)]


def chain(spark, n, extra=()):
    """A chain of n edges r00 > r01 > ..., two pieces at every 30th, and further edges."""
    names = [f"r{k:02d}" for k in range(n + 1)]
    return small.occ(spark, [(a, b, dict(qty=2 if k % 30 == 0 else 1)) for k, (a, b) in enumerate(zip(names, names[1:]))] + list(extra))


def test_walks_have_no_depth_limit(spark):
    root = spark.createDataFrame([("r00",)], "root_rev string")
    assert {r.revision_id: r.quantity for r in graph.quantities(root, chain(spark, 66)).collect()}["r66"] == 8


def test_walks_into_a_cycle_raise(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOOK_AT", 4)
    occ = chain(spark, 3, [("r03", "r01", {})])
    root = spark.createDataFrame([("r00",)], "root_rev string")
    with pytest.raises(graph.CycleFound):
        graph.quantities(root, occ)
    assert graph.reachable(root, occ).count() == 4
    ask = spark.createDataFrame([("1", "r03", "r00"), ("2", "r00", "r03"), ("3", "r03", "zz")], "edge_id string, parent_rev string, child_rev string")
    assert pairs(graph.cycle_test(ask, chain(spark, 3)), "edge_id", "closes_cycle") == [("1", True), ("2", False), ("3", False)]


def test_cyclic_nodes_are_those_on_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("x", "a"), ("f", "z"), ("s", "s"), ("d", "s"), ("m", "n")]
    ring = [(f"k{k}", f"k{(k + 1) % 6}") for k in range(6)]
    got = graph.cyclic_nodes(small.occ(spark, edges + ring))
    assert {r.revision_id for r in got.collect()} == set("abcefs") | {a for a, _ in ring}
    assert not graph.is_acyclic(small.occ(spark, edges)) and graph.is_acyclic(small.occ(spark, [("a", "b"), ("a", "c"), ("b", "c")]))


def build(spark, leaf="thin", moved=0.0, shuffle=False):
    """GEAR holds COVER holds LID and forty bolts."""
    rows = [("gear1", "cover1", {}), ("cover1", "lid1", {})] + [("gear1", "bolt1", dict(name="bolt", m03=float(i) + (moved if i == 39 else 0.0))) for i in range(40)]
    if shuffle:
        random.Random(7).shuffle(rows)
    rev = small.rev(spark, [("gear1", "gear", None, None), ("cover1", "cover", None, None), ("lid1", "lid", leaf, 1.0), ("bolt1", "bolt", "bolt", 1.0)])
    return small.occ(spark, rows), rev


def test_hashes_ignore_order_and_move_only_with_content(spark):
    none = spark.createDataFrame([], small.CONTRACT)
    h = lambda **k: {r.revision_id: r.node_hash for r in hashing.node_hashes(*reversed(build(spark, **k)), none).collect()}
    base = h()
    assert h(shuffle=True) == base
    thick = h(leaf="thick")
    assert {k for k in base if base[k] != thick[k]} == {"gear1", "cover1", "lid1"}
    assert {k for k, v in h(moved=2.0).items() if v != base[k]} == {"gear1"}
    two = build(spark)[0].repartition(7)
    assert {r.revision_id: r.node_hash for r in hashing.node_hashes(build(spark)[1], two, none).collect()} == base


def reference_diff(tree, a, b, path, place=True):
    """Plain recursive walk over (hash, attrs, fingerprint, part, children) nodes."""
    x, y = tree[a], tree[b]
    if x["h"] == y["h"]:
        return [] if place else [(path, "moved")]
    if not x["kids"] or not y["kids"]:
        return [(path, "changed")]
    out, left, right, met = [], sorted(x["kids"], key=lambda k: (k["sort"], k["id"])), sorted(y["kids"], key=lambda k: (k["sort"], k["id"])), []
    for key in (lambda k: (tree[k["rev"]]["h"], k["pose"], k["qty"]), lambda k: (tree[k["rev"]]["part"], k["pose"]),
                lambda k: (tree[k["rev"]]["part"], k["name"]), lambda k: tree[k["rev"]]["part"]):
        rest = []
        for k in left:
            hit = next((r for r in right if key(r) == key(k)), None)
            if hit is None:
                rest.append(k)
            else:
                right.remove(hit)
                met.append((k, hit))
        left = rest
    label = lambda k: k["name"] or tree[k["rev"]]["part"].upper()
    for k, r in met:
        same = k["pose"] == r["pose"] and k["qty"] == r["qty"]
        if not (same and tree[k["rev"]]["h"] == tree[r["rev"]]["h"]):
            out += reference_diff(tree, k["rev"], r["rev"], f"{path}/{label(r)}", same)
    out += [(f"{path}/{label(k)}", "removed") for k in left] + [(f"{path}/{label(k)}", "added") for k in right]
    return out + ([(path, "changed")] if x["attrs"] != y["attrs"] else [])


def random_product(spark, seed):
    """Two revisions of a random three-level product."""
    rng = random.Random(seed)
    revs, rows, hashes = [], [], []
    for v in "12":
        for p in range(6):
            revs.append((f"leaf{p}_{v}", f"leaf{p}", rng.choice(["f", "g"]) + str(p), 1.0))
        for p in range(3):
            revs.append((f"sub{p}_{v}", f"sub{p}", None, None))
        revs.append((f"top_{v}", "top", None, None))
        for p in range(3):
            for _ in range(rng.randint(1, 8)):
                rows.append((f"sub{p}_{v}", f"leaf{rng.randrange(6)}_{rng.choice('12')}", dict(name=rng.choice(["", "n1", "n2"]), qty=rng.randint(1, 2), m03=float(rng.randrange(3)))))
        for _ in range(rng.randint(2, 6)):
            rows.append((f"top_{v}", f"sub{rng.randrange(3)}_{v}", dict(name=rng.choice(["", "x"]), m03=float(rng.randrange(2)))))
    return small.rev(spark, revs), small.occ(spark, rows), small.part(spark, sorted({r[1] for r in revs}))


def test_diff_equals_a_recursive_walk(spark):
    for seed in (1, 5):
        rev, occ, part = random_product(spark, seed)
        contract = spark.createDataFrame([], small.CONTRACT)
        h = hashing.node_hashes(rev, occ, contract)
        tree = {r.revision_id: dict(h=r.node_hash, attrs=r.attrs, part=r.part_id, kids=[]) for r in h.join(rev, "revision_id").collect()}
        for o in occ.collect():
            tree[o.parent_rev]["kids"].append(dict(rev=o.child_rev, name=o.instance_name, pose=o.transform_key, qty=o.quantity, sort=o.sort_key, id=o.occurrence_id))
        ask = spark.createDataFrame([("p", "top_1", "top_2"), ("same", "top_1", "top_1")], "pair_id string, left_rev string, right_rev string")
        got = diff.diff_configurations(ask, occ, rev, part, h)
        assert sorted(pairs(got, "pair_id", "path", "kind")) == sorted(("p", *d) for d in reference_diff(tree, "top_1", "top_2", "TOP"))


def test_ranking_a_hot_group_in_pieces(spark):
    df = spark.range(5000).selectExpr("id % 3 = 0 AS k", "hash(id) AS v", "id")
    whole = rank_within(df, ["k"], ["v", "id"], split=False)
    parts = rank_within(df, ["k"], ["v", "id"], split=True)
    assert whole.exceptAll(parts.select(*whole.columns)).isEmpty() and parts.count() == 5000


def test_changes_of_hash_and_rollup_equal_a_full_recount(spark):
    rev, occ, part = random_product(spark, 9)
    contract = spark.createDataFrame([], small.CONTRACT)
    shape = spark.createDataFrame([(f"{k}{p}", 5.0 + p, None, 1.0, 2.0, 3.0) for k in "fgx" for p in range(6)], small.SHAPE)
    h, hh = hashing.node_hashes(rev, occ, contract), graph.heights(rev, occ)
    new = rev.withColumn("fingerprint", F.when(F.col("revision_id").isin("leaf2_1", "leaf4_2"), F.concat(F.lit("x"), F.substring("fingerprint", 2, 9))).otherwise(F.col("fingerprint")))
    full = hashing.node_hashes(new, occ, contract)
    changed = full.filter(F.col("revision_id").isin("leaf2_1", "leaf4_2")).select(F.lit("c").alias("commit_id"), "revision_id", F.col("node_hash").alias("new_hash"), F.lit(None).cast("string").alias("new_attrs"))
    got = hashing.rehash_changes(changed, occ, rev, contract, h, hh, rev.select("revision_id"))
    moved = full.join(h.select("revision_id", F.col("node_hash").alias("was")), "revision_id").filter("node_hash <> was")
    assert pairs(got, "revision_id", "new_hash") == pairs(moved, "revision_id", "node_hash")


def test_directly_changed_keeps_the_last_difference(spark):
    rows = spark.createDataFrame([("p", "a", "A", "A/x", "moved", ""), ("p", "a", "A", "A/y", "changed", "")], "pair_id string, part_id string, part_number string, path string, kind string, detail string")
    assert pairs(diff.directly_changed(rows), "part_id", "kind") == [("a", "changed")]
