"""Conflict analysis: every outcome, against the expected one of a small product with two heads."""

from dataclasses import replace

from pyspark.sql import functions as F

from partloom.operators import hashing, impact
from partloom.plans import conflicts
from partloom.session import cut

from . import small
from .test_proposals import make

PARTS = ["top", "sub", "lid", "nut", "bar"]


def history(spark):
    """top1 is the base. Below top2 the lid has another body, and sub2 is new only because of it;
    below top3 the subassembly itself declares another contract."""
    edges = []
    for top, sub, lid in (("top1", "sub1", "lid1"), ("top2", "sub2", "lid2"), ("top3", "sub3", "lid1")):
        edges += [(top, sub, dict(name="sub")), (sub, lid, dict(name="lid", qty=2)), (top, "nut1", dict(name="nut")), (top, "bar1", dict(name="bar"))]
    once = {(a, b): (a, b, c) for a, b, c in edges}
    occ = small.occ(spark, list(once.values()))
    rev = small.rev(spark, [*[(f"top{i}", "top", None, None) for i in (1, 2, 3)], *[(f"sub{i}", "sub", None, None) for i in (1, 2, 3)],
                            ("lid1", "lid", "lid", 1.0), ("lid2", "lid", "fat", 1.0), ("nut1", "nut", "nut", 1.0), ("bar1", "bar", "nut2", 1.0)])
    contract = small.contract(spark, [("sub1", "hs", "{}"), ("sub2", "hs", "{}"), ("sub3", "hs-new", "{}"), ("lid1", "hl", "{}"), ("lid2", "hl", "{}"), ("nut1", "hn", "{}")])
    product = replace(make(spark), part=small.part(spark, PARTS), rev=rev, occ=occ, contract=contract)
    sockets = product.socket
    for i in (2, 3):  # the same socket on the later revisions of the subassembly
        sockets = sockets.unionByName(product.socket.selectExpr(
            f"'k{i}' AS socket_id", f"'sub{i}' AS revision_id", *[f"`{c}`" for c in product.socket.columns if c not in ("socket_id", "revision_id")]))
    return replace(product, socket=sockets)


def test_outcomes_of_every_part_and_head(spark):
    product = history(spark)
    h = cut(hashing.node_hashes(product.rev, product.occ, product.contract))
    merkle = hashing.with_hashes(product.rev, h)
    root = {r["revision_id"]: r["merkle_hash"] for r in merkle.filter("part_id = 'top'").collect()}
    assert len(set(root.values())) == 3
    rows, touched = [], []
    for head in ("top1", "top2", "top3"):
        for p in PARTS:
            rows.append((f"{head} {p}", root["top1"], root[head], head))
            touched.append((f"{head} {p}", p))
    rows += [("lost lid", "no such root", root["top2"], "top2"), ("both", root["top1"], root["top2"], "top2"), ("none", root["top1"], root["top2"], "top2")]
    touched += [("lost lid", "lid"), ("both", "bar"), ("both", "nut")]
    got = {r["commit_id"]: r for r in conflicts.analyse(
        spark.createDataFrame(rows, "commit_id string, base_root string, current_root string, current_rev string"),
        spark.createDataFrame(touched, "commit_id string, part_id string"), product, h, merkle).collect()}
    want = {f"top1 {p}": "same_root" for p in PARTS} | {
        # the lid changed; the nut meets it in a chain; its parents are new only because of it
        "top2 lid": "conflicting_write", "top2 nut": "indirect", "top2 sub": "independent", "top2 top": "independent", "top2 bar": "independent",
        # the subassembly changed; the lid draws on its budget
        "top3 sub": "conflicting_write", "top3 lid": "indirect", "top3 nut": "independent", "top3 top": "independent", "top3 bar": "independent",
        "lost lid": "unknown_base", "both": "indirect", "none": "independent"}
    assert {k: r["outcome"] for k, r in got.items()} == want
    assert all(r["can_rebase"] == (r["outcome"] in ("same_root", "independent")) for r in got.values())
    assert got["top2 lid"]["other_part"] == "LID" and got["top2 lid"]["other_team"] == "team-l" and root["top1"] in got["top2 lid"]["detail"]
    assert "chain 'gap'" in got["top2 nut"]["detail"] and "socket 'lid'" in got["top3 lid"]["detail"] and "no such root" in got["lost lid"]["detail"]


def test_without_commits(spark):
    product = history(spark)
    h = cut(hashing.node_hashes(product.rev, product.occ, product.contract))
    none = conflicts.analyse(spark.createDataFrame([], "commit_id string, base_root string, current_root string, current_rev string"),
                             spark.createDataFrame([], "commit_id string, part_id string"), product, h, hashing.with_hashes(product.rev, h))
    assert none.collect() == []


def test_a_closure_of_asked_rows_is_that_part_of_the_whole(spark):
    product = history(spark)
    chain = spark.createDataFrame([("c1", "gap 1"), ("c2", "gap"), ("c3", None), ("c4", "far")], "chain_id string, name string")
    member = spark.createDataFrame([("c1", "lid"), ("c1", "nut"), ("c2", "lid"), ("c2", "nut"), ("c2", "nut"), ("c3", "lid"), ("c3", "bar"), ("c4", "bar"), (None, "lid")], "chain_id string, part_id string")
    changed = spark.createDataFrame([("a", "lid"), ("b", "sub"), ("a", "lid")], "commit_id string, part_id string")
    closure = lambda *asked: impact.dependency_closure(changed, member, chain, product.socket, product.occ, product.rev, product.subscription, *asked)
    whole = {tuple(r) for r in closure().collect()}
    assert {r[:3] for r in whole} == {("a", "lid", True), ("a", "nut", False), ("a", "bar", False), ("b", "sub", True), ("b", "lid", False)}
    # of the names with their quote the least; a chain without a name is called null
    assert {r[1]: r[3] for r in whole if r[0] == "a" and not r[2]} == {"nut": "meets it in chain 'gap 1'", "bar": "meets it in chain 'null'"}
    asked = spark.createDataFrame([("a", "nut"), ("a", "nut"), ("a", "lid"), ("b", "lid"), ("b", "nut"), ("c", "lid")], "commit_id string, part_id string")
    got = closure(asked)
    assert {tuple(r) for r in got.collect()} == {r for r in whole if r[:2] in {("a", "nut"), ("a", "lid"), ("b", "lid")}} and got.count() == 3


def test_the_closure_is_followed_from_the_parts_that_commits_touch(spark, monkeypatch):
    product, seen, plain = history(spark), [], impact.dependency_closure
    monkeypatch.setattr(impact, "dependency_closure", lambda *a: seen.append(plain(*a)) or seen[0])
    h = cut(hashing.node_hashes(product.rev, product.occ, product.contract))
    root = hashing.with_hashes(product.rev, h).filter("part_id = 'top'")
    hash_of = {r["revision_id"]: r["merkle_hash"] for r in root.collect()}
    conflicts.analyse(spark.createDataFrame([("x", hash_of["top1"], hash_of["top2"], "top2")], "commit_id string, base_root string, current_root string, current_rev string"),
                      spark.createDataFrame([("x", "nut")], "commit_id string, part_id string"), product, h, hashing.with_hashes(product.rev, h)).collect()
    assert seen[0].select(F.col("part_id")).distinct().collect() == [("nut",)]
