"""Content hashes of whole configurations, every revision at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import digest
from ..session import cut, union_all
from . import graph


def node_hashes(rev: DataFrame, occ: DataFrame, contract: DataFrame) -> DataFrame:
    """(revision_id, node_hash, attrs, is_leaf) of every revision's subtree.

    Level by level from the leaves. When a level is hashed, its edges to parents of
    any height are joined once and added into one row per parent, so each edge is
    read in exactly one step, and a step holds rows per parent, never child lists.
    """
    h = cut(graph.heights(rev, occ))
    base = rev.select("revision_id", "fingerprint", "material", "density").join(
        contract.select("revision_id", "contract_hash"), "revision_id", "left").withColumn(
        "attrs", digest.attributes(F.col("contract_hash"), F.col("material"), F.col("density"))).select(
        "revision_id", "fingerprint", "attrs")
    base = cut(base.join(h, "revision_id"))
    top = base.agg(F.max("height")).first()[0] or 0
    heights = h.select(F.col("revision_id").alias("parent_rev"), F.col("height").alias("parent_height"))
    edges = cut(occ.select("parent_rev", "child_rev", "transform_key", "quantity").join(heights, "parent_rev")
                .join(h.select(F.col("revision_id").alias("child_rev"), F.col("height").alias("child_height")), "child_rev"))

    level = cut(base.filter("height = 0").select(
        "revision_id", F.when(F.col("fingerprint").isNull(), digest.empty(F.col("revision_id"), F.col("attrs")))
        .otherwise(digest.leaf(F.col("fingerprint"), F.col("attrs"))).alias("node_hash"), "attrs", F.lit(True).alias("is_leaf")))
    done, carried = [level], []
    for k in range(1, top + 1):
        entry = edges.filter(F.col("child_height") == k - 1).join(
            level.select(F.col("revision_id").alias("child_rev"), "node_hash"), "child_rev").select(
            "parent_rev", "parent_height",
            *digest.child_lanes(F.col("node_hash"), F.col("transform_key"), F.col("quantity")))
        carried.append(cut(entry.groupBy("parent_rev", "parent_height").agg(
            F.count(F.lit(1)).alias("children"), *digest.sum_lanes())))
        ready = union_all([c.filter(F.col("parent_height") == k) for c in carried]).groupBy("parent_rev").agg(
            F.sum("children").alias("children"), *digest.sum_lanes())
        level = cut(base.filter(F.col("height") == k).join(ready, base.revision_id == ready.parent_rev).select(
            "revision_id", digest.node(F.col("attrs")).alias("node_hash"), "attrs", F.lit(False).alias("is_leaf")))
        done.append(level)
    return union_all(done)


def rehash_changes(changed: DataFrame, occ: DataFrame, rev: DataFrame, contract: DataFrame, hashes: DataFrame,
                   height: DataFrame, live: DataFrame) -> DataFrame:
    """Hashes above replaced revisions, for many commits at once, each on its own.

    changed(commit_id, revision_id, new_hash, new_attrs) names replaced revisions by their
    old id: a leaf by its new hash, an assembly (null hash) by its new attributes.
    Returns (commit_id, revision_id, new_hash) for them and for every ancestor in the
    live configuration. Child sums are additive, so an ancestor's sum is corrected by
    the entries that changed; its other children, however many, are not read again.
    """
    base = rev.select("revision_id", "material", "density").join(contract.select("revision_id", "contract_hash"), "revision_id", "left").select(
        "revision_id", digest.attributes(F.col("contract_hash"), F.col("material"), F.col("density")).alias("attrs"))
    h = hashes.select(F.col("revision_id").alias("child_rev"), F.col("node_hash").alias("old_hash"))
    inside = live.select(F.col("revision_id").alias("parent_rev")).distinct()
    edges = cut(occ.select("parent_rev", "child_rev", "transform_key", "quantity").join(inside, "parent_rev", "left_semi")
                .join(h, "child_rev").join(height.select(F.col("revision_id").alias("parent_rev"), F.col("height").alias("parent_height")), "parent_rev"))
    start = cut(changed.select("commit_id", "revision_id", "new_hash", "new_attrs").join(height, "revision_id"))
    # Which ancestors are touched at all, so that their old sums are computed once.
    touched = cut(start.select("commit_id", "revision_id").distinct())
    up = touched
    while True:
        nxt = (up.join(edges.select("parent_rev", "child_rev").distinct(), up.revision_id == edges.child_rev)
               .select("commit_id", F.col("parent_rev").alias("revision_id")).distinct())
        up = cut(nxt.join(touched, ["commit_id", "revision_id"], "left_anti"))
        if up.isEmpty():
            break
        touched = touched.unionByName(up)
    ancestors = touched.select(F.col("revision_id").alias("parent_rev")).distinct()
    old = cut(edges.join(ancestors, "parent_rev", "left_semi").select(
        "parent_rev", *digest.child_lanes(F.col("old_hash"), F.col("transform_key"), F.col("quantity")))
        .groupBy("parent_rev").agg(F.count(F.lit(1)).alias("children"), *digest.sum_lanes()))
    top = touched.join(height, "revision_id").agg(F.max("height")).first()[0] or 0
    own = start.filter("new_hash IS NULL").select("commit_id", F.col("revision_id").alias("parent_rev"), F.col("height").alias("parent_height"),
                                                  *[F.lit(0).cast("decimal(38,0)").alias(c) for c in digest.LANES])
    own_attrs = start.filter("new_hash IS NULL").select("commit_id", F.col("revision_id").alias("parent_rev"), "new_attrs")
    leaf = start.filter("new_hash IS NOT NULL")
    known, moved = [leaf.select("commit_id", "revision_id", "new_hash")], [own]
    for k in range(0, top + 1):
        level = [leaf.filter(F.col("height") == k).select("commit_id", "revision_id", "new_hash")]
        if k > 0:
            delta = union_all([m.filter(F.col("parent_height") == k) for m in moved]).groupBy("commit_id", "parent_rev").agg(*digest.sum_lanes())
            now = delta.select("commit_id", "parent_rev", *[F.col(c).alias(f"d_{c}") for c in digest.LANES]).join(old, "parent_rev").join(
                own_attrs, ["commit_id", "parent_rev"], "left")
            for c in digest.LANES:
                now = now.withColumn(c, (F.col(c) + F.col(f"d_{c}")).cast("decimal(38,0)"))
            new = cut(now.join(base.withColumnRenamed("revision_id", "parent_rev"), "parent_rev").select(
                "commit_id", F.col("parent_rev").alias("revision_id"), digest.node(F.coalesce("new_attrs", "attrs")).alias("new_hash")))
            known.append(new)
            level.append(new)
        step = union_all(level).withColumnRenamed("revision_id", "child_rev").join(edges, "child_rev")
        before = digest.child_lanes(F.col("old_hash"), F.col("transform_key"), F.col("quantity"))
        after = digest.child_lanes(F.col("new_hash"), F.col("transform_key"), F.col("quantity"))
        moved.append(cut(step.select("commit_id", "parent_rev", "parent_height", *[
            (a.cast("decimal(38,0)") - b.cast("decimal(38,0)")).cast("decimal(38,0)").alias(c) for a, b, c in zip(after, before, digest.LANES)])
            .groupBy("commit_id", "parent_rev", "parent_height").agg(*digest.sum_lanes())))
    return union_all(known)


def with_hashes(rev: DataFrame, hashes: DataFrame) -> DataFrame:
    """Revisions carrying their subtree hash."""
    kept = [c for c in rev.columns if c != "merkle_hash"]
    return rev.select(*kept).join(
        hashes.select("revision_id", F.col("node_hash").alias("merkle_hash")), "revision_id", "left")


def hashed_tree(roots: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame, shape: DataFrame,
                hashes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Flat rows of the hashed tree below each root (path, hash, part, quantity along the path, team)."""
    tree = graph.explode_structure(roots, occ, rev, part, shape, max_depth)
    return tree.join(hashes.select("revision_id", "node_hash"), "revision_id").join(
        rev.select("revision_id", "fingerprint"), "revision_id")


def occurrences_of(tree: DataFrame, part_number: str) -> DataFrame:
    """Every place a part sits in a hashed tree."""
    return tree.filter(F.col("part_number") == part_number)
