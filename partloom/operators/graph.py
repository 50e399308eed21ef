"""Walks over the occurrence DAG (one row per edge), for all roots at once.

A walk is a loop over frontiers. Each step is one equi-join of the frontier with
the edge table plus, where the answer allows it, an aggregation that keeps the
frontier as small as the number of nodes rather than the number of paths. Edges are
written once, in buckets of the end that frontiers meet, so that a step moves its frontier only.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pose
from ..session import bucketed, cut, union_all

LOOK_AT = 64  # depth from which a walk that is still going is tested for cycles


class CycleFound(RuntimeError):
    """A walk goes round a cycle and would never end."""


def must_end(depth: int, frontier: DataFrame, occ: DataFrame) -> None:
    """Raise if a walk over ``occ`` can't end. Walks have no depth limit; at depths 64, 128,
    256 and so on the frontier is tested for nodes on a cycle, on which an endless walk always has one."""
    if depth >= LOOK_AT and depth & (depth - 1) == 0:
        if not frontier.join(cyclic_nodes(occ), "revision_id", "left_semi").isEmpty():
            raise CycleFound(f"the graph has a cycle (seen at depth {depth})")


def _labelled_edges(occ: DataFrame, rev: DataFrame, part: DataFrame, extra: list[str]) -> DataFrame:
    """Edges with the display label of the child: instance name, else part number."""
    number = rev.select("revision_id", "part_id").join(
        part.select("part_id", "part_number"), "part_id")
    return occ.join(number.select(F.col("revision_id").alias("child_rev"), "part_number"), "child_rev").select(
        "parent_rev", "child_rev", "instance_name", "quantity",
        F.when(F.coalesce("instance_name", F.lit("")) != "", F.col("instance_name"))
        .otherwise(F.col("part_number")).alias("label"), *extra)


def _root_rows(roots: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    return (roots.select("root_rev").distinct()
            .join(rev.select(F.col("revision_id").alias("root_rev"), "part_id"), "root_rev")
            .join(part.select("part_id", "part_number"), "part_id"))


def explode_structure(roots: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame,
                      shape: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every appearance below each root: depth, path, quantity product, unit mass.

    Paths multiply in a DAG, so this is for answers that need the path; totals
    come from :func:`quantities`, whose frontier is one row per node. ``max_depth``
    limits the tree where the caller asks for it.
    """
    edges = bucketed(_labelled_edges(occ, rev, part, []), "parent_rev")
    level = cut(_root_rows(roots, rev, part).select(
        "root_rev", F.col("root_rev").alias("revision_id"), F.lit(0).alias("depth"),
        F.col("part_number").alias("path"), F.lit(1).cast("bigint").alias("quantity")))
    levels = [level]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        level = cut(level.withColumnRenamed("quantity", "q").join(
            edges, level.revision_id == edges.parent_rev).select(
            "root_rev", F.col("child_rev").alias("revision_id"), (F.col("depth") + 1).alias("depth"),
            F.concat_ws("/", "path", "label").alias("path"),
            (F.col("q") * F.col("quantity")).cast("bigint").alias("quantity")))
        if level.isEmpty():
            break
        must_end(depth, level, occ)
        levels.append(level)
    attrs = (rev.select("revision_id", "part_id", "revision_index", "is_assembly", "fingerprint", "density")
             .join(part.select("part_id", "part_number", "team_id"), "part_id")
             .join(shape.select("fingerprint", "volume", "volume_exact"), "fingerprint", "left")
             .select("revision_id", "revision_index", "is_assembly", "part_number", "team_id",
                     (F.coalesce("volume_exact", "volume") * F.col("density")).alias("mass_g")))
    return union_all(levels).join(attrs, "revision_id")


def quantities(roots: DataFrame, occ: DataFrame) -> DataFrame:
    """Total quantity of every revision below each root: (root_rev, revision_id, quantity)."""
    edges = bucketed(occ.select("parent_rev", "child_rev", F.col("quantity").cast("bigint").alias("q")), "parent_rev")
    level = cut(roots.select("root_rev").distinct().select(
        "root_rev", F.col("root_rev").alias("revision_id"), F.lit(1).cast("bigint").alias("quantity")))
    levels = [level]
    for depth in count(1):
        level = cut(level.join(edges, level.revision_id == edges.parent_rev)
                    .groupBy("root_rev", F.col("child_rev").alias("revision_id"))
                    .agg(F.sum(F.col("quantity") * F.col("q")).alias("quantity")))
        if level.isEmpty():
            break
        must_end(depth, level, occ)
        levels.append(level)
    return union_all(levels).groupBy("root_rev", "revision_id").agg(F.sum("quantity").alias("quantity"))


def configuration(roots: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    """Placed instances below each root, pose composed into the root's frame.

    ``rel_path`` is the path below the root without the root's own label.
    """
    edges = bucketed(_labelled_edges(occ, rev, part, [F.col(c).alias(f"e_{c}") for c in pose.COLUMNS])
                     .withColumnRenamed("instance_name", "edge_name").withColumnRenamed("quantity", "edge_qty"), "parent_rev")
    level = cut(_root_rows(roots, rev, part).select(
        "root_rev", F.col("root_rev").alias("revision_id"), F.lit(0).alias("depth"),
        F.col("part_number").alias("path"), F.lit("").alias("rel_path"),
        F.lit(1).cast("bigint").alias("quantity"),
        F.lit(None).cast(occ.schema["parent_rev"].dataType).alias("parent_rev"),
        F.lit("").alias("instance_name"), *pose.identity()))
    levels = [level]
    for depth in count(1):
        up = level.drop("parent_rev", "instance_name")
        level = cut(up.join(edges, up.revision_id == edges.parent_rev).select(
            "root_rev", F.col("child_rev").alias("revision_id"), (F.col("depth") + 1).alias("depth"),
            F.concat_ws("/", "path", "label").alias("path"),
            F.when(F.col("rel_path") == "", F.col("label"))
            .otherwise(F.concat_ws("/", "rel_path", "label")).alias("rel_path"),
            (F.col("quantity") * F.col("edge_qty")).cast("bigint").alias("quantity"),
            F.col("parent_rev"), F.coalesce("edge_name", F.lit("")).alias("instance_name"),
            *pose.compose("", "e_")))
        if level.isEmpty():
            break
        must_end(depth, level, occ)
        levels.append(level)
    meta = rev.select("revision_id", "part_id", "is_assembly", "fingerprint").join(
        part.select("part_id", "part_number", "team_id"), "part_id")
    return union_all(levels).join(meta, "revision_id")


def reachable(roots: DataFrame, occ: DataFrame) -> DataFrame:
    """Distinct (root_rev, revision_id) of every configuration, the root included. Ends on
    any graph, as a pair is walked from once."""
    edges = bucketed(occ.select("parent_rev", "child_rev").distinct(), "parent_rev")
    level = cut(roots.select("root_rev").distinct().withColumn("revision_id", F.col("root_rev")))
    seen = level
    while True:
        step = (level.join(edges, level.revision_id == edges.parent_rev)
                .select("root_rev", F.col("child_rev").alias("revision_id")).distinct())
        level = cut(step.join(seen, ["root_rev", "revision_id"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def containing(parts: DataFrame, occ: DataFrame, rev: DataFrame) -> DataFrame:
    """Upward walk: (part_id, revision_id, depth) of every revision above any
    revision of a part, at the least depth. Ends on any graph."""
    edges = bucketed(occ.select("parent_rev", "child_rev").distinct(), "child_rev")
    level = cut(parts.select("part_id").distinct().join(rev.select("part_id", "revision_id"), "part_id"))
    seen = None
    for depth in count(1):
        step = (level.join(edges, level.revision_id == edges.child_rev)
                .select("part_id", F.col("parent_rev").alias("revision_id")).distinct())
        if seen is not None:
            step = step.join(seen, ["part_id", "revision_id"], "left_anti")
        level = cut(step)
        if seen is not None and level.isEmpty():
            break
        found = level.withColumn("depth", F.lit(depth))
        seen = found if seen is None else seen.unionByName(found)
    return seen


def where_used(parts: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame,
               live: DataFrame | None = None) -> DataFrame:
    """Every assembly revision that contains a part, at any depth.

    ``live`` (a ``revision_id`` column, e.g. from :func:`reachable`) restricts the
    answer to one configuration; without it every stored revision counts.
    """
    up = containing(parts, occ, rev).withColumnRenamed("part_id", "source_part")
    if live is not None:
        up = up.join(live.select("revision_id").distinct(), "revision_id", "left_semi")
    return (up.join(rev.select("revision_id", "part_id", "revision_index"), "revision_id")
            .join(part.select("part_id", "part_number", "team_id"), "part_id"))


def above(nodes: DataFrame, occ: DataFrame) -> DataFrame:
    """(revision_id): the nodes and everything that contains any of them, as one set."""
    edges = bucketed(occ.select("parent_rev", "child_rev").distinct(), "child_rev")
    level = seen = cut(nodes.select("revision_id").distinct())
    while not level.isEmpty():
        up = level.join(edges, level.revision_id == edges.child_rev).select(F.col("parent_rev").alias("revision_id")).distinct()
        level = cut(up.join(seen, "revision_id", "left_anti"))
        seen = seen.unionByName(level)
    return seen


def cycle_test(proposed: DataFrame, occ: DataFrame) -> DataFrame:
    """For proposed edges (edge_id, parent_rev, child_rev): would each close a cycle?

    A cycle needs a way from the child down to the parent. All of it lies above some
    proposed parent, so only edges between such nodes are walked, not all that lies below.
    """
    asked = proposed.select("edge_id", F.col("parent_rev").alias("goal"), F.col("child_rev").alias("start"))
    up = cut(above(asked.select(F.col("goal").alias("revision_id")), occ))
    between = cut(occ.select("parent_rev", "child_rev").distinct()
                  .join(up.select(F.col("revision_id").alias("parent_rev")), "parent_rev", "left_semi")
                  .join(up.select(F.col("revision_id").alias("child_rev")), "child_rev", "left_semi"))
    starts = asked.select(F.col("start").alias("root_rev")).join(up.select(F.col("revision_id").alias("root_rev")), "root_rev", "left_semi")
    hit = asked.join(reachable(starts, between), (F.col("start") == F.col("root_rev")) & (F.col("goal") == F.col("revision_id")))
    return proposed.join(hit.select("edge_id").withColumn("closes_cycle", F.lit(True)), "edge_id", "left").select(
        "edge_id", "parent_rev", "child_rev", F.coalesce("closes_cycle", F.lit(False)).alias("closes_cycle"))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that lie on a cycle or between cycles, and their number: an edge whose child has no child or
    whose parent has no parent is dropped, round by round, until none is."""
    edges = cut(edges)
    before, left = None, edges.count()
    while left and left != before:
        kept = edges.join(edges.select(F.col("parent_rev").alias("child_rev")).distinct(), "child_rev", "left_semi")
        kept = kept.join(edges.select(F.col("child_rev").alias("parent_rev")).distinct(), "parent_rev", "left_semi")
        edges = cut(kept.select("parent_rev", "child_rev"))
        before, left = left, edges.count()
    return edges, left


def cyclic_nodes(occ: DataFrame) -> DataFrame:
    """Nodes on a cycle of the whole edge set: (revision_id).

    What trimming leaves is coloured: every node takes the least name that reaches it. A
    node that keeps its own name and those of its colour that lead back to it go round in
    circles; they are set aside and the rest is trimmed and coloured again. A step holds
    a row per node or edge, never a row per pair of nodes.
    """
    found = occ.select(F.col("parent_rev").alias("revision_id")).limit(0)
    edges, left = _trimmed(occ.select("parent_rev", "child_rev").distinct())
    while left:
        colour = cut(edges.select(F.col("parent_rev").alias("revision_id")).unionByName(edges.select(F.col("child_rev").alias("revision_id")))
                     .distinct().withColumn("colour", F.col("revision_id")))
        changed = colour
        while not changed.isEmpty():
            offer = changed.join(edges, changed.revision_id == edges.parent_rev).groupBy(F.col("child_rev").alias("revision_id")).agg(F.min("colour").alias("offer"))
            after = cut(colour.join(offer, "revision_id", "left").select(
                "revision_id", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("new")))
            colour, changed = after.select("revision_id", "colour"), after.filter("new").select("revision_id", "colour")
        inside = cut(edges.join(colour.select(F.col("revision_id").alias("parent_rev"), F.col("colour").alias("c")), "parent_rev")
                     .join(colour.select(F.col("revision_id").alias("child_rev"), F.col("colour").alias("d")), "child_rev")
                     .filter("c = d").select("parent_rev", "child_rev", "c"))
        level = rounds = cut(colour.filter("revision_id = colour").select("revision_id"))
        while not level.isEmpty():
            back = level.join(inside, level.revision_id == inside.child_rev).select(F.col("parent_rev").alias("revision_id")).distinct()
            level = cut(back.join(rounds, "revision_id", "left_anti"))
            rounds = rounds.unionByName(level)
        rounds = cut(rounds)
        # a set of one node is a cycle only with an edge to itself
        own = inside.join(rounds.select(F.col("revision_id").alias("parent_rev")), "parent_rev", "left_semi").join(
            rounds.select(F.col("revision_id").alias("child_rev")), "child_rev", "left_semi")
        found = found.unionByName(cut(own.select(F.col("parent_rev").alias("revision_id")).distinct()))
        gone = rounds.select(F.col("revision_id").alias("parent_rev"))
        edges, left = _trimmed(edges.join(gone, "parent_rev", "left_anti").join(gone.withColumnRenamed("parent_rev", "child_rev"), "child_rev", "left_anti"))
    return found


def heights(rev: DataFrame, occ: DataFrame) -> DataFrame:
    """Longest distance to a leaf, per revision: (revision_id, height)."""
    edges = bucketed(occ.select("parent_rev", "child_rev").distinct(), "child_rev")
    level = cut(rev.select("revision_id").join(
        edges.select(F.col("parent_rev").alias("revision_id")), "revision_id", "left_anti"))
    levels = [level.withColumn("height", F.lit(0))]
    for h in count(1):
        level = cut(level.join(edges, level.revision_id == edges.child_rev)
                    .select(F.col("parent_rev").alias("revision_id")).distinct())
        if level.isEmpty():
            break
        must_end(h, level, occ)
        levels.append(level.withColumn("height", F.lit(h)))
    return union_all(levels).groupBy("revision_id").agg(F.max("height").alias("height"))


def is_acyclic(occ: DataFrame) -> bool:
    return not _trimmed(occ.select("parent_rev", "child_rev").distinct())[1]


def usable_volume() -> Column:
    """The modeller's own volume where known, else the mesh volume."""
    return F.coalesce("volume_exact", "volume")
