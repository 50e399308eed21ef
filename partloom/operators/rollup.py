"""Totals over a configuration: bill of materials, mass, centre of gravity, power."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import pose
from ..session import bucketed, cut, union_all
from . import graph


def unit_mass(rev: DataFrame, shape: DataFrame) -> DataFrame:
    """Mass of one piece of a revision; null without geometry or density."""
    return rev.join(shape.select("fingerprint", "volume", "volume_exact"), "fingerprint", "left").select(
        "revision_id", (graph.usable_volume() * F.col("density")).alias("unit_mass_g"))


def bill_of_materials(roots: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame, shape: DataFrame) -> DataFrame:
    """Leaf revisions below each root with total quantity and mass (null without density)."""
    total = graph.quantities(roots, occ)
    leaf = (rev.filter("is_assembly = 0").select("revision_id", "part_id", "revision_index", "fingerprint", "density")
            .join(shape.select("fingerprint", "volume", "volume_exact"), "fingerprint", "left")
            .join(part.select("part_id", "part_number", "team_id"), "part_id")
            .withColumn("unit_mass_g", graph.usable_volume() * F.col("density")))
    return total.join(leaf, "revision_id").select(
        "root_rev", "part_number", "team_id", "revision_id", "revision_index",
        F.col("quantity").alias("total_qty"), "unit_mass_g",
        (F.col("quantity") * F.col("unit_mass_g")).alias("total_mass_g"))


def bom_totals(bom: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Total mass and number of parts per root, and the most numerous parts of each root."""
    total = bom.groupBy("root_rev").agg(F.count(F.lit(1)).alias("parts"), F.sum("total_qty").alias("pieces"),
                                        F.coalesce(F.sum("total_mass_g"), F.lit(0.0)).alias("mass_g"))
    w = Window.partitionBy("root_rev").orderBy(F.desc("total_qty"), "part_number", "revision_id")
    top = bom.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return total, top.select("root_rev", "rank", "part_number", "revision_id", "team_id", "total_qty")


_STATE = ["mass", "sx", "sy", "sz", "power", "thermal"]


def leaf_state(rev: DataFrame, shape: DataFrame, contract: DataFrame) -> DataFrame:
    """What one piece of each leaf contributes: mass, mass-weighted centre, power, heat.

    Only leaves with geometry contribute; an assembly's own declaration is a
    summary of what is inside it.
    """
    attr = contract.select(
        "revision_id",
        F.coalesce(F.get_json_object("attributes", "$.power_w").cast("double"), F.lit(0.0)).alias("power"),
        F.coalesce(F.get_json_object("attributes", "$.thermal_w").cast("double"), F.lit(0.0)).alias("thermal"))
    s = shape.select("fingerprint", "volume", "volume_exact", "com_x", "com_y", "com_z")
    mass = F.coalesce(graph.usable_volume() * F.col("density"), F.lit(0.0))
    return (rev.filter("is_assembly = 0 AND fingerprint IS NOT NULL")
            .select("revision_id", "fingerprint", "density", "part_id")
            .join(s, "fingerprint", "left").join(attr, "revision_id", "left")
            .withColumn("mass", mass)
            .select("revision_id", "part_id", "mass", *[(F.col("mass") * F.coalesce(f"com_{a}", F.lit(0.0))).alias(f"s{a}") for a in "xyz"],
                    F.coalesce("power", F.lit(0.0)).alias("power"), F.coalesce("thermal", F.lit(0.0)).alias("thermal"),
                    (graph.usable_volume().isNull() | F.col("density").isNull()).alias("massless")))


def rollup(occ: DataFrame, rev: DataFrame, shape: DataFrame, contract: DataFrame) -> DataFrame:
    """Mass, power, heat and centre of gravity of every revision's subtree, in its own frame.

    Bottom-up and linear: each step carries the totals one edge up, summed per
    parent before the next step, so a step holds one row per node however many
    paths lead to it, and no height bookkeeping is needed.
    """
    edges = bucketed(occ.select("parent_rev", "child_rev", F.col("quantity").cast("double").alias("q"), *pose.COLUMNS), "child_rev")
    level = cut(leaf_state(rev, shape, contract).select("revision_id", *_STATE))
    levels = [level]
    for depth in count(1):
        turned = [sum((F.col(f"m{r}{k}") * F.col(f"s{'xyz'[k]}") for k in range(1, 3)),
                      F.col(f"m{r}0") * F.col("sx")) + F.col("mass") * F.col(f"m{r}3") for r in range(3)]
        moved = level.join(edges, level.revision_id == edges.child_rev).select(
            F.col("parent_rev").alias("revision_id"), (F.col("mass") * F.col("q")).alias("mass"),
            *[(t * F.col("q")).alias(f"s{a}") for t, a in zip(turned, "xyz")],
            (F.col("power") * F.col("q")).alias("power"), (F.col("thermal") * F.col("q")).alias("thermal"))
        level = cut(moved.groupBy("revision_id").agg(*[F.sum(c).alias(c) for c in _STATE]))
        if level.isEmpty():
            break
        graph.must_end(depth, level, occ)
        levels.append(level)
    total = union_all(levels).groupBy("revision_id").agg(*[F.sum(c).alias(c) for c in _STATE])
    cg = [F.when(F.col("mass") > 0, F.col(f"s{a}") / F.col("mass")).alias(f"cg_{a}") for a in "xyz"]
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in _STATE]
    return rev.select("revision_id").join(total, "revision_id", "left").select("revision_id", *zero).select(
        "revision_id", F.col("mass").alias("mass_g"), F.col("power").alias("power_w"),
        F.col("thermal").alias("thermal_w"), *cg)


def rollup_changes(delta: DataFrame, occ: DataFrame, live: DataFrame) -> DataFrame:
    """Carry state changes of replaced revisions up the live configuration, per commit.

    delta(commit_id, revision_id, mass, sx, sy, sz, power, thermal) -> the change of every
    ancestor's totals. Totals are linear, so nothing but the changed paths is walked.
    """
    inside = live.select(F.col("revision_id").alias("parent_rev")).distinct()
    edges = cut(occ.join(inside, "parent_rev", "left_semi").select(
        "parent_rev", "child_rev", F.col("quantity").cast("double").alias("q"), *pose.COLUMNS))
    level = cut(delta.select("commit_id", "revision_id", *_STATE))
    levels = [level]
    for depth in count(1):
        turned = [sum((F.col(f"m{r}{k}") * F.col(f"s{'xyz'[k]}") for k in range(1, 3)),
                      F.col(f"m{r}0") * F.col("sx")) + F.col("mass") * F.col(f"m{r}3") for r in range(3)]
        moved = level.join(edges, level.revision_id == edges.child_rev).select(
            "commit_id", F.col("parent_rev").alias("revision_id"), (F.col("mass") * F.col("q")).alias("mass"),
            *[(t * F.col("q")).alias(f"s{a}") for t, a in zip(turned, "xyz")],
            (F.col("power") * F.col("q")).alias("power"), (F.col("thermal") * F.col("q")).alias("thermal"))
        level = cut(moved.groupBy("commit_id", "revision_id").agg(*[F.sum(c).alias(c) for c in _STATE]))
        if level.isEmpty():
            break
        graph.must_end(depth, level, occ)
        levels.append(level)
    return union_all(levels).groupBy("commit_id", "revision_id").agg(*[F.sum(c).alias(c) for c in _STATE])


def without_density(roots: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame, shape: DataFrame,
                    contract: DataFrame) -> DataFrame:
    """The leaf parts below each root that weigh nothing because no density is known."""
    bare = leaf_state(rev, shape, contract).filter("massless").select("revision_id", "part_id").join(
        part.select("part_id", "part_number"), "part_id")
    return (graph.reachable(roots, occ).join(bare, "revision_id")
            .select("root_rev", "part_number").distinct())
