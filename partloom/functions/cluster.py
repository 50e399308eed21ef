"""First-come grouping by nearness, without pairs and without one task per group.

An item joins the first earlier item that founded a group and lies near it; an item
near no founder founds a group. Walking items one by one would gather each group in
one place; here founders are found in rounds over a grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, union_all

_CELL = 16  # cell width in tolerances: an item rarely touches more than one cell


def _own_cell(group: str, coords: list[tuple[str, float]]) -> Column:
    return F.xxhash64(F.col(group), *[F.floor(F.col(c) / (_CELL * t)) for c, t in coords])


def _touched_cells(df: DataFrame, group: str, coords: list[tuple[str, float]], mirrored: list[str]) -> DataFrame:
    """One row per cell within a tolerance of the item (and of its mirrored direction)."""
    signs = F.array(F.lit(1.0), F.lit(-1.0)) if mirrored else F.array(F.lit(1.0))
    out = df.withColumn("_sign", F.explode(signs))
    names = []
    for i, (c, t) in enumerate(coords):
        x = F.col(c) * F.col("_sign") if c in mirrored else F.col(c)
        cells = F.array_distinct(F.array(F.floor((x - t) / (_CELL * t)), F.floor((x + t) / (_CELL * t))))
        out = out.withColumn(f"_n{i}", F.explode(cells))
        names.append(f"_n{i}")
    return out.withColumn("_cell", F.xxhash64(F.col(group), *names)).drop("_sign", *names)


def leaders(items: DataFrame, group: str, order: str, coords: list[tuple[str, float]],
            near: Callable[[str, str], Column], mirrored: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """Add ``leader``: the ``order`` value of the founder each item belongs to.

    ``coords`` are (column, tolerance) pairs that two near items must agree in;
    ``near(a, b)`` is the exact test over the column prefixes ``a`` and ``b``;
    ``mirrored`` names direction columns whose negative means the same. Items that
    are equal in all values are settled once.
    """
    mirrored = list(mirrored)
    values = [group, *[c for c, _ in coords], *carry]
    distinct = cut(items.groupBy(*values).agg(F.min(order).alias("_o")))
    undecided, founders = distinct, []
    while not undecided.isEmpty():
        least = undecided.select(_own_cell(group, coords).alias("_cell"), "_o").groupBy("_cell").agg(F.min("_o").alias("_least"))
        seen = (_touched_cells(undecided, group, coords, mirrored).join(least, "_cell", "left")
                .groupBy(*values, "_o").agg(F.min("_least").alias("_least")))
        new = cut(seen.filter("_least >= _o").select(*values, "_o"))
        founders.append(new)
        covered = _near_founders(undecided, new, group, coords, near, mirrored, values).select(group, "_o").distinct()
        undecided = cut(undecided.join(covered, [group, "_o"], "left_anti"))
    if not founders:
        return items.withColumn("leader", F.col(order))
    best = _near_founders(distinct, union_all(founders), group, coords, near, mirrored, values).groupBy(group, "_o").agg(
        F.min("_f").alias("leader"))
    named = distinct.join(best, [group, "_o"])
    on = [items[v].eqNullSafe(named[v]) for v in values]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return items.join(named.select(*values, "leader"), cond).select(*[items[c] for c in items.columns], "leader")


def _near_founders(items: DataFrame, founders: DataFrame, group: str, coords, near, mirrored, values) -> DataFrame:
    """(group, _o, _f): founders at or before each item and near it."""
    f = founders.select(_own_cell(group, coords).alias("_cell"), *[F.col(v).alias(f"f_{v}") for v in values], F.col("_o").alias("_f"))
    i = _touched_cells(items, group, coords, mirrored).select("_cell", *[F.col(v).alias(f"i_{v}") for v in values], "_o")
    hit = (F.col(f"f_{group}") == F.col(f"i_{group}")) & (F.col("_f") <= F.col("_o")) & (
        (F.col("_f") == F.col("_o")) | near("f_", "i_"))
    return i.join(f, "_cell").filter(hit).select(F.col(f"i_{group}").alias(group), "_o", "_f").distinct()
