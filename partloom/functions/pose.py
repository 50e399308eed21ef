"""Rigid placements as twelve double columns m00..m23 (row-major 3x4).

Column arithmetic keeps composition inside whole-stage codegen; only the nearest
rotation (an SVD) runs as an Arrow batch in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

COLUMNS = [f"m{r}{c}" for r in range(3) for c in range(4)]

# Placement grids (mm, quaternion units), snap tolerance and targets.
TRANSLATION_GRID = 1e-3
ROTATION_GRID = 1e-5
SNAP_TOLERANCE = 1e-6
SNAP_TARGETS = [0.0, 1.0, -1.0, 0.5, -0.5,
                math.sqrt(2) / 2, -math.sqrt(2) / 2, math.sqrt(3) / 2, -math.sqrt(3) / 2]


def identity(prefix: str = "") -> list[Column]:
    return [F.lit(1.0 if c in ("m00", "m11", "m22") else 0.0).alias(prefix + c) for c in COLUMNS]


def compose(outer: str, inner: str, out: str = "") -> list[Column]:
    """Pose of a child in the outer frame: outer placement times inner placement."""
    cols = []
    for r in range(3):
        for c in range(4):
            term = sum((F.col(f"{outer}m{r}{k}") * F.col(f"{inner}m{k}{c}") for k in range(1, 3)),
                       F.col(f"{outer}m{r}0") * F.col(f"{inner}m0{c}"))
            if c == 3:
                term = term + F.col(f"{outer}m{r}3")
            cols.append(term.alias(f"{out}m{r}{c}"))
    return cols


def invert(prefix: str = "", out: str = "") -> list[Column]:
    """Inverse of a rigid placement: transposed rotation, rotated-back translation."""
    cols = []
    for r in range(3):
        cols += [F.col(f"{prefix}m{c}{r}").alias(f"{out}m{r}{c}") for c in range(3)]
        cols.append((-(F.col(f"{prefix}m0{r}") * F.col(f"{prefix}m03")
                       + F.col(f"{prefix}m1{r}") * F.col(f"{prefix}m13")
                       + F.col(f"{prefix}m2{r}") * F.col(f"{prefix}m23"))).alias(f"{out}m{r}3"))
    return cols


def apply(x: Column, y: Column, z: Column, prefix: str = "", rotate_only: bool = False) -> list[Column]:
    """A point (or, with ``rotate_only``, a direction) carried through the placement."""
    out = []
    for r in range(3):
        v = F.col(f"{prefix}m{r}0") * x + F.col(f"{prefix}m{r}1") * y + F.col(f"{prefix}m{r}2") * z
        out.append(v if rotate_only else v + F.col(f"{prefix}m{r}3"))
    return out


def snap(value: Column, tolerance: float = SNAP_TOLERANCE) -> Column:
    """The nearest familiar value when within the tolerance, else the value itself."""
    out = None
    for t in SNAP_TARGETS:
        hit = F.abs(value - F.lit(t)) <= tolerance
        out = F.when(hit, F.lit(t)) if out is None else out.when(hit, F.lit(t))
    return out.otherwise(value)


_ROTATION = T.StructType([T.StructField(f"r{i}{j}", T.DoubleType()) for i in range(3) for j in range(3)])


@F.pandas_udf(_ROTATION)
def nearest_rotation(r00: pd.Series, r01: pd.Series, r02: pd.Series, r10: pd.Series, r11: pd.Series,
                     r12: pd.Series, r20: pd.Series, r21: pd.Series, r22: pd.Series) -> pd.DataFrame:
    """Nearest proper rotation of each 3x3 matrix, one batched SVD per Arrow batch."""
    m = np.stack([s.to_numpy(float) for s in (r00, r01, r02, r10, r11, r12, r20, r21, r22)], 1).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(m)
    flip = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    u[:, :, 2] *= flip[:, None]
    return pd.DataFrame((u @ vt).reshape(-1, 9), columns=_ROTATION.names)


def quaternion(r: dict[tuple[int, int], Column]) -> list[Column]:
    """Unit quaternion (w, x, y, z), first component beyond 1e-12 made positive."""
    trace = r[0, 0] + r[1, 1] + r[2, 2]

    def big(i: int) -> list[Column]:
        # The largest diagonal entry decides which component is computed by root.
        j, k = (i + 1) % 3, (i + 2) % 3
        s = F.sqrt(1 + r[i, i] - r[j, j] - r[k, k]) * 2
        v = {i: s / 4, j: (r[i, j] + r[j, i]) / s, k: (r[i, k] + r[k, i]) / s}
        return [(r[k, j] - r[j, k]) / s, v[0], v[1], v[2]]

    s0 = F.sqrt(trace + 1) * 2
    whole = [s0 / 4, (r[2, 1] - r[1, 2]) / s0, (r[0, 2] - r[2, 0]) / s0, (r[1, 0] - r[0, 1]) / s0]
    bx, by, bz = big(0), big(1), big(2)
    raw = [F.when(trace > 0, whole[n])
           .when((r[0, 0] > r[1, 1]) & (r[0, 0] > r[2, 2]), bx[n])
           .when(r[1, 1] > r[2, 2], by[n]).otherwise(bz[n]) for n in range(4)]
    return raw


def with_pose_key(df: DataFrame, out: str = "transform_key", prefix: str = "") -> DataFrame:
    """Add the quantised text of the placement: ``t:x|y|z;q:w|x|y|z`` as integers."""
    rot = nearest_rotation(*[snap(F.col(f"{prefix}m{i}{j}")) for i in range(3) for j in range(3)])
    base = df.withColumn("_rot", rot)
    q = quaternion({(i, j): F.col(f"_rot.r{i}{j}") for i in range(3) for j in range(3)})
    for name, c in zip("wxyz", q):
        base = base.withColumn(f"_q{name}", c)
    norm = F.sqrt(sum((F.col(f"_q{n}") ** 2 for n in "xyz"), F.col("_qw") ** 2))
    first = F.coalesce(*[F.when(F.abs(F.col(f"_q{n}") / norm) > 1e-12, F.col(f"_q{n}")) for n in "wxyz"])
    sign = F.when(first < 0, -1.0).otherwise(1.0)
    turn = [F.bround(F.col(f"_q{n}") * sign / norm / F.lit(ROTATION_GRID), 0).cast("bigint") for n in "wxyz"]
    shift = [F.bround(snap(F.col(f"{prefix}m{i}3"), TRANSLATION_GRID) / F.lit(TRANSLATION_GRID), 0).cast("bigint")
             for i in range(3)]
    key = F.concat(F.lit("t:"), F.concat_ws("|", *shift), F.lit(";q:"), F.concat_ws("|", *turn))
    return base.withColumn(out, key).drop("_rot", "_qw", "_qx", "_qy", "_qz")


def placed_box(lo: list[Column], hi: list[Column], prefix: str = "") -> tuple[list[Column], list[Column]]:
    """Axis-aligned bounds of a placed box: moved centre, absolute rotation times half extents."""
    centre = [(a + b) / 2 for a, b in zip(lo, hi)]
    half = [(b - a) / 2 for a, b in zip(lo, hi)]
    mid = apply(*centre, prefix=prefix)
    reach = [sum((F.abs(F.col(f"{prefix}m{r}{k}")) * half[k] for k in range(1, 3)),
                 F.abs(F.col(f"{prefix}m{r}0")) * half[0]) for r in range(3)]
    return [m - h for m, h in zip(mid, reach)], [m + h for m, h in zip(mid, reach)]
