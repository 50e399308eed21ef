"""Shape figures from triangles: moments, frame, invariants, and the identity hash."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import digest, geometry as g

# Closure and volume limits, degeneracy and skewness limits, and the
# quadrature used for fourth moments (barycentric points and weights).
CLOSED_BELOW = 1e-6
VOLUME_ERROR_ABOVE = 1e-3
DEGENERATE_BELOW = 1e-4
SKEWNESS_BELOW = 5e-3
ROUND_BELOW = 1e-6
ANGLES = 180
RULE = [(-0.8, (0.25, 0.25, 0.25)), (0.45, (1 / 6, 1 / 6, 1 / 6)), (0.45, (0.5, 1 / 6, 1 / 6)),
        (0.45, (1 / 6, 0.5, 1 / 6)), (0.45, (1 / 6, 1 / 6, 0.5))]

_SECOND, _THIRD = g.SECOND, list(g.THIRD)


def _corners(tri: DataFrame, origin: str) -> list[g.Vec]:
    return [[F.col(f"{k}{a}") - F.col(f"{origin}{a}") for a in "xyz"] for k in "abc"]


def surface(tri: DataFrame) -> DataFrame:
    """Per shape: triangle count, mean corner, area, and the closure residual of the mesh."""
    a, b, c = (g.vec(k) for k in "abc")
    n = g.cross(g.minus(b, a), g.minus(c, a))
    s = tri.select("fingerprint", *[((F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3).alias(f"m{x}") for x in "xyz"],
                   *[n[i].alias(f"n{'xyz'[i]}") for i in range(3)])
    agg = s.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("triangles"), *[F.avg(f"m{x}").alias(f"apex_{x}") for x in "xyz"],
        (F.sum(g.norm(g.vec("n"))) / 2).alias("mesh_area"), *[F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"])
    residual = g.norm(g.vec("n")) / F.greatest(F.col("mesh_area"), F.lit(1e-12))
    return agg.withColumn("closure_residual", residual).withColumn("closed", residual < CLOSED_BELOW).drop("nx", "ny", "nz")


def moments(tri: DataFrame) -> DataFrame:
    """Volume, centroid, second and third central moments of every shape.

    Two aggregations over the triangles: mean corner, then polynomial sums of the
    signed tetrahedra from that point (closed form for each monomial). Moving the
    moments to the centroid afterwards is arithmetic on one row per shape; the mean
    corner is close to it, so little is lost to cancellation. Both aggregations are
    sums, so a shape with very many triangles is added up map-side.
    """
    base = surface(tri)
    t = tri.join(base.select("fingerprint", *[f"apex_{x}" for x in "xyz"]), "fingerprint")
    corner = _corners(t, "apex_")
    t = t.select("fingerprint", *[corner[i]["xyz".index(x)].alias(f"{'abc'[i]}{x}") for i in range(3) for x in "xyz"])
    a, b, c = (g.vec(k) for k in "abc")
    t = t.withColumn("v", g.dot(a, g.cross(b, c)) / 6)
    s = {x: F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}") for x in "xyz"}

    def over(names: str):
        """Sum over the three corners of the product of the named coordinates."""
        terms = []
        for k in "abc":
            p = F.col(f"{k}{names[0]}")
            for n in names[1:]:
                p = p * F.col(f"{k}{n}")
            terms.append(p)
        return terms[0] + terms[1] + terms[2]

    def third(m: str):
        i, j, k = m
        return F.col("v") / 120 * (s[i] * s[j] * s[k] + over(i + j) * s[k] + over(i + k) * s[j] + over(j + k) * s[i] + 2 * over(m))

    raw = t.groupBy("fingerprint").agg(
        F.sum("v").alias("volume"), *[F.sum(F.col("v") / 4 * s[x]).alias(f"f_{x}") for x in "xyz"],
        *[F.sum(F.col("v") / 20 * (s[m[0]] * s[m[1]] + over(m))).alias(f"r_{m}") for m in _SECOND],
        *[F.sum(third(m)).alias(f"q_{m}") for m in _THIRD])
    out = raw.join(base, "fingerprint")
    solid = F.abs("volume") >= 1e-15
    d = {x: F.when(solid, F.col(f"f_{x}") / F.col("volume")).otherwise(0.0) for x in "xyz"}
    for x in "xyz":
        out = out.withColumn(f"d_{x}", d[x]).withColumn(f"com_{x}", F.col(f"apex_{x}") + F.col(f"d_{x}"))
    at = {x: F.col(f"d_{x}") for x in "xyz"}
    r = {m: F.col(f"r_{m}") for m in _SECOND}
    two = lambda p, q: r["".join(sorted(p + q))]
    second = [F.when(solid, r[m] - F.col("volume") * at[m[0]] * at[m[1]]).otherwise(0.0).alias(f"s_{m}") for m in _SECOND]
    third_c = [F.when(solid, F.col(f"q_{m}") - (at[m[0]] * two(m[1], m[2]) + at[m[1]] * two(m[0], m[2]) + at[m[2]] * two(m[0], m[1]))
                      + 2 * F.col("volume") * at[m[0]] * at[m[1]] * at[m[2]]).otherwise(0.0).alias(f"t_{m}") for m in _THIRD]
    return out.select("fingerprint", "volume", "triangles", "mesh_area", "closure_residual", "closed",
                      "com_x", "com_y", "com_z", *second, *third_c)


def mesh_warnings(moment: DataFrame, exact: DataFrame) -> DataFrame:
    """Meshes that do not close or whose volume is off: (fingerprint, warning, value)."""
    m = moment.join(exact.select("fingerprint", "volume_exact"), "fingerprint", "left")
    error = F.abs(F.col("volume") - F.col("volume_exact")) / F.col("volume_exact")
    off = F.when((F.col("volume_exact") > 0) & (error > VOLUME_ERROR_ABOVE), F.struct(F.lit("volume differs").alias("warning"), error.alias("value")))
    opened = F.when(~F.col("closed"), F.struct(F.lit("mesh does not close").alias("warning"), F.col("closure_residual").alias("value")))
    return m.select("fingerprint", F.explode(F.filter(F.array(opened, off), lambda w: w.isNotNull())).alias("w")).select(
        "fingerprint", "w.warning", "w.value")


_FRAME = T.StructType([T.StructField("fingerprint", T.StringType()),
                       *[T.StructField(f"e{i}", T.DoubleType()) for i in range(3)],
                       *[T.StructField(f"u{i}{x}", T.DoubleType()) for i in range(3) for x in "xyz"],
                       T.StructField("pair", T.IntegerType()), T.StructField("pairs", T.IntegerType())])


def _principal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Eigenvalues (ascending) and axes of each second-moment tensor, one batched call per Arrow batch."""
    for b in batches:
        m = np.stack([b[f"s_{'xyz'[min(i, j)]}{'xyz'[max(i, j)]}"] for i in range(3) for j in range(3)], 1).reshape(-1, 3, 3)
        val, axes = np.linalg.eigh(m)
        scale = np.abs(val).max(axis=1)
        close = (np.diff(val, axis=1) < DEGENERATE_BELOW * scale[:, None]) & (scale[:, None] > 0)
        out = {"fingerprint": b["fingerprint"], **{f"e{i}": val[:, i] for i in range(3)},
               **{f"u{i}{'xyz'[k]}": axes[:, k, i] for i in range(3) for k in range(3)},
               "pair": np.where(close[:, 0], 0, 1).astype("int32"), "pairs": close.sum(axis=1).astype("int32")}
        yield pd.DataFrame(out)[_FRAME.names]


def fourth_moments(tri: DataFrame, plane: DataFrame) -> DataFrame:
    """Fourth central moments in the plane of two directions.

    plane(fingerprint, com_*, p*, q*). (cos t p + sin t q) to the fourth power is a
    polynomial in five sums, so every sampled direction is answered by one pass over
    the triangles instead of one pass per direction.
    """
    t = tri.join(plane, "fingerprint")
    a, b, c = _corners(t, "com_")
    p, q = g.vec("p"), g.vec("q")
    v = g.dot(a, g.cross(b, c)) / 6
    flat = t.select("fingerprint", v.alias("v"), *[g.dot(k, p).alias(f"{n}p") for n, k in zip("abc", (a, b, c))],
                    *[g.dot(k, q).alias(f"{n}q") for n, k in zip("abc", (a, b, c))])

    def mixed(k: int):
        total = None
        for w, (wa, wb, wc) in RULE:
            x = F.col("ap") * wa + F.col("bp") * wb + F.col("cp") * wc
            y = F.col("aq") * wa + F.col("bq") * wb + F.col("cq") * wc
            term = F.lit(w)
            for f in [x] * (4 - k) + [y] * k:
                term = term * f
            total = term if total is None else total + term
        return F.sum(F.col("v") * total).alias(f"w{k}")

    return flat.groupBy("fingerprint").agg(*[mixed(k) for k in range(5)])


def principal_frames(moment: DataFrame, tri: DataFrame) -> DataFrame:
    """Canonical axes of every shape: eigenvectors, equal moments told apart by fourth
    moments where possible, signs by skewness. handedness is 0 when undetermined."""
    start = moment.mapInPandas(_principal, _FRAME).join(
        moment.select("fingerprint", "volume", *[f"com_{x}" for x in "xyz"], *[f"t_{m}" for m in _THIRD]), "fingerprint")
    first = F.col("pair") == 0
    plane = start.filter("pairs = 1").select(
        "fingerprint", "com_x", "com_y", "com_z",
        *[F.when(first, F.col(f"u0{x}")).otherwise(F.col(f"u1{x}")).alias(f"p{x}") for x in "xyz"],
        *[F.when(first, F.col(f"u1{x}")).otherwise(F.col(f"u2{x}")).alias(f"q{x}") for x in "xyz"])
    fourth = fourth_moments(tri, plane)
    turns = F.transform(F.sequence(F.lit(0), F.lit(ANGLES - 1)), lambda k: k * (math.pi / ANGLES))
    at = F.transform(turns, lambda t: sum((F.col(f"w{k}") * math.comb(4, k) * F.pow(F.cos(t), F.lit(4 - k)) * F.pow(F.sin(t), F.lit(k))
                                           for k in range(1, 5)), F.col("w0") * F.pow(F.cos(t), F.lit(4))))
    fourth = fourth.withColumn("_at", at)
    top, low = F.array_max("_at"), F.array_min("_at")
    largest = F.greatest(F.abs(top), F.abs(low))
    fourth = fourth.select(
        "fingerprint", ((largest > 0) & ((top - low) / largest >= ROUND_BELOW)).alias("broken"),
        ((F.array_position("_at", top) - 1) * (math.pi / ANGLES)).alias("turn"))
    f = start.join(fourth, "fingerprint", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    f = f.withColumn("round", (F.col("pairs") > 0) & ~F.col("broken"))
    cos, sin = F.cos("turn"), F.sin("turn")
    u = [g.vec(f"u{i}") for i in range(3)]
    # Turned basis for a degenerate pair (0,1) or (1,2); the odd axis out completes a right-handed set.
    low_new = [cos * a + sin * b for a, b in zip(u[0], u[1])]
    high_new = [cos * a + sin * b for a, b in zip(u[1], u[2])]
    low_v, high_v = g.cross(u[2], low_new), g.cross(u[0], high_new)
    axes = []
    for i in range(3):
        pick_low = [low_new, low_v, g.cross(low_new, low_v)][i]
        pick_high = [g.cross(high_new, high_v), high_new, high_v][i]
        axes.append([F.when(F.col("broken") & first, pick_low[k]).when(F.col("broken"), pick_high[k]).otherwise(u[i][k]).alias(f"a{i}{'xyz'[k]}")
                     for k in range(3)])
    f = f.select("fingerprint", "volume", "e0", "e1", "e2", "round", *[f"com_{x}" for x in "xyz"],
                 *[f"t_{m}" for m in _THIRD], *[c for ax in axes for c in ax])
    size = F.when(F.abs("volume") > 0, F.col("volume") * F.col("volume")).otherwise(1.0)
    for i in range(3):
        skew = g.third_along(g.vec(f"a{i}")) / size
        f = f.withColumn(f"_k{i}", F.when(F.abs(skew) < SKEWNESS_BELOW, 0).when(skew < 0, -1).otherwise(1))
    signed = [[F.col(f"a{i}{x}") * F.when(F.col(f"_k{i}") < 0, -1.0).otherwise(1.0) for x in "xyz"] for i in range(3)]
    known = (F.col("_k0") != 0) & (F.col("_k1") != 0) & (F.col("_k2") != 0)
    hand = F.when(known & ~F.col("round"), F.when(g.dot(signed[0], g.cross(signed[1], signed[2])) > 0, 1).otherwise(-1)).otherwise(0)
    return f.select("fingerprint", "volume", *[f"com_{x}" for x in "xyz"], "e0", "e1", "e2", "round",
                    (known & ~F.col("round")).alias("frame_stable"), hand.alias("handedness"),
                    *[signed[i]["xyz".index(x)].alias(f"a{i}{x}") for i in range(3) for x in "xyz"])


def principal_extents(frame: DataFrame, tri: DataFrame) -> DataFrame:
    """Extents of a shape along its own axes over its characteristic length; stable frames only."""
    t = tri.join(frame.filter("frame_stable"), "fingerprint")
    corner = _corners(t, "com_")
    along = lambda i: [g.dot(c, g.vec(f"a{i}")) for c in corner]
    agg = t.groupBy("fingerprint", "volume").agg(
        *[(F.max(F.greatest(*along(i))) - F.min(F.least(*along(i)))).alias(f"x{i}") for i in range(3)])
    length = g.char_length(F.abs("volume"))
    return agg.select("fingerprint", *[(F.col(f"x{i}") / length).alias(f"extent_{i}") for i in range(3)])


def face_histogram(face: DataFrame) -> DataFrame:
    """Faces per kind with all eight kinds present; unknown kinds count as 'other'."""
    known = F.col("kind").isin(*digest.SURFACE_KINDS)
    kind = F.when(known, F.col("kind")).otherwise("other")
    return face.withColumn("_k", kind).groupBy("fingerprint").agg(
        *[F.count_if(F.col("_k") == k).alias(f"faces_{k}") for k in digest.SURFACE_KINDS])


def identify(tri: DataFrame, solid: DataFrame, face: DataFrame, feature_hand: DataFrame | None = None) -> DataFrame:
    """Invariants and strict identity of every solid.

    solid(fingerprint as key, area, n_faces, n_edges, n_vertices, n_shells, n_solids);
    feature_hand(fingerprint, feature_chirality) decides where mass symmetry cannot.
    """
    frame = principal_frames(moments(tri), tri)
    f = frame.join(solid, "fingerprint").join(face_histogram(face), "fingerprint", "left").fillna(0, [f"faces_{k}" for k in digest.SURFACE_KINDS])
    if feature_hand is not None:
        f = f.join(feature_hand, "fingerprint", "left")
    else:
        f = f.withColumn("feature_chirality", F.lit(0))
    volume = F.abs("volume")
    scale = F.pow(volume, F.lit(5 / 3))
    hand = F.when(F.col("handedness") != 0, F.col("handedness")).otherwise(F.coalesce("feature_chirality", F.lit(0)))
    f = f.filter(volume > 0).select(
        F.col("fingerprint").alias("solid_id"), volume.alias("volume"), g.char_length(volume).alias("char_length"),
        g.sphericity(volume, F.col("area")).alias("sphericity"), *[(F.col(f"e{i}") / scale).alias(f"j{i + 1}") for i in range(3)],
        hand.alias("chirality"), "frame_stable", "com_x", "com_y", "com_z", "n_faces", "n_edges", "n_vertices", "n_shells", "n_solids",
        *[f"faces_{k}" for k in digest.SURFACE_KINDS])
    return f.withColumn("strict", digest.fingerprint(
        F.col("char_length"), [F.col(c) for c in ("sphericity", "j1", "j2", "j3")], F.col("chirality"),
        [F.col(f"faces_{k}") for k in digest.SURFACE_KINDS],
        [F.col(c) for c in ("n_faces", "n_edges", "n_vertices", "n_shells", "n_solids")]))
