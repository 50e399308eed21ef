"""Bores, hole patterns, mounting planes and handedness from faces, all shapes at once.

face(fingerprint, face_id, kind, area, n{x,y,z}, o{x,y,z}, axis_{x,y,z}, p{x,y,z},
radius, internal, extent, sweep); face_id gives the order faces arrive in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cluster, geometry as g

# When two axes, positions and radii count as the same, and when a
# turn is complete or a bore goes through.
AXIS_ANGLE = math.radians(0.5)
AXIS_DISTANCE = 1e-3
RADIUS_STEP = 1e-3
FULL_TURN = 2 * math.pi - 1e-3
THROUGH_SHARE = 0.98
FLAT = 1e-6

_AXIS_REACH = 2 * math.sin(AXIS_ANGLE / 2) * 1.01
_BLOCK = 512


def complete(sweep: Column | str = "sweep") -> Column:
    """A turn short of full is a slot or a broken-out hole, not a round bore."""
    return (F.col(sweep) if isinstance(sweep, str) else sweep) >= FULL_TURN


def _on_axis(face: DataFrame, centroid: DataFrame, kind: str) -> DataFrame:
    d = g.canonical([F.col(f"axis_{a}") for a in "xyz"])
    f = face.filter((F.col("kind") == kind) & F.col("internal")).join(
        centroid.select("fingerprint", *[F.col(f"com_{a}") for a in "xyz"]), "fingerprint")
    f = f.select("fingerprint", "face_id", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("extent", F.lit(0.0)).alias("extent"),
                 F.coalesce("sweep", F.lit(0.0)).alias("sweep"), *[F.col(f"p{a}") for a in "xyz"], *[F.col(f"com_{a}") for a in "xyz"],
                 *[d[i].alias(f"d{'xyz'[i]}") for i in range(3)])
    q = g.nearest_on_axis(g.vec("p"), g.vec("d"), g.vec("com_"))
    return f.select("fingerprint", "face_id", "radius", "extent", "sweep", *[f"d{a}" for a in "xyz"],
                    *[q[i].alias(f"q{'xyz'[i]}") for i in range(3)])


def _same_line(a: str, b: str) -> Column:
    return ((g.axis_angle(g.vec(a + "d"), g.vec(b + "d")) <= AXIS_ANGLE)
            & (g.distance(g.vec(a + "q"), g.vec(b + "q")) <= AXIS_DISTANCE))


_LINE = [(f"q{a}", AXIS_DISTANCE) for a in "xyz"] + [(f"d{a}", _AXIS_REACH) for a in "xyz"]
_MIRROR = [f"d{a}" for a in "xyz"]


def merge_bores(face: DataFrame, centroid: DataFrame) -> DataFrame:
    """One row per physical hole, however many faces describe it.

    Faces on one axis line are one hole; its smallest radius is the bore, larger ones
    are counterbores. ``bore_id`` is the first face of the hole.
    """
    cyl = cluster.leaders(_on_axis(face, centroid, "cylinder"), "fingerprint", "face_id", _LINE, _same_line, _MIRROR)
    cyl = cyl.withColumnRenamed("leader", "bore_id")
    first = F.min(F.struct("face_id", "radius"))
    rings = cyl.groupBy("fingerprint", "bore_id", F.bround(F.col("radius") / RADIUS_STEP, 0).alias("step")).agg(
        first.getField("radius").alias("radius"), F.sum("sweep").alias("sweep"), F.max("extent").alias("depth"),
        F.count(F.lit(1)).alias("faces"))
    holes = rings.groupBy("fingerprint", "bore_id").agg(
        F.min(F.struct("radius", "depth", "sweep")).alias("b"), F.sum("depth").alias("total_depth"),
        F.sum("faces").alias("face_count"), F.array_sort(F.collect_set("radius")).alias("radii"))
    axis = cyl.filter("face_id = bore_id").select("fingerprint", "bore_id", *[f"d{a}" for a in "xyz"], *[f"q{a}" for a in "xyz"])
    bores = holes.join(axis, ["fingerprint", "bore_id"]).select(
        "fingerprint", "bore_id", *[F.col(f"d{a}") for a in "xyz"], *[F.col(f"q{a}") for a in "xyz"],
        F.col("b.radius").alias("radius"), F.col("b.depth").alias("depth"), F.col("b.sweep").alias("sweep"),
        "total_depth", "face_count", F.slice("radii", 2, F.greatest(F.size("radii") - 1, F.lit(0))).alias("counterbores"))
    # A cone lying on a bore's axis is its chamfer: the same grid test, cones against founders.
    cones = _on_axis(face, centroid, "cone").select("fingerprint", F.lit(True).alias("_cone"), F.col("face_id").alias("_id"),
                                                    *[f"d{a}" for a in "xyz"], *[f"q{a}" for a in "xyz"])
    marks = bores.select("fingerprint", F.lit(False).alias("_cone"), F.col("bore_id").alias("_id"), *[f"d{a}" for a in "xyz"], *[f"q{a}" for a in "xyz"])
    own = marks.withColumn("_cell", cluster._own_cell("fingerprint", _LINE)).select(
        "_cell", F.col("_id").alias("bore_id"), F.col("fingerprint").alias("b_fp"), *[F.col(c).alias(f"b_{c}") for c, _ in _LINE])
    near = cluster._touched_cells(cones, "fingerprint", _LINE, _MIRROR).select(
        "_cell", F.col("fingerprint").alias("c_fp"), *[F.col(c).alias(f"c_{c}") for c, _ in _LINE])
    chamfered = near.join(own, "_cell").filter((F.col("b_fp") == F.col("c_fp")) & _same_line("b_", "c_")).select(
        F.col("b_fp").alias("fingerprint"), "bore_id").distinct().withColumn("chamfered", F.lit(True))
    return bores.join(chamfered, ["fingerprint", "bore_id"], "left").withColumn(
        "chamfered", F.coalesce("chamfered", F.lit(False))).withColumn("complete", complete())


def mark_through(bore: DataFrame, tri: DataFrame) -> DataFrame:
    """Flag bores that span the part's extent along their own axis.

    Extents are computed per distinct axis of a shape, not per bore.
    """
    axes = bore.select("fingerprint", "dx", "dy", "dz").distinct()
    t = tri.join(axes, "fingerprint")
    d = g.vec("d")
    at = [g.dot([F.col(f"{k}{x}") for x in "xyz"], d) for k in "abc"]
    span = t.select("fingerprint", "dx", "dy", "dz", F.greatest(*at).alias("hi"), F.least(*at).alias("lo")).groupBy(
        "fingerprint", "dx", "dy", "dz").agg((F.max("hi") - F.min("lo")).alias("span"))
    return bore.join(span, ["fingerprint", "dx", "dy", "dz"], "left").withColumn(
        "through", F.coalesce((F.col("span") > 0) & (F.col("total_depth") >= THROUGH_SHARE * F.col("span")), F.lit(False))).drop("span")


def hole_patterns(bore: DataFrame, min_count: int = 2) -> tuple[DataFrame, DataFrame]:
    """Parallel round bores of equal radius: (patterns, members).

    ``pattern_id`` is the first bore; patterns of a shape rank by count, then radius.
    """
    near = lambda a, b: ((g.axis_angle(g.vec(a + "d"), g.vec(b + "d")) <= AXIS_ANGLE)
                         & (F.abs(F.col(a + "radius") - F.col(b + "radius")) <= RADIUS_STEP))
    coords = [("radius", RADIUS_STEP)] + [(f"d{a}", _AXIS_REACH) for a in "xyz"]
    m = cluster.leaders(bore.filter("complete"), "fingerprint", "bore_id", coords, near, _MIRROR).withColumnRenamed("leader", "pattern_id")
    p = m.groupBy("fingerprint", "pattern_id").agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(f"q{a}").alias(f"centroid_{a}") for a in "xyz"],
        F.min(F.struct("bore_id", "radius", "dx", "dy", "dz")).alias("f")).filter(F.col("count") >= min_count)
    p = p.select("fingerprint", "pattern_id", "count", "f.radius", "f.dx", "f.dy", "f.dz", *[f"centroid_{a}" for a in "xyz"])
    members = m.join(p.select("fingerprint", "pattern_id"), ["fingerprint", "pattern_id"], "left_semi").select(
        "fingerprint", "pattern_id", "bore_id", "qx", "qy", "qz", "radius")
    return p, members


def ranked_patterns(pattern: DataFrame, keep: int | None = None) -> DataFrame:
    """Patterns of each shape numbered by count, then radius, then first bore; the first ``keep``."""
    w = Window.partitionBy("fingerprint").orderBy(F.desc("count"), "radius", "pattern_id")
    p = pattern.withColumn("rank", F.row_number().over(w))
    return p.filter(F.col("rank") <= keep) if keep else p


def mounting_planes(face: DataFrame, min_area: float = 0.0) -> DataFrame:
    """Planar faces with a normal, at least ``min_area`` large, normal made canonical."""
    n = g.canonical(g.vec("n"))
    return face.filter((F.col("kind") == "plane") & F.col("nx").isNotNull() & (F.col("area") >= min_area)).select(
        "fingerprint", "face_id", "area", *[n[i].alias(f"n{'xyz'[i]}") for i in range(3)], *[F.col(f"o{a}") for a in "xyz"])


def largest_planes(plane: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest planes of each shape."""
    w = Window.partitionBy("fingerprint").orderBy(F.desc("area"), "face_id")
    return plane.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def feature_chirality(bore: DataFrame, centroid: DataFrame) -> DataFrame:
    """Hand of each shape's hole layout: (fingerprint, feature_chirality) in -1, 0, 1.

    Four bores are picked by a key that a mirror image shares; the sign of the
    determinant they span is the hand. The third part of the key, the summed distance
    to all bores, is needed only for bores that the first two parts leave in question.
    It is added up over blocks of points held in one cell, so neither all pairs nor a
    whole shape's bores ever sit in one task.
    """
    c = centroid.select("fingerprint", "com_x", "com_y", "com_z")
    q = g.vec("q")
    b = bore.join(c, "fingerprint")
    size = bore.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.greatest(*[F.max(f"q{a}") - F.min(f"q{a}") for a in "xyz"], F.lit(1.0)).alias("span")).filter("n >= 4")
    b = b.join(size, "fingerprint").withColumn("quantum", F.col("span") * 1e-3)
    b = b.withColumn("k1", F.bround(F.col("radius") / 0.01, 0)).withColumn(
        "k2", F.bround(g.distance(q, g.vec("com_")) / F.col("quantum"), 0)).withColumn("k4", F.bround(F.col("depth") / 0.05, 0))
    b = b.select("fingerprint", "bore_id", "qx", "qy", "qz", "k1", "k2", "k4", "n", "quantum")
    w = Window.partitionBy("fingerprint").orderBy("k1", "k2")
    asked = b.withColumn("_r", F.rank().over(w)).filter("_r <= 5").drop("_r")
    blocks = b.withColumn("_b", F.pmod(F.xxhash64("bore_id"), F.ceil(F.col("n") / _BLOCK))).groupBy("fingerprint", "_b").agg(
        F.collect_list(F.struct("qx", "qy", "qz")).alias("pts"))
    far = F.aggregate("pts", F.lit(0.0), lambda acc, p: acc + F.sqrt(
        (p["qx"] - F.col("qx")) ** 2 + (p["qy"] - F.col("qy")) ** 2 + (p["qz"] - F.col("qz")) ** 2))
    total = asked.join(blocks, "fingerprint").withColumn("_d", far).groupBy(*asked.columns).agg(F.sum("_d").alias("mutual"))
    total = total.withColumn("k3", F.bround(F.col("mutual") / (F.col("quantum") * F.col("n")), 0))
    order = Window.partitionBy("fingerprint").orderBy("k1", "k2", "k3", "k4", "bore_id")
    top = total.withColumn("rn", F.row_number().over(order)).filter("rn <= 5").withColumn("key", F.struct("k1", "k2", "k3", "k4"))
    one = top.groupBy("fingerprint").agg(
        F.count_distinct(F.when(F.col("rn") <= 4, F.col("key"))).alias("kinds"),
        *[F.max(F.when(F.col("rn") == i, F.col("key"))).alias(f"key{i}") for i in (4, 5)],
        *[F.max(F.when(F.col("rn") == i, F.col(f"q{a}"))).alias(f"p{i}{a}") for i in range(1, 5) for a in "xyz"])
    p = [g.vec(f"p{i}") for i in range(1, 5)]
    det = g.dot(g.minus(p[1], p[0]), g.cross(g.minus(p[2], p[0]), g.minus(p[3], p[0])))
    mid = [(p[0][k] + p[1][k] + p[2][k] + p[3][k]) / 4 for k in range(3)]
    spread = (g.distance(p[0], mid) + g.distance(p[1], mid) + g.distance(p[2], mid) + g.distance(p[3], mid)) / 4
    cube = spread * spread * spread
    clear = (F.col("kinds") == 4) & (F.col("key5").isNull() | (F.col("key4") != F.col("key5")))
    hand = F.when(~clear | (cube <= 0) | (F.abs(det) / cube < FLAT), 0).when(det > 0, 1).otherwise(-1)
    known = one.select("fingerprint", hand.alias("hand"))
    return centroid.select("fingerprint").join(known, "fingerprint", "left").select(
        "fingerprint", F.coalesce("hand", F.lit(0)).alias("feature_chirality"))


def feature_rows(bore: DataFrame, plane: DataFrame) -> DataFrame:
    """Bores and planes in the stored feature layout."""
    b = bore.select("fingerprint", F.lit("bore").alias("kind"), *[F.col(f"d{a}").alias(f"axis_{a}") for a in "xyz"],
                    *[F.col(f"q{a}").alias(f"p{a}") for a in "xyz"], "radius", "depth", F.lit(None).cast("double").alias("area"),
                    "sweep", "through", "complete", "chamfered", F.to_json("counterbores").alias("counterbores"))
    p = plane.select("fingerprint", F.lit("plane").alias("kind"), *[F.col(f"n{a}").alias(f"axis_{a}") for a in "xyz"],
                     *[F.col(f"o{a}").alias(f"p{a}") for a in "xyz"], F.lit(None).cast("double").alias("radius"),
                     F.lit(None).cast("double").alias("depth"), "area", F.lit(None).cast("double").alias("sweep"),
                     F.lit(False).alias("through"), F.lit(True).alias("complete"), F.lit(False).alias("chamfered"), F.lit("[]").alias("counterbores"))
    return b.unionByName(p)
