"""Moments, frames, features, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import geometry
from partloom.operators import features, lookup, matching, shapes
from partloom.session import cut

from .registry import extra, grid, grid_sql, query, shared


@query("s04_triangle_scan", "SELECT fingerprint, COUNT(*) AS triangles FROM fx_triangle GROUP BY fingerprint")
def _(fx):
    return fx.triangle.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("triangles"))


@query("a10_moments", f"""
SELECT fingerprint, {grid_sql('volume', 1000)} AS volume, {grid_sql('dx / 2')} AS com_x, {grid_sql('dz / 2')} AS com_z,
       {grid_sql('volume * dx * dx / 12', 12)} AS s_xx, {grid_sql('volume * dy * dy / 12', 12)} AS s_yy, 0 AS s_xy, 0 AS t_xxx, 0 AS t_xyz FROM fx_shape""")
def _(fx):
    m = shapes.moments(fx.triangle)
    return m.select("fingerprint", grid("volume", 1000).alias("volume"), grid("com_x").alias("com_x"), grid("com_z").alias("com_z"),
                    grid("s_xx", 12).alias("s_xx"), grid("s_yy", 12).alias("s_yy"), grid("s_xy", 10).alias("s_xy"),
                    grid("t_xxx", 10).alias("t_xxx"), grid("t_xyz", 10).alias("t_xyz"))


@query("a11_closure", "SELECT fingerprint, COUNT(*) AS triangles, TRUE AS closed FROM fx_triangle GROUP BY fingerprint")
def _(fx):
    return shapes.surface(fx.triangle).select("fingerprint", "triangles", "closed")


@query("a18_mesh_checks", """
SELECT fingerprint, 'mesh does not close' AS warning FROM fx_shape WHERE chirality = -1
UNION ALL SELECT fingerprint, 'volume differs' FROM fx_shape WHERE chirality = -1 AND volume_exact IS NOT NULL""")
def _(fx):
    # One triangle is taken out of the meshes of left-handed shapes.
    torn = fx.shape.filter("chirality = -1").select("fingerprint", F.lit(7).alias("tri"))
    t = fx.triangle.join(torn, ["fingerprint", "tri"], "left_anti")
    return shapes.mesh_warnings(shapes.moments(t), fx.shape).select("fingerprint", "warning")


@query("f24_inertia", f"""
SELECT fingerprint, {grid_sql('volume * (dy * dy + dz * dz) / 12', 12)} AS xx, {grid_sql('volume * (dx * dx + dz * dz) / 12', 12)} AS yy, 0 AS xy FROM fx_shape""")
def _(fx):
    i = geometry.inertia()
    return shapes.moments(fx.triangle).select("fingerprint", *[grid(i[m], 12).alias(m) for m in ("xx", "yy", "xy")])


def frames(fx):
    return shared(fx, "frames", lambda: cut(shapes.principal_frames(shapes.moments(fx.triangle), fx.triangle)))


def identities(fx):
    return shared(fx, "identities", lambda: cut(shapes.identify(fx.triangle, _solid(fx), extra(fx, "fx_face"))))


@query("a12_degeneracy", """
SELECT fingerprint, (CASE WHEN dx = dy OR dy = dz OR dx = dz THEN 1 ELSE 0 END) AS degenerate, FALSE AS round FROM fx_shape""")
def _(fx):
    f = frames(fx)
    close = (F.abs(F.col("e1") - F.col("e0")) < 1e-4 * F.col("e2")) | (F.abs(F.col("e2") - F.col("e1")) < 1e-4 * F.col("e2"))
    return f.select("fingerprint", F.when(close, 1).otherwise(0).alias("degenerate"), "round")


@query("n05_principal_frame", f"""
SELECT fingerprint, {grid_sql('volume * LEAST(dx, dy, dz) * LEAST(dx, dy, dz) / 12', 12)} AS e0, {grid_sql('volume * GREATEST(dx, dy, dz) * GREATEST(dx, dy, dz) / 12', 12)} AS e2,
       FALSE AS frame_stable, 0 AS handedness FROM fx_shape""")
def _(fx):
    return frames(fx).select("fingerprint", grid("e0", 12).alias("e0"), grid("e2", 12).alias("e2"), "frame_stable", "handedness")


@query("a09_face_histogram", """
SELECT fingerprint, COUNT(*) FILTER (WHERE kind = 'plane') AS faces_plane, COUNT(*) FILTER (WHERE kind = 'cylinder') AS faces_cylinder,
       COUNT(*) FILTER (WHERE kind = 'cone') AS faces_cone, COUNT(*) FILTER (WHERE kind NOT IN ('plane', 'cylinder', 'cone')) AS faces_other FROM fx_face GROUP BY fingerprint""")
def _(fx):
    return shapes.face_histogram(extra(fx, "fx_face")).select("fingerprint", "faces_plane", "faces_cylinder", "faces_cone", "faces_other")


def _solid(fx):
    return fx.shape.select("fingerprint", "area", F.lit(23).alias("n_faces"), F.lit(40).alias("n_edges"), F.lit(24).alias("n_vertices"),
                           F.lit(1).alias("n_shells"), F.lit(1).alias("n_solids"))


@query("n06_shape_identity", f"""
SELECT fingerprint AS solid_id, {grid_sql('char_length')} AS char_length, {grid_sql('sphericity')} AS sphericity,
       {grid_sql('j1')} AS j1, {grid_sql('j2')} AS j2, {grid_sql('j3')} AS j3, 0 AS chirality FROM fx_invariant""")
def _(fx):
    return identities(fx).select("solid_id", *[grid(c).alias(c) for c in ("char_length", "sphericity", "j1", "j2", "j3")], "chirality")


@query("f07_strict_fingerprint", """
SELECT s.fingerprint AS solid_id, MIN(t.fingerprint) AS first_equal FROM fx_shape s JOIN fx_shape t
ON s.dx = t.dx AND s.dy = t.dy AND s.dz = t.dz AND (s.chirality = 1) = (t.chirality = 1) AND (s.dx > 50) = (t.dx > 50) GROUP BY s.fingerprint""")
def _(fx):
    i = identities(fx)
    first = i.groupBy("strict").agg(F.min("solid_id").alias("first_equal"))
    return i.join(first, "strict").select("solid_id", "first_equal")


@query("f15_invariants", f"SELECT fingerprint, {grid_sql('sphericity')} AS sphericity, {grid_sql('char_length')} AS char_length FROM fx_invariant")
def _(fx):
    return fx.shape.select("fingerprint", grid(geometry.sphericity(F.col("volume"), F.col("area"))).alias("sphericity"),
                           grid(geometry.char_length(F.col("volume"))).alias("char_length"))


# -- features -----------------------------------------------------------------

def bores(fx):
    return shared(fx, "bores", lambda: cut(features.merge_bores(extra(fx, "fx_face"), fx.shape)))


_HOLE = """hole AS (
  SELECT s.*, h.h, CAST(10 + h.h * 10 AS BIGINT) AS bore_id, dx / 5 + CASE WHEN h.h IN (1, 3) THEN dx / 2 ELSE 0 END AS x,
         dy / 5 + CASE WHEN h.h >= 2 THEN dy / 2 ELSE 0 END AS y, CAST(3.3 AS DOUBLE) + CAST(h.h AS DOUBLE) / 100000 AS radius,
         NOT (h.h = 3 AND dx > 50) AS complete FROM fx_shape s CROSS JOIN (SELECT unnest(range(0, 4)) AS h) h)"""


@query("n01_merged_bores", f"""WITH {_HOLE}
SELECT fingerprint, bore_id, {grid_sql('x')} AS x, {grid_sql('y')} AS y, {grid_sql('dz / 2')} AS z, {grid_sql('radius')} AS radius,
       {grid_sql('dz - CASE WHEN chirality = 1 THEN 2 ELSE 0 END')} AS depth, {grid_sql('dz')} AS total_depth, complete, h = 0 AS chamfered,
       CASE WHEN chirality = 1 THEN 1 ELSE 0 END AS counterbores FROM hole""")
def _(fx):
    return bores(fx).select("fingerprint", "bore_id", grid("qx").alias("x"), grid("qy").alias("y"), grid("qz").alias("z"), grid("radius").alias("radius"),
                    grid("depth").alias("depth"), grid("total_depth").alias("total_depth"), "complete", "chamfered", F.size("counterbores").alias("counterbores"))


@query("n02_hole_patterns", f"""WITH {_HOLE}
SELECT fingerprint, MIN(bore_id) AS pattern_id, COUNT(*) AS count, {grid_sql('AVG(x)')} AS x, {grid_sql('MIN(radius)')} AS radius FROM hole WHERE complete GROUP BY fingerprint""")
def _(fx):
    p, _ = features.hole_patterns(bores(fx))
    return p.select("fingerprint", "pattern_id", "count", grid("centroid_x").alias("x"), grid("radius").alias("radius"))


@query("n03_planes_and_through", f"""WITH {_HOLE} SELECT fingerprint, bore_id, TRUE AS through, {grid_sql('GREATEST(dx * dy, dx * dz, dy * dz)')} AS largest FROM hole""")
def _(fx):
    top = features.largest_planes(features.mounting_planes(extra(fx, "fx_face")), 1)
    b = features.mark_through(bores(fx), fx.triangle)
    return b.join(top.select("fingerprint", "area"), "fingerprint").select("fingerprint", "bore_id", "through", grid("area").alias("largest"))


@query("n04_feature_chirality", "SELECT fingerprint, 0 AS feature_chirality FROM fx_shape")
def _(fx):
    return features.feature_chirality(bores(fx), fx.shape)


@query("p14_complete_bores", f"WITH {_HOLE} SELECT fingerprint, bore_id FROM hole WHERE complete")
def _(fx):
    return bores(fx).filter(features.complete()).select("fingerprint", "bore_id")


@query("t07_patterns_ranked", f"""WITH {_HOLE} SELECT fingerprint, 1 AS rank, COUNT(*) AS count FROM hole WHERE complete GROUP BY fingerprint""")
def _(fx):
    return features.ranked_patterns(features.hole_patterns(bores(fx))[0], 6).select("fingerprint", "rank", "count")


# -- matching -----------------------------------------------------------------

_MATCH = """
m AS (SELECT p.probe_id, p.strict, s.fingerprint, ABS(p.char_length - s.char_length) / GREATEST(p.char_length, s.char_length) AS size_error,
             GREATEST(ABS(p.sphericity - s.sphericity), ABS(p.j1 - s.j1), ABS(p.j2 - s.j2), ABS(p.j3 - s.j3)) AS shape_error
      FROM fx_probe p JOIN fx_invariant s ON ABS(p.char_length - s.char_length) <= 1e-4 * GREATEST(p.char_length, s.char_length)
       AND NOT (p.chirality <> 0 AND s.chirality <> 0 AND p.chirality <> s.chirality)),
best AS (SELECT probe_id, fingerprint FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY FLOOR(shape_error * 1e9), FLOOR(size_error * 1e9), fingerprint) AS rn
         FROM m WHERE shape_error <= 1e-4) t WHERE rn = 1)"""


@query("j01_bounded_match", f"WITH {_MATCH} SELECT * FROM best")
def _(fx):
    return matching.bounded_match(extra(fx, "fx_probe"), extra(fx, "fx_invariant")).select("probe_id", "fingerprint")


@query("j17_resolve_shapes", f"""WITH {_MATCH}
SELECT p.probe_id, COALESCE(s.fingerprint, a.fingerprint, b.fingerprint, p.strict) AS fingerprint,
       CASE WHEN s.fingerprint IS NOT NULL OR a.fingerprint IS NOT NULL THEN 'exact_hit' WHEN b.fingerprint IS NOT NULL THEN 'bounded_hit' ELSE 'new' END AS status
FROM fx_probe p LEFT JOIN fx_shape s ON s.fingerprint = p.strict LEFT JOIN fx_alias a ON a.alias_fingerprint = p.strict LEFT JOIN best b ON b.probe_id = p.probe_id""")
def _(fx):
    out, _ = matching.resolve_shapes(extra(fx, "fx_probe"), extra(fx, "fx_invariant"), extra(fx, "fx_alias"))
    return out.select("probe_id", "fingerprint", "status")


@query("f21_compare_reason", """
SELECT p.probe_id, CASE WHEN p.chirality <> 0 AND s.chirality <> 0 AND p.chirality <> s.chirality THEN 'mirror images of each other' ELSE 'within tolerance' END AS reason
FROM fx_probe p JOIN fx_shape s ON s.fingerprint = p.truth""")
def _(fx):
    p, s = extra(fx, "fx_probe"), extra(fx, "fx_invariant")
    j = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns]).join(s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns]), F.col("a_truth") == F.col("b_fingerprint"))
    return j.select(F.col("a_probe_id").alias("probe_id"), matching.compare_reason(
        matching.size_error(), matching.shape_error(), matching.opposite_hands()).alias("reason"))


def queries_of(fx):
    return fx.proposal.selectExpr(
        "part_id AS query_id", "'bolt_pattern' AS kind", "CASE WHEN part_id % 3 = 0 THEN NULL ELSE 4 END AS hole_count",
        "CASE WHEN part_id % 5 = 0 THEN NULL ELSE 3.3D + 0.05D * (part_id % 4) END AS hole_radius", "0.06D AS radius_tol",
        "CASE WHEN part_id % 2 = 0 THEN array(30D, 30D, 40D, 40D, 50D, 50D) END AS spacings", "0.2D AS spacing_tol",
        "CASE WHEN part_id % 4 = 1 THEN 40D END AS allow_dx", "CASE WHEN part_id % 4 = 1 THEN 15D END AS allow_dy",
        "CASE WHEN part_id % 4 = 1 THEN 60D END AS allow_dz", "CAST(NULL AS STRING) AS fastener")


_FIT = """
ask AS (SELECT part_id AS query_id, CASE WHEN part_id % 3 = 0 THEN NULL ELSE 4 END AS hole_count, CASE WHEN part_id % 5 = 0 THEN NULL ELSE 3.3::DOUBLE + 0.05::DOUBLE * (part_id % 4) END AS r,
        part_id % 2 = 0 AS spaced, part_id % 4 = 1 AS boxed FROM fx_proposal),
cur AS (SELECT r.* FROM fx_revision r JOIN (SELECT part_id, MAX(revision_index) AS top FROM fx_revision GROUP BY part_id) x ON x.part_id = r.part_id AND x.top = r.revision_index),
hit AS (SELECT a.query_id, i.revision_id, p.part_number, r.fingerprint FROM ask a JOIN fx_interface i ON (a.hole_count IS NULL OR i.hole_count = a.hole_count)
   AND (a.r IS NULL OR ABS(i.hole_radius - a.r) <= 0.06) AND (NOT a.spaced OR i.w = 40)
   JOIN cur r ON r.revision_id = i.revision_id JOIN fx_part p ON p.part_id = r.part_id JOIN fx_shape s ON s.fingerprint = r.fingerprint
   WHERE NOT a.boxed OR (list_sort([s.dx, s.dy, s.dz])[1] <= 15 AND list_sort([s.dx, s.dy, s.dz])[2] <= 40 AND list_sort([s.dx, s.dy, s.dz])[3] <= 60))"""


def _candidates(fx):
    return matching.compatible_interfaces(queries_of(fx), fx.full_interface, fx.revision, fx.part, fx.shape,
                                          fx.contract, lookup.current_revision(fx.revision))


@query("j02_compatible_interfaces", f"WITH {_FIT} SELECT query_id, revision_id, part_number FROM hit")
def _(fx):
    return _candidates(fx).select("query_id", "revision_id", "part_number")


@query("j03_shape_proximity", f"""WITH {_FIT}, d AS (
  SELECT h.query_id, h.part_number, h.revision_id, sqrt(POWER((a.char_length - b.char_length) / GREATEST(a.char_length, b.char_length), 2) + POWER(a.sphericity - b.sphericity, 2)
         + POWER(a.j1 - b.j1, 2) + POWER(a.j2 - b.j2, 2) + POWER(a.j3 - b.j3, 2)) AS dist
  FROM hit h JOIN fx_part q ON q.part_id = h.query_id JOIN fx_invariant a ON a.fingerprint = q.fingerprint JOIN fx_invariant b ON b.fingerprint = h.fingerprint)
SELECT query_id, rn AS rank, {grid_sql('dist')} AS shape_distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY dist, part_number, revision_id) AS rn FROM d) t""")
def _(fx):
    like = fx.proposal.select(F.col("part_id").alias("query_id"), "part_id").join(fx.part.select("part_id", "fingerprint"), "part_id").select(
        "query_id", F.col("fingerprint").alias("like_fingerprint"))
    r = matching.rank_candidates(_candidates(fx), like, extra(fx, "fx_invariant"))
    return r.select("query_id", "rank", grid("shape_distance").alias("shape_distance"))


_PARTNER = """pair AS (
  SELECT a.case_id, a.variant, a.solid_id, b.variant AS other, ABS(a.char_length - b.char_length) / GREATEST(a.char_length, b.char_length) AS size_error,
         GREATEST(ABS(a.sphericity - b.sphericity), ABS(a.j1 - b.j1), ABS(a.j2 - b.j2), ABS(a.j3 - b.j3)) AS shape_error
  FROM fx_solid a JOIN fx_solid b ON a.case_id = b.case_id AND a.variant < b.variant),
best AS (SELECT case_id, variant, solid_id, other, MIN(size_error + shape_error) AS score FROM pair GROUP BY case_id, variant, solid_id, other)"""


def partners(fx):
    return shared(fx, "partners", lambda: cut(matching.best_partner(extra(fx, "fx_solid"))))


@query("j16_best_partner", f"WITH {_PARTNER} SELECT case_id, variant, solid_id, other, {grid_sql('score', 100000)} AS score FROM best")
def _(fx):
    return partners(fx).select(
        "case_id", "variant", "solid_id", "other", grid(F.col("size_error") + F.col("shape_error"), 100000).alias("score"))


_ERRORS = [f"{name}_{stat}" for name in ("size_error", "shape_error") for stat in ("p50", "p95", "max")]
_ERROR_SQL = [{"p50": "quantile_cont({e}, 0.5)", "p95": "quantile_cont({e}, 0.95)", "max": "MAX({e})"}[c.rsplit("_", 1)[1]].format(e=c.rsplit("_", 1)[0]) for c in _ERRORS]


@query("a08_error_summary", f"""WITH pair AS (
  SELECT a.case_id, a.variant, a.solid_id, b.variant AS other, b.solid_id AS partner, a.strict = b.strict AS same_strict,
         ABS(a.char_length - b.char_length) / GREATEST(a.char_length, b.char_length) AS size_error,
         GREATEST(ABS(a.sphericity - b.sphericity), ABS(a.j1 - b.j1), ABS(a.j2 - b.j2), ABS(a.j3 - b.j3)) AS shape_error
  FROM fx_solid a JOIN fx_solid b ON a.case_id = b.case_id AND a.variant < b.variant),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, variant, solid_id, other ORDER BY size_error + shape_error, partner) AS rn FROM pair)
SELECT COUNT(*) AS pairs, COUNT(*) FILTER (WHERE same_strict) AS strict_agree, {", ".join(f"{grid_sql(e, 100000)} AS {c}" for c, e in zip(_ERRORS, _ERROR_SQL))}
FROM best WHERE rn = 1""")
def _(fx):
    return matching.error_summary(partners(fx)).select("pairs", "strict_agree", *[grid(c, 100000).alias(c) for c in _ERRORS])


@query("j15_reconcile", """
WITH l AS (SELECT team_id AS file_id, part_number AS label, s.volume, s.fingerprint FROM fx_part p JOIN fx_shape s ON s.fingerprint = p.fingerprint),
n AS (SELECT file_id, COUNT(*) AS n, COUNT(DISTINCT fingerprint) AS k FROM l GROUP BY file_id)
SELECT file_id, n AS left_solids, n AS right_solids, k AS left_shapes, (SELECT COUNT(*) FROM l x WHERE x.file_id = n.file_id AND NOT ends_with(x.label, '7')) AS least_recovered,
  NOT EXISTS (SELECT 1 FROM l x WHERE x.file_id = n.file_id AND ends_with(x.label, '7')
     AND NOT EXISTS (SELECT 1 FROM l y WHERE y.file_id = n.file_id AND NOT ends_with(y.label, '7') AND contains('exp ' || y.label || ' v2', x.label))) AS agree
FROM n""")
def _(fx):
    left = fx.part.join(fx.shape.select("fingerprint", "volume"), "fingerprint").select(
        F.col("team_id").alias("file_id"), F.col("part_number").alias("label"), "volume", F.col("fingerprint").alias("shape_key"))
    lost = F.col("label").endswith("7")
    right = left.withColumn("label", F.when(lost, "solid").otherwise(F.concat(F.lit("exp "), F.col("label"), F.lit(" v2"))))
    kept = left.groupBy("file_id").agg(F.count_if(~lost).alias("least_recovered"))
    return matching.reconcile(left, right).join(kept, "file_id").select(
        "file_id", "left_solids", "right_solids", "left_shapes", "least_recovered", "agree")
