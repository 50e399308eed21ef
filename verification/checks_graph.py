"""Walks over the product graph and the totals built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions.ranking import rank_within
from partloom.operators import graph, rollup

from .registry import grid, grid_sql, query

_DOWN = """
WITH RECURSIVE walk(rev, depth, path, qty) AS (
  SELECT r.revision_id, 0, p.part_number, CAST(1 AS BIGINT) FROM fx_revision r JOIN fx_part p ON p.part_id = r.part_id
  WHERE r.revision_id = (SELECT MAX(revision_id) FROM fx_revision WHERE part_id = 0)
  UNION ALL
  SELECT o.child_rev, w.depth + 1, w.path || '/' || o.instance_name, w.qty * o.quantity
  FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev
)"""


@query("g01_explosion", _DOWN + """
SELECT w.depth, w.path, p.part_number, r.revision_id, r.revision_index, p.team_id, w.qty AS quantity, r.is_assembly,
       COALESCE(s.volume_exact, s.volume) * r.density AS mass_g
FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_part p ON p.part_id = r.part_id
LEFT JOIN fx_shape s ON s.fingerprint = r.fingerprint""")
def _(fx):
    return graph.explode_structure(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape).drop("root_rev")


@query("g02_quantities", _DOWN + """
SELECT rev AS revision_id, CAST(SUM(qty) AS BIGINT) AS quantity FROM walk GROUP BY rev""")
def _(fx):
    return graph.quantities(fx.top_root, fx.occurrence).drop("root_rev")


@query("g02_quantities_of_all", """
WITH RECURSIVE way(root_rev, revision_id, n) AS (
  SELECT revision_id, revision_id, CAST(1 AS BIGINT) FROM fx_revision WHERE is_assembly = 1
  UNION ALL SELECT w.root_rev, o.child_rev, w.n * o.quantity FROM fx_occurrence o JOIN way w ON w.revision_id = o.parent_rev
) SELECT root_rev, revision_id, CAST(SUM(n) AS BIGINT) AS quantity FROM way GROUP BY root_rev, revision_id""")
def _(fx):
    return graph.quantities(fx.revision.filter("is_assembly = 1").select(F.col("revision_id").alias("root_rev")), fx.occurrence)


@query("a01_bill_of_materials", _DOWN + """
SELECT p.part_number, p.team_id, r.revision_id, r.revision_index, CAST(SUM(w.qty) AS BIGINT) AS total_qty,
       COALESCE(s.volume_exact, s.volume) * r.density AS unit_mass_g,
       CAST(SUM(w.qty) AS BIGINT) * (COALESCE(s.volume_exact, s.volume) * r.density) AS total_mass_g
FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_part p ON p.part_id = r.part_id
LEFT JOIN fx_shape s ON s.fingerprint = r.fingerprint
WHERE r.is_assembly = 0
GROUP BY p.part_number, p.team_id, r.revision_id, r.revision_index, s.volume_exact, s.volume, r.density""")
def _(fx):
    return rollup.bill_of_materials(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape).drop("root_rev")


@query("g03_configuration", """
WITH RECURSIVE walk(rev, depth, path, qty, x, y, turn, parent_rev, instance_name) AS (
  SELECT r.revision_id, 0, p.part_number, CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT),
         CAST(NULL AS BIGINT), ''
  FROM fx_revision r JOIN fx_part p ON p.part_id = r.part_id
  WHERE r.revision_id = (SELECT MAX(revision_id) FROM fx_revision WHERE part_id = 0)
  UNION ALL
  SELECT o.child_rev, w.depth + 1, w.path || '/' || o.instance_name, w.qty * o.quantity,
         w.x + CASE w.turn WHEN 0 THEN o.tx WHEN 1 THEN -o.ty WHEN 2 THEN -o.tx ELSE o.ty END,
         w.y + CASE w.turn WHEN 0 THEN o.ty WHEN 1 THEN o.tx WHEN 2 THEN -o.ty ELSE -o.tx END,
         (w.turn + o.quarter_turns) % 4, w.rev, o.instance_name
  FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev
)
SELECT w.path, w.rev AS revision_id, w.qty AS quantity, w.parent_rev, w.instance_name, p.team_id, r.is_assembly,
       CAST(w.x AS BIGINT) AS x, CAST(w.y AS BIGINT) AS y, w.turn
FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_part p ON p.part_id = r.part_id""")
def _(fx):
    c = graph.configuration(fx.top_root, fx.occurrence, fx.revision, fx.part)
    turn = (F.when(F.col("m00") == 1, 0).when(F.col("m10") == 1, 1).when(F.col("m00") == -1, 2).otherwise(3)).cast("bigint")
    return c.select("path", "revision_id", "quantity", "parent_rev", "instance_name", "team_id", "is_assembly",
                    F.col("m03").cast("bigint").alias("x"), F.col("m13").cast("bigint").alias("y"), turn.alias("turn"))


# Every pair of a holder and what it holds at any depth; then the top's own pieces and the top itself.
_REACH = """
WITH RECURSIVE held(holder, piece) AS (
  SELECT parent_rev, child_rev FROM fx_occurrence
  UNION SELECT h.holder, o.child_rev FROM fx_occurrence o JOIN held h ON h.piece = o.parent_rev
), top AS (SELECT MAX(revision_id) AS id FROM fx_revision WHERE part_id = 0),
inside AS (SELECT id AS rev FROM top UNION SELECT piece FROM held JOIN top ON holder = id)"""


@query("g04_reachable", _REACH + " SELECT rev AS revision_id FROM inside")
def _(fx):
    return graph.reachable(fx.top_root, fx.occurrence).select("revision_id")


# Every holder of a revision with each distance at which it holds it.
_HOLDERS = """far(holder, piece, steps) AS (
  SELECT parent_rev, child_rev, 1 FROM fx_occurrence
  UNION SELECT o.parent_rev, f.piece, f.steps + 1 FROM fx_occurrence o JOIN far f ON f.holder = o.child_rev
), users AS (SELECT s.part_id AS source_part, holder AS revision_id, MIN(steps) AS depth FROM far JOIN fx_revision s ON s.revision_id = piece GROUP BY ALL)"""


@query("g05_where_used", f"""WITH RECURSIVE {_HOLDERS}
SELECT source_part, revision_id, depth, r.revision_index, r.part_id, p.part_number, p.team_id
FROM users JOIN fx_revision r USING (revision_id) JOIN fx_part p ON p.part_id = r.part_id""")
def _(fx):
    return graph.where_used(fx.part, fx.occurrence, fx.revision, fx.part)


@query("g05_where_used_live", f"{_REACH}, {_HOLDERS} SELECT source_part, revision_id, depth FROM users WHERE revision_id IN (SELECT rev FROM inside)")
def _(fx):
    return graph.where_used(fx.part, fx.occurrence, fx.revision, fx.part, fx.live).select(
        "source_part", "revision_id", "depth")


@query("g06_cycle_test", """
WITH RECURSIVE ask AS (
  SELECT p.part_id AS edge_id, p.part_id * 10 + 1 AS parent_rev,
         CASE WHEN p.part_id % 2 = 0 THEN CAST(FLOOR((p.part_id - 1) / 4) * 10 + 1 AS BIGINT) ELSE p.part_id * 10 + 1 END AS child_rev FROM fx_part p WHERE p.part_id > 0
), down(goal, start, rev) AS (
  SELECT DISTINCT child_rev, child_rev, child_rev FROM ask
  UNION
  SELECT d.goal, d.start, o.child_rev FROM down d JOIN fx_occurrence o ON o.parent_rev = d.rev
)
SELECT a.edge_id, a.parent_rev, a.child_rev, d.rev IS NOT NULL AS closes_cycle FROM ask a LEFT JOIN down d ON d.start = a.child_rev AND d.rev = a.parent_rev""")
def _(fx):
    ask = fx.part.filter("part_id > 0").selectExpr(
        "part_id AS edge_id", "part_id * 10 + 1 AS parent_rev",
        "CASE WHEN part_id % 2 = 0 THEN CAST(FLOOR((part_id - 1) / 4) * 10 + 1 AS BIGINT) ELSE part_id * 10 + 1 END AS child_rev")
    return graph.cycle_test(ask, fx.occurrence)


@query("g06_cycle_audit", """
WITH RECURSIVE e AS (
  SELECT parent_rev, child_rev FROM fx_occurrence
  UNION ALL SELECT part_id * 10 + 1, FLOOR((part_id - 1) / 4) * 10 + 1 FROM fx_proposal
), walk(start, rev) AS (
  SELECT e.parent_rev, e.child_rev FROM e
  JOIN (SELECT part_id * 10 + 1 AS s FROM fx_proposal UNION SELECT CAST(FLOOR((part_id - 1) / 4) * 10 + 1 AS BIGINT) FROM fx_proposal) q
    ON q.s = e.parent_rev
  UNION
  SELECT w.start, e.child_rev FROM walk w JOIN e ON e.parent_rev = w.rev
)
SELECT DISTINCT CAST(start AS BIGINT) AS revision_id FROM walk WHERE start = rev""")
def _(fx):
    back = fx.proposal.selectExpr("part_id * 10 + 1 AS parent_rev",
                                  "CAST(FLOOR((part_id - 1) / 4) * 10 + 1 AS BIGINT) AS child_rev")
    return graph.cyclic_nodes(fx.occurrence.select("parent_rev", "child_rev").unionByName(back))


_ROLL = """
WITH RECURSIVE walk(root, rev, qty, x, y, turn) AS (
  SELECT r.revision_id, r.revision_id, CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT)
  FROM fx_revision r
  UNION ALL
  SELECT w.root, o.child_rev, w.qty * o.quantity,
         w.x + CASE w.turn WHEN 0 THEN o.tx WHEN 1 THEN -o.ty WHEN 2 THEN -o.tx ELSE o.ty END,
         w.y + CASE w.turn WHEN 0 THEN o.ty WHEN 1 THEN o.tx WHEN 2 THEN -o.ty ELSE -o.tx END,
         (w.turn + o.quarter_turns) % 4
  FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev
), leaf AS (
  SELECT w.root, w.qty, w.x + CASE w.turn WHEN 0 THEN s.com_x WHEN 1 THEN -s.com_y WHEN 2 THEN -s.com_x ELSE s.com_y END AS x,
         w.y + CASE w.turn WHEN 0 THEN s.com_y WHEN 1 THEN s.com_x WHEN 2 THEN -s.com_y ELSE -s.com_x END AS y, s.com_z AS z,
         COALESCE(COALESCE(s.volume_exact, s.volume) * r.density, 0) AS m,
         CASE WHEN c.revision_id IS NULL THEN 0 ELSE r.part_id % 8 END AS power,
         CASE WHEN c.revision_id IS NULL THEN 0 ELSE r.part_id % 5 END AS thermal
  FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_shape s ON s.fingerprint = r.fingerprint
  LEFT JOIN fx_contract c ON c.revision_id = r.revision_id
)"""


@query("a02_rollup", _ROLL + f"""
SELECT r.revision_id, {grid_sql('COALESCE(SUM(qty * m), 0)', 100)} AS mass_cg,
       CAST(COALESCE(SUM(qty * power), 0) AS BIGINT) AS power_w, CAST(COALESCE(SUM(qty * thermal), 0) AS BIGINT) AS thermal_w,
       {grid_sql('CASE WHEN SUM(qty * m) > 0 THEN SUM(qty * m * x) / SUM(qty * m) END')} AS cg_x,
       {grid_sql('CASE WHEN SUM(qty * m) > 0 THEN SUM(qty * m * y) / SUM(qty * m) END')} AS cg_y,
       {grid_sql('CASE WHEN SUM(qty * m) > 0 THEN SUM(qty * m * z) / SUM(qty * m) END')} AS cg_z
FROM fx_revision r LEFT JOIN leaf l ON l.root = r.revision_id GROUP BY r.revision_id""")
def _(fx):
    r = rollup.rollup(fx.occurrence, fx.revision, fx.shape, fx.contract)
    return r.select("revision_id", grid("mass_g", 100).alias("mass_cg"), F.col("power_w").cast("bigint").alias("power_w"),
                    F.col("thermal_w").cast("bigint").alias("thermal_w"), *[grid(f"cg_{a}").alias(f"cg_{a}") for a in "xyz"])


@query("a02_without_density", _REACH + """
SELECT DISTINCT p.part_number FROM inside d JOIN fx_revision r ON r.revision_id = d.rev JOIN fx_part p ON p.part_id = r.part_id
WHERE r.is_assembly = 0 AND r.density IS NULL""")
def _(fx):
    return rollup.without_density(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape, fx.contract).drop("root_rev")


@query("a13_heights", """
WITH RECURSIVE up(rev, h) AS (
  SELECT r.revision_id, 0 FROM fx_revision r WHERE r.is_assembly = 0
  UNION
  SELECT o.parent_rev, u.h + 1 FROM up u JOIN fx_occurrence o ON o.child_rev = u.rev
)
SELECT rev AS revision_id, MAX(h) AS height FROM up GROUP BY rev""")
def _(fx):
    return graph.heights(fx.revision, fx.occurrence)


@query("t01_explosion_order", _DOWN + """
SELECT path, ROW_NUMBER() OVER (ORDER BY path) AS position FROM walk""")
def _(fx):
    rows = graph.explode_structure(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape)
    return rank_within(rows.select("root_rev", "path"), ["root_rev"], ["path"], "position").drop("root_rev")


@query("u01_union_of_steps", _DOWN + " SELECT depth, COUNT(*) AS rows, CAST(SUM(qty) AS BIGINT) AS pieces FROM walk GROUP BY depth")
def _(fx):
    rows = graph.explode_structure(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape)
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("pieces"))


@query("u02_distinct_steps", """
WITH RECURSIVE down(root, rev) AS (
  SELECT revision_id, revision_id FROM fx_revision
  UNION
  SELECT d.root, o.child_rev FROM down d JOIN fx_occurrence o ON o.parent_rev = d.rev
) SELECT root AS root_rev, COUNT(*) AS revisions FROM down GROUP BY root""")
def _(fx):
    every = graph.reachable(fx.revision.select(F.col("revision_id").alias("root_rev")), fx.occurrence)
    return every.groupBy("root_rev").agg(F.count(F.lit(1)).alias("revisions"))
