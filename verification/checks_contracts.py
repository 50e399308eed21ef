"""Interfaces, sockets, budgets and interference."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import fits, geometry
from partloom.operators import contracts, features, graph, interference, lookup, rollup, sockets
from partloom.session import cut

from .checks_graph import _ROLL
from .checks_shapes import bores
from .registry import extra, grid, grid_sql, query, shared

_WALK = """
WITH RECURSIVE walk(rev, path, x, y, turn) AS (
  SELECT MAX(revision_id), '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM fx_revision WHERE part_id = 0
  UNION ALL
  SELECT o.child_rev, CASE WHEN w.path = '' THEN o.instance_name ELSE w.path || '/' || o.instance_name END,
         w.x + CASE w.turn WHEN 0 THEN o.tx WHEN 1 THEN -o.ty WHEN 2 THEN -o.tx ELSE o.ty END,
         w.y + CASE w.turn WHEN 0 THEN o.ty WHEN 1 THEN o.tx WHEN 2 THEN -o.ty ELSE -o.tx END,
         (w.turn + o.quarter_turns) % 4
  FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev
)"""


@query("j09_instance_lookup", _WALK + " SELECT path AS ask_id, rev AS revision_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM walk")
def _(fx):
    c = placed(fx)
    asked = c.select(F.col("rel_path").alias("ask_id"), "root_rev", F.col("rel_path").alias("path"))
    at = contracts.find_instances(asked, fx.occurrence, fx.revision, fx.part)
    return at.select("ask_id", "revision_id", F.col("m03").cast("bigint").alias("x"), F.col("m13").cast("bigint").alias("y"))


def full_sockets(fx):
    """The fixture sockets with patterns read off what fills them, some of them made wrong."""
    def build():
        e = fx.occurrence.withColumn("name", F.concat(F.lit("s-"), F.col("instance_name"))).withColumnRenamed("parent_rev", "revision_id")
        i = fx.full_interface.select(F.col("revision_id").alias("child_rev"), F.col("points").alias("own"))
        s = extra(fx, "fx_socket").join(e, ["revision_id", "name"]).join(i, "child_rev")
        k = F.col("filler_part")
        placed = contracts.move_points(F.col("own"))
        shift = F.when(k % 7 == 3, 2.0).otherwise(0.0)
        pts = F.transform(placed, lambda p, n: F.struct(
            (p["x"] + shift + F.when((k % 7 == 5) & (n == 0), 2.0).otherwise(0.0)).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
        allow = F.when(k % 10 == 7, 15.0)
        return cut(s.select(
            "socket_id", "revision_id", "name", "kind", "filler_part", "fills", "interface_name", "hole_count", "hole_radius", "fastener", "fit_class",
            "radius_tol", "spacing_tol", "mass_budget", "power_budget", "thermal_budget", F.when(k % 9 != 1, pts).alias("points"),
            F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(k % 8 == 6, -1.0).otherwise(1.0).alias("nz"),
            *[allow.alias(f"allow_d{a}") for a in "xyz"]))
    return shared(fx, "sockets", build)


def filled(fx):
    return shared(fx, "filled", lambda: cut(sockets.targets(full_sockets(fx), fx.occurrence, fx.revision, fx.part)))


@query("j10_socket_fillers", """
SELECT s.socket_id, o.child_rev AS target_rev FROM fx_socket s JOIN fx_occurrence o ON o.parent_rev = s.revision_id AND o.instance_name = s.fills""")
def _(fx):
    return filled(fx).select("socket_id", "target_rev")


_OUT = """
SELECT socket_id, CASE WHEN filler_part % 11 = 0 THEN 'unfilled' WHEN filler_part % 9 = 1 THEN 'allocation' WHEN filler_part % 6 = 1 THEN 'no_interface' ELSE 'matched' END AS outcome,
  CASE WHEN filler_part % 11 = 0 OR filler_part % 9 = 1 OR filler_part % 6 = 1 THEN NULL WHEN filler_part % 9 = 0 OR filler_part % 7 = 5 THEN 'pattern'
       WHEN filler_part % 10 = 7 THEN 'envelope' WHEN filler_part % 7 = 3 THEN 'alignment' WHEN filler_part % 8 = 6 THEN 'orientation' END AS failed_step FROM fx_socket"""


def socket_results(fx):
    return shared(fx, "socket_results", lambda: cut(sockets.check_sockets(
        full_sockets(fx), fx.full_interface, fx.occurrence, fx.revision, fx.part, fx.shape)))


@query("c05_socket_check", f"""
SELECT socket_id, outcome, failed_step, outcome IN ('allocation', 'matched') AND failed_step IS NULL AS passed FROM ({_OUT}) t""")
def _(fx):
    return socket_results(fx).select("socket_id", "outcome", "failed_step", "passed")


@query("w05_best_interface", f"SELECT socket_id, 'foot' AS interface FROM ({_OUT}) t WHERE outcome = 'matched'")
def _(fx):
    # A second interface that never fits must not win over the first.
    worse = fx.full_interface.withColumn("name", F.lit("a-small")).withColumn("hole_radius", F.lit(1.0)).withColumn("hole_count", F.lit(9))
    r = sockets.check_sockets(full_sockets(fx).withColumn("interface_name", F.when(F.col("interface_name") == "face", F.lit("face"))),
                              fx.full_interface.unionByName(worse), fx.occurrence, fx.revision, fx.part, fx.shape)
    return r.filter("outcome = 'matched'").select("socket_id", "interface")


@query("j11_derived_sockets", """
SELECT s.socket_id, i.hole_count, CAST(o.tx * 1000 + CASE o.quarter_turns WHEN 0 THEN i.w * 500 WHEN 1 THEN -i.h * 500 WHEN 2 THEN -i.w * 500 ELSE i.h * 500 END AS BIGINT) AS ox, '' AS problem
FROM fx_socket s JOIN fx_occurrence o ON o.parent_rev = s.revision_id AND 's-' || o.instance_name = s.name JOIN fx_interface i ON i.revision_id = o.child_rev
WHERE s.interface_name IS NULL OR s.interface_name = 'foot'
UNION ALL
SELECT s.socket_id, NULL, NULL, 'socket ''' || s.name || ''': ' || p.part_number || ' offers no interface called ''face'''
FROM fx_socket s JOIN fx_part p ON p.part_id = s.filler_part WHERE s.interface_name = 'face'""")
def _(fx):
    s = extra(fx, "fx_socket").withColumn("from_instance", F.substring("name", 3, 100)).withColumn("from_interface", F.coalesce("interface_name", F.lit("foot")))
    derived, problems = contracts.derive_sockets(s, fx.occurrence, fx.revision, fx.part, fx.full_interface)
    return derived.select("socket_id", "hole_count", F.round(F.col("ox") * 1000).cast("bigint").alias("ox"), F.lit("").alias("problem")).unionByName(
        problems.select("socket_id", F.lit(None).cast("int").alias("hole_count"), F.lit(None).cast("bigint").alias("ox"), "problem"))


_BUDGET = _ROLL + """, roll AS (SELECT root AS revision_id, SUM(qty * m) AS mass_g, SUM(qty * power) AS power_w, SUM(qty * thermal) AS thermal_w FROM leaf GROUP BY root),
tgt AS (SELECT s.*, o.child_rev AS target_rev FROM fx_socket s JOIN fx_occurrence o ON o.parent_rev = s.revision_id AND o.instance_name = s.fills)
SELECT c.revision_id, 'mass_max' AS constraint_name, COALESCE(r.mass_g, 0) <= c.mass_max + 1e-9 AS passed FROM fx_contract c LEFT JOIN roll r ON r.revision_id = c.revision_id
UNION ALL SELECT t.revision_id, 'socket.' || t.name || '.mass_budget', r.mass_g <= t.mass_budget + 1e-9 FROM tgt t JOIN roll r ON r.revision_id = t.target_rev WHERE t.mass_budget IS NOT NULL
UNION ALL SELECT t.revision_id, 'socket.' || t.name || '.power_budget', r.power_w <= t.power_budget + 1e-9 FROM tgt t JOIN roll r ON r.revision_id = t.target_rev WHERE t.power_budget IS NOT NULL
UNION ALL SELECT t.revision_id, 'socket.' || t.name || '.thermal_budget', r.thermal_w <= t.thermal_budget + 1e-9 FROM tgt t JOIN roll r ON r.revision_id = t.target_rev WHERE t.thermal_budget IS NOT NULL
UNION ALL SELECT c.revision_id, 'cg_window', c.revision_id % 3 = 0 FROM fx_contract c JOIN roll r ON r.revision_id = c.revision_id WHERE r.mass_g > 0 AND c.revision_id % 3 < 2"""


def windowed(fx):
    """Contracts of which a third declares a window around every centre of gravity, a third one far off."""
    box = lambda lo, hi: F.lit(f'{{"min": [{lo}, {lo}, {lo}], "max": [{hi}, {hi}, {hi}]}}')
    return fx.contract.withColumn("cg_window", F.when(F.col("revision_id") % 3 == 0, box("-1e12", "1e12")).when(F.col("revision_id") % 3 == 1, box("1e12", "2e12")))


def rollups(fx):
    return shared(fx, "rollups", lambda: cut(rollup.rollup(fx.occurrence, fx.revision, fx.shape, fx.contract)))


@query("c06_budget_check", _BUDGET)
def _(fx):
    s = full_sockets(fx)
    t = filled(fx)
    return sockets.check_budgets(windowed(fx), s, rollups(fx), t, fx.revision, fx.part).select("revision_id", "constraint_name", "passed")


# -- interfaces from geometry -----------------------------------------------------

def declarations(fx):
    null = F.lit(None).cast("double")
    return fx.shape.select(
        F.concat(F.lit("d-"), "fingerprint").alias("decl_id"), "fingerprint", F.lit("foot").alias("name"),
        F.when(F.col("chirality") == 0, "M8").otherwise("M6").alias("fastener"), F.lit("clearance").alias("fit_class"),
        F.lit(3.3).alias("radius"), F.lit(0.05).alias("radius_tol"), F.lit(4).alias("count"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(1.0).alias("az"),
        *[null.alias(c) for c in ("cx", "cy", "cz", "within")], F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"),
        F.when(F.col("chirality") < 0, -1.0).otherwise(1.0).alias("sz"), null.alias("seat_offset"))


@query("n07_located_patterns", f"""
SELECT 'd-' || fingerprint AS decl_id, CASE WHEN dx > 50 THEN 3 ELSE 4 END AS hole_count,
  {grid_sql('CASE WHEN dx > 50 THEN dx / 5 + dx / 6 ELSE dx / 5 + dx / 4 END')} AS ox, {grid_sql('CASE WHEN chirality < 0 THEN 0 ELSE dz END')} AS oz FROM fx_shape""")
def _(fx):
    plane = features.mounting_planes(extra(fx, "fx_face"))
    located, _, _ = contracts.locate_patterns(declarations(fx), bores(fx), plane)
    return located.select("decl_id", "hole_count", grid("ox").alias("ox"), grid("oz").alias("oz"))


@query("n08_contract_problems", """
SELECT 'd-' || fingerprint AS owner_id, 'interface ''foot'': 4 holes are declared, 3 lie along the body''s best axis' AS problem FROM fx_shape WHERE dx > 50
UNION ALL SELECT 'd-' || fingerprint, 'interface ''foot'': a 6.600 mm hole is wrong for M8, clearance: 8.10 to 9.60 mm' FROM fx_shape WHERE chirality = 0
UNION ALL SELECT 'd-' || fingerprint, 'envelope: measured z-size ' || printf('%.3f', dz) || ' mm, allowed are 10.000 mm' FROM fx_shape WHERE dz > 10""")
def _(fx):
    plane = features.mounting_planes(extra(fx, "fx_face"))
    env = fx.shape.select(F.concat(F.lit("d-"), "fingerprint").alias("owner_id"), "fingerprint", F.lit(1000.0).alias("allow_dx"),
                          F.lit(1000.0).alias("allow_dy"), F.lit(10.0).alias("allow_dz"))
    return contracts.derive_contracts(declarations(fx), bores(fx), plane, env, fx.shape)[1]


@query("n09_drafted_contracts", """
SELECT fingerprint, dx AS envelope_dx, 'pattern_1' AS name, 'M6' AS fastener, CASE WHEN dx > 50 THEN 3 ELSE 4 END AS count, 0 AS reviewed FROM fx_shape""")
def _(fx):
    pattern, _ = features.hole_patterns(bores(fx))
    contract, decl = contracts.draft_contracts(fx.shape, pattern)
    return contract.join(decl.select("fingerprint", "name", "fastener", "count"), "fingerprint").select(
        "fingerprint", "envelope_dx", "name", "fastener", "count", "reviewed")


@query("f09_contract_hash", """
WITH c AS (SELECT c.revision_id, CONCAT_WS('|', c.mass_max, c.attributes, i.hole_radius, i.fit_class, i.w) AS face FROM fx_contract c LEFT JOIN fx_interface i ON i.revision_id = c.revision_id)
SELECT revision_id, MIN(revision_id) OVER (PARTITION BY face) AS first_equal FROM c""")
def _(fx):
    none = full_sockets(fx).limit(0)
    dim = fx.spark.createDataFrame([], "revision_id bigint, name string, nominal double, tol_plus double, tol_minus double, sigma_span double, distribution string")
    h = contracts.contract_hash(fx.contract.drop("contract_hash"), fx.full_interface, none, dim)
    return h.join(h.groupBy("contract_hash").agg(F.min("revision_id").alias("first_equal")), "contract_hash").drop("contract_hash")


@query("s16_author_contracts", """
SELECT r.revision_id, r.revision_id * 1000 AS copied_to, i.name, i.hole_count, i.fastener FROM fx_interface i JOIN fx_contract r ON r.revision_id = i.revision_id""")
def _(fx):
    one = fx.full_interface.select("revision_id", F.array(F.struct("name", "kind", "hole_count", "hole_radius", "fastener", "fit_class", "points")).alias("interfaces"))
    null = [F.lit(None).cast("array<struct<name:string>>").alias(c) for c in ("sockets", "dimensions")]
    rows = contracts.author(fx.contract.join(one, "revision_id").select(*fx.contract.columns, "interfaces", *null))
    again = contracts.reload(rows["contract"], rows["interface"], rows["socket"], rows["dimension"])
    new = fx.revision.select(F.col("revision_id").alias("old_rev"), (F.col("revision_id") * 1000).alias("new_rev"))
    copied = contracts.copy_to(new, {"interface": again["interface"]})["interface"]
    return copied.select((F.col("revision_id") / 1000).cast("bigint").alias("revision_id"), F.col("revision_id").alias("copied_to"), "name", "hole_count", "fastener")


@query("f10_fastener_guess", """
SELECT revision_id, CASE WHEN 2 * hole_radius BETWEEN 6.1 AND 7.2 THEN 'M6' END AS guess, 2 * hole_radius BETWEEN 6.1 - 1e-9 AND CASE WHEN fit_class = 'close' THEN 6.6 ELSE 7.2 END + 1e-9 AS accepts FROM fx_interface""")
def _(fx):
    return fx.interface.select("revision_id", fits.guess_fastener(F.col("hole_radius")).alias("guess"), F.when(
        F.col("fit_class") == "close", fits.hole_accepts(F.col("fastener"), F.col("fit_class"), F.col("hole_radius"))).otherwise(
        fits.hole_accepts(F.col("fastener"), F.lit("clearance"), F.col("hole_radius"))).alias("accepts"))


@query("f11_fit_classes", """
SELECT i.revision_id, c.fit, CASE c.fit WHEN 'clearance' THEN 2 * hole_radius BETWEEN 6.1 - 1e-9 AND 7.2 + 1e-9 WHEN 'close' THEN 2 * hole_radius BETWEEN 6.05 - 1e-9 AND 6.6 + 1e-9
  WHEN 'press' THEN 2 * hole_radius BETWEEN 5.95 - 1e-9 AND 6.05 + 1e-9 ELSE 2 * hole_radius BETWEEN 4.68 - 1e-9 AND 5.52 + 1e-9 END AS accepts
FROM fx_interface i CROSS JOIN (SELECT unnest(['clearance', 'close', 'press', 'tapped']) AS fit) c""")
def _(fx):
    each = fx.interface.withColumn("fit", F.explode(F.array(*[F.lit(c) for c in fits.FIT_LIMITS])))
    return each.select("revision_id", "fit", fits.hole_accepts(F.col("fastener"), F.col("fit"), F.col("hole_radius")).alias("accepts"))


@query("f12_alignment_allowance", f"SELECT revision_id, {grid_sql('GREATEST(hole_radius - 3, 0) + 0.3')} AS allowance FROM fx_interface")
def _(fx):
    return fx.interface.select("revision_id", grid(fits.alignment_allowance(
        F.col("hole_radius"), F.lit(3.3), F.col("fastener"), F.col("fit_class"), F.lit("clearance"))).alias("allowance"))


@query("f13_pairwise_spacings", f"""
SELECT a.interface_id, COUNT(*) AS n, {grid_sql('MIN(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))')} AS least,
       {grid_sql('MAX(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))')} AS most
FROM fx_interface_point a JOIN fx_interface_point b ON a.interface_id = b.interface_id AND a.seq < b.seq GROUP BY a.interface_id""")
def _(fx):
    d = fx.full_interface.withColumn("d", geometry.pairwise_spacings(F.col("points")))
    return d.select("interface_id", F.size("d").alias("n"), grid(F.array_min("d")).alias("least"), grid(F.array_max("d")).alias("most"))


# -- interference -----------------------------------------------------------------

_BOX = """box AS (
  SELECT {root} AS root_rev, w.path, w.part_number, w.x + CASE w.turn WHEN 0 THEN 0 WHEN 1 THEN -s.dy WHEN 2 THEN -s.dx ELSE 0 END AS lx,
         w.y + CASE w.turn WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN -s.dy ELSE -s.dx END AS ly,
         CASE WHEN w.turn % 2 = 0 THEN s.dx ELSE s.dy END AS ex, CASE WHEN w.turn % 2 = 0 THEN s.dy ELSE s.dx END AS ey, s.dz AS ez
  FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_shape s ON s.fingerprint = r.fingerprint
  WHERE r.is_assembly = 0 AND w.part_number NOT LIKE 'BOLT%'),
pair AS (
  SELECT a.root_rev, a.path AS path_a, b.path AS path_b, LEAST(LEAST(a.lx + a.ex, b.lx + b.ex) - GREATEST(a.lx, b.lx), LEAST(a.ly + a.ey, b.ly + b.ey) - GREATEST(a.ly, b.ly), LEAST(a.ez, b.ez)) AS depth
  FROM box a JOIN box b ON a.root_rev = b.root_rev AND a.path < b.path
   AND LEAST(a.lx + a.ex, b.lx + b.ex) - GREATEST(a.lx, b.lx) > -{c} AND LEAST(a.ly + a.ey, b.ly + b.ey) - GREATEST(a.ly, b.ly) > -{c})"""


@query("j08_box_overlap", f"""
WITH walk AS (SELECT o.parent_rev, o.child_rev AS rev, p.part_number || '/' || o.instance_name AS path, q.part_number, o.tx AS x, o.ty AS y, o.quarter_turns AS turn
  FROM fx_occurrence o JOIN fx_revision r ON r.revision_id = o.parent_rev JOIN fx_part p ON p.part_id = r.part_id
  JOIN fx_revision k ON k.revision_id = o.child_rev JOIN fx_part q ON q.part_id = k.part_id),
{_BOX.format(root='w.parent_rev', c=5)} SELECT root_rev, path_a, path_b, CAST(depth AS BIGINT) AS depth FROM pair""")
def _(fx):
    # Direct children of every assembly, as configurations of depth one.
    number = fx.revision.select("revision_id", "part_id").join(fx.part.select("part_id", "part_number", "team_id"), "part_id")
    owner = number.select(F.col("revision_id").alias("parent_rev"), F.col("part_number").alias("head"))
    kid = number.select(F.col("revision_id").alias("child_rev"), "part_number", "team_id").join(
        fx.revision.select(F.col("revision_id").alias("child_rev"), "is_assembly", "fingerprint"), "child_rev")
    c = fx.occurrence.join(owner, "parent_rev").join(kid, "child_rev").withColumn("path", F.concat_ws("/", "head", "instance_name")).withColumnRenamed("parent_rev", "root_rev")
    boxes, _ = interference.placed_boxes(c, fx.shape)
    return interference.overlapping_pairs(boxes, 5.0).select("root_rev", "path_a", "path_b", F.col("depth").cast("bigint").alias("depth"))


_PLACED = _WALK + ", named AS (SELECT w.*, p.part_number FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_part p ON p.part_id = r.part_id), " + _BOX.format(root='0', c=0).replace("FROM walk w", "FROM named w")


def placed(fx):
    return shared(fx, "placed", lambda: cut(graph.configuration(fx.top_root, fx.occurrence, fx.revision, fx.part)))


@query("c04_interference_report", _PLACED + """
SELECT (SELECT CAST(COUNT(*) * (COUNT(*) - 1) / 2 AS BIGINT) FROM box) AS pairs_considered, COUNT(*) AS pairs_after_prefilter, 0 AS skipped FROM pair""")
def _(fx):
    return interference.check(placed(fx), fx.shape)[1].drop("root_rev")


@query("s11_worst_overlaps", _PLACED + """
SELECT depth, COUNT(*) AS pairs FROM pair GROUP BY depth""")
def _(fx):
    pairs, _ = interference.check(placed(fx), fx.shape)
    return pairs.groupBy("depth").agg(F.count(F.lit(1)).alias("pairs"))


@query("f17_placed_extents", _PLACED + " SELECT path, ex, ey, ez FROM box")
def _(fx):
    boxes, _ = interference.placed_boxes(placed(fx), fx.shape)
    head = lookup.first_seen(placed(fx)).filter("NOT first_path LIKE '%/%'").select(F.col("first_path").alias("head"))
    return boxes.join(head, F.substring_index("path", "/", 1) == F.col("head")).select(
        F.expr("substring(path, length(head) + 2)").alias("path"), (F.col("hi_x") - F.col("lo_x")).alias("ex"),
        (F.col("hi_y") - F.col("lo_y")).alias("ey"), (F.col("hi_z") - F.col("lo_z")).alias("ez"))


def _fits(fx):
    s = full_sockets(fx).filter("points IS NOT NULL")
    at = filled(fx)
    keep = ["points", "hole_count", "hole_radius", "fastener", "fit_class", "radius_tol", "spacing_tol", "nx", "ny", "nz"]
    i = fx.full_interface.select(F.col("revision_id").alias("target_rev"), *[F.col(c).alias(f"i_{c}") for c in keep])
    pair = s.select("socket_id", "filler_part", *[F.col(c).alias(f"s_{c}") for c in [*keep, "allow_dx", "allow_dy", "allow_dz"]]).join(at, "socket_id").join(i, "target_rev")
    bounds = fx.revision.select(F.col("revision_id").alias("target_rev"), "fingerprint").join(fx.shape.select("fingerprint", *[f"bbox_{a}{e}" for a in "xyz" for e in ("min", "max")]), "fingerprint")
    return shared(fx, "fits", lambda: cut(sockets.match_steps(pair.join(bounds.drop("fingerprint"), "target_rev", "left"))))


@query("n10_registration", """
SELECT s.socket_id, CASE WHEN s.filler_part % 7 = 5 THEN 'differs' ELSE 'same pattern' END AS fit
FROM fx_socket s JOIN fx_occurrence o ON o.parent_rev = s.revision_id AND o.instance_name = s.fills WHERE s.filler_part % 9 <> 1""")
def _(fx):
    return _fits(fx).select("socket_id", F.when(F.col("rmsd") < 1e-6, "same pattern").otherwise("differs").alias("fit"))


@query("n11_hole_assignment", f"""
SELECT s.socket_id, {grid_sql('CASE WHEN s.filler_part % 7 IN (3, 5) THEN 2 ELSE 0 END')} AS miss
FROM fx_socket s JOIN fx_occurrence o ON o.parent_rev = s.revision_id AND o.instance_name = s.fills WHERE s.filler_part % 9 <> 1""")
def _(fx):
    return _fits(fx).select("socket_id", grid("miss").alias("miss"))
