import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from partloom.functions import cluster, fits, geometry as g, pose, registration
from partloom.operators import contracts, features, interference, matching, shapes, sockets

TRI = "fingerprint string, " + ", ".join(f"{k}{x} double" for k in "abc" for x in "xyz")
BOX = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def mesh(spark, name, corners, faces):
    return spark.createDataFrame([(name, *[float(v) for i in f for v in corners[i]]) for f in faces], TRI)


def box(dx, dy, dz):
    return [(x * dx, y * dy, z * dz) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]


def test_box_moments_in_closed_form(spark):
    m = shapes.moments(mesh(spark, "b", box(20, 30, 10), BOX)).select("*", *[c.alias(f"i_{k}") for k, c in g.inertia().items()]).first()
    assert abs(m.volume - 6000) < 1e-9 and (round(m.com_x, 9), round(m.com_y, 9), round(m.com_z, 9)) == (10, 15, 5)
    # The tensor's own moments: V(dy^2+dz^2)/12 and so on, and no third moments.
    assert np.allclose([m.i_xx, m.i_yy, m.i_zz], [500000.0, 250000.0, 650000.0])
    assert all(abs(m[f"t_{k}"]) < 1e-6 for k in g.THIRD) and m.closed


def wedge(mirror=1.0):
    """A tetrahedron without symmetry, and its mirror image."""
    c = [(0, 0, 0), (11 * mirror, 0, 0), (2 * mirror, 9, 0), (1 * mirror, 2, 8)]
    f = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2)]
    return c, (f if mirror > 0 else [(a, c_, b) for a, b, c_ in f])


def test_handedness_flips_under_reflection_and_survives_rotation(spark):
    c, f = wedge()
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    turned = [tuple(q @ np.array(p) + [100, -50, 7]) for p in c]
    t = mesh(spark, "right", c, f).unionByName(mesh(spark, "turned", turned, f)).unionByName(mesh(spark, "left", *wedge(-1.0)))
    hand = {r.fingerprint: r.handedness for r in shapes.principal_frames(shapes.moments(t), t).collect()}
    assert hand["right"] == hand["turned"] == -hand["left"] != 0


def test_square_plate_is_told_from_a_round_one(spark):
    n = 720
    ring = [(10 * math.cos(2 * math.pi * k / n), 10 * math.sin(2 * math.pi * k / n), z) for z in (0, 2) for k in range(n)] + [(0, 0, 0), (0, 0, 2)]
    faces = [f for k in range(n) for f in ((k, 2 * n, (k + 1) % n), (n + k, n + (k + 1) % n, 2 * n + 1), (k, (k + 1) % n, n + k), ((k + 1) % n, n + (k + 1) % n, n + k))]
    t = mesh(spark, "round", ring, faces).unionByName(mesh(spark, "square", box(20, 20, 2), BOX))
    f = {r.fingerprint: r for r in shapes.principal_frames(shapes.moments(t), t).collect()}
    assert f["round"]["round"] and not f["square"]["round"]


def test_pose_keys_and_inverse(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(50):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        rows.append((i, *[float(v) for v in np.hstack([q, rng.normal(size=(3, 1)) * 50]).reshape(-1)]))
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in pose.COLUMNS))
    back = df.select("id", *pose.COLUMNS, *pose.invert(out="i_")).select(*pose.compose("", "i_"))
    eye = np.eye(4)[:3].reshape(-1)
    assert max(np.abs(np.array(r) - eye).max() for r in back.collect()) < 1e-9
    keyed = pose.with_pose_key(df)
    shaken = pose.with_pose_key(df.select("id", *[(F.col(c) + 1e-9).alias(c) for c in pose.COLUMNS]))
    same = keyed.select("id", "transform_key").join(shaken.select("id", F.col("transform_key").alias("k")), "id").filter("transform_key = k").count()
    assert same >= 48  # a grid has boundaries; nearly all keys must hold


def test_assignment_and_registration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(cost[np.arange(n), registration.assign(cost)].sum() - best) < 1e-6
    p = rng.random((5, 3)) * 40
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = (p @ q.T + 3)[rng.permutation(5)]
    assert registration.register(p, moved)[0] < 1e-9 and not registration.register(p, moved)[1]
    rmsd, mirrored = registration.register(p, p * [1, 1, -1])
    assert rmsd > 1e-3 and mirrored
    for n in (6, 12, 48, 96):
        a = np.array([[30 * math.cos(t), 30 * math.sin(t), 0] for t in np.arange(n) * 2 * math.pi / n])
        assert registration.register(a, (a @ q.T)[rng.permutation(n)])[0] < 1e-9
        assert abs(registration.register(a, a * 1.01)[0] - 0.3) < 1e-9


def test_registration_equals_all_orderings():
    rng = np.random.default_rng(1)
    for k in range(120):
        n = int(rng.integers(2, 7))
        p = rng.normal(size=(n, 3)) * 20 * ([1, 1, 0] if k % 3 == 0 else [1, 1, 1])
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        moved = (p @ q.T + rng.normal(size=3))[rng.permutation(n)] + rng.normal(size=(n, 3)) * [0, 0.01, 0.3][k % 3]
        orders = np.array(list(itertools.permutations(range(n))))
        rmsd, mirrored = registration.residuals(p - p.mean(0), (moved - moved.mean(0))[orders])
        got = registration.register(p, moved)
        assert abs(got[0] - rmsd.min()) < 1e-7
        assert got[1] == mirrored[rmsd < rmsd.min() + 1e-9].all()


def test_rows_of_patterns_are_compared_together():
    a, b = [0.0, 0, 0, 10, 0, 0, 0, 20, 0], [5.0, 5, 5]
    rmsd, mirrored, miss = registration.compare([a, a, None, b, []], [a, [x + 1.0 for x in a], None, b, []], [a, a, a, b, []])
    assert rmsd[:2].max() < 1e-9 and np.isnan(rmsd[[2, 4]]).all() and rmsd[3] == 0
    assert miss[0] == 0 and abs(miss[1] - math.sqrt(3)) < 1e-12 and not mirrored.any()


def test_first_come_groups_equal_the_sequential_rule(spark):
    rng = random.Random(2)
    rows = [("s" + str(i % 2), i, rng.choice([0.0, 0.4, 0.9, 1.3, 2.1, 5.0]) + rng.random() * 0.3) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, x double")
    got = cluster.leaders(df, "g", "o", [("x", 0.5)], lambda a, b: F.abs(F.col(a + "x") - F.col(b + "x")) <= 0.5)
    want, founders = {}, {}
    for s, i, x in rows:
        hit = next((f for f in founders.setdefault(s, []) if abs(f[1] - x) <= 0.5), None)
        if hit is None:
            founders[s].append((i, x))
        want[i] = (hit or (i, x))[0]
    assert {r.o: r.leader for r in got.collect()} == want


def test_hole_layout_hand(spark):
    pts = [(0, 0, 0, 1.0), (10, 0, 1, 2.0), (0, 7, 3, 3.0), (4, 5, 9, 4.0)]
    rows = [(n, str(i), x * s, y, z, r, 5.0) for n, s in (("right", 1.0), ("left", -1.0)) for i, (x, y, z, r) in enumerate(pts)]
    bore = spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in rows], "fingerprint string, bore_id string, qx double, qy double, qz double, radius double, depth double")
    centre = spark.createDataFrame([("right", 3.0, 3.0, 3.0), ("left", -3.0, 3.0, 3.0), ("bare", 0.0, 0.0, 0.0)], "fingerprint string, com_x double, com_y double, com_z double")
    hand = {r.fingerprint: r.feature_chirality for r in features.feature_chirality(bore, centre).collect()}
    assert hand["right"] == -hand["left"] != 0 and hand["bare"] == 0


def test_box_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        size = rng.choice([1, 4, 40])
        lo = [rng.uniform(-60, 60) for _ in range(3)]
        rows.append(("r" + str(i % 2), f"p{i:03d}", "n", "t", *lo, *[v + rng.uniform(0.2, 1) * size for v in lo]))
    df = spark.createDataFrame(rows, "root_rev string, path string, part_number string, team_id string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    for clear in (0.0, 3.0):
        want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and all(min(a[7 + k], b[7 + k]) - max(a[4 + k], b[4 + k]) > -clear for k in range(3))}
        got = [(r.path_a, r.path_b) for r in interference.overlapping_pairs(df, clear).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_clash_sentences(spark):
    df = spark.createDataFrame([("clearance", 3.5), ("clearance", -1.25), ("clash", 0.0)], "kind string, depth double").select(
        "*", *[F.lit(x).alias(x) for x in ("path_a", "path_b", "part_a", "part_b", "team_a", "team_b")], F.lit(12.0).alias("volume"))
    a, b, c = [r.description for r in interference.describe(df).collect()]
    assert "reach 3.50" in a and "1.25 mm apart" in b and "12.0 mm^3" in c


def test_best_partner_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [("case" + str(i % 2), "ab"[i % 4 > 1], f"s{i}", f"h{i}", math.exp(rng.uniform(0, 3)), 0, *[rng.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "case_id string, variant string, solid_id string, strict string, char_length double, chirality int, sphericity double, j1 double, j2 double, j3 double")
    err = lambda x, y: (abs(x[4] - y[4]) / max(x[4], y[4]), max(abs(x[k] - y[k]) for k in range(6, 10)))
    want = {x[2]: min(sum(err(x, y)) for y in rows if y[0] == x[0] and y[1] == "b") for x in rows if x[1] == "a"}
    got = {r.solid_id: r.size_error + r.shape_error for r in matching.best_partner(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_solids_without_a_size_have_no_partner(spark):
    rows = [("c", "a", "s1", "h", 1.0, 0, 0.5, 0.5, 0.5, None), ("c", "a", "s2", "h", -1.0, 0, 0.5, 0.5, 0.5, 0.5), ("c", "a", "s3", "h", 1.0, 0, 0.5, 0.5, 0.5, 0.5),
            ("c", "b", "t1", "h", 1e30, 0, 0.5, 0.5, 9e6, 0.5), ("c", "b", "t2", "h", None, 0, 0.5, 0.5, 0.5, 0.5), ("d", "a", "u1", "h", 1.0, 0, 0.5, 0.5, 0.5, 0.5), ("d", "b", "u2", "h", 0.0, 0, 0.5, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "case_id string, variant string, solid_id string, strict string, char_length double, chirality int, sphericity double, j1 double, j2 double, j3 double")
    assert {r.solid_id: r.partner for r in matching.best_partner(df).collect()} == {"s1": None, "s2": None, "s3": "t1", "u1": None}


def test_fit_classes(spark):
    rows = [("M6", "clearance", 3.3, True), ("M6", "clearance", 3.7, False), ("M6", "close", 3.3, True), ("M6", "press", 3.0, True),
            ("M6", "tapped", 2.5, True), ("M6", "tapped", 3.0, False), ("X9", "clearance", 9.0, True)]
    df = spark.createDataFrame(rows, "f string, c string, r double, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", fits.hole_accepts(F.col("f"), F.col("c"), F.col("r"))).collect())


def pattern_row(spark, move=(0, 0, 0), one=0.0, flip=1.0):
    pts = [(0.0, 0.0, 0.0), (40.0, 0.0, 0.0), (40.0, 30.0, 0.0), (0.0, 30.0, 0.0)]
    at = [tuple(v + m for v, m in zip(p, move)) for p in pts]
    at[2] = (at[2][0] + one, *at[2][1:])
    cols = {"s_points": at, "i_points": pts}
    df = spark.createDataFrame([(cols["s_points"], cols["i_points"])], "s_points array<struct<x:double,y:double,z:double>>, i_points array<struct<x:double,y:double,z:double>>")
    lit = dict(s_hole_count=4, i_hole_count=4, s_hole_radius=3.3, i_hole_radius=3.3, s_fastener="M6", i_fastener="M6", s_fit_class="clearance", i_fit_class="clearance",
               s_radius_tol=0.2, s_spacing_tol=0.2, i_spacing_tol=0.1, s_nx=0.0, s_ny=0.0, s_nz=flip, i_nx=0.0, i_ny=0.0, i_nz=-1.0)
    null = [f"s_allow_d{a}" for a in "xyz"] + [f"bbox_{a}{e}" for a in "xyz" for e in ("min", "max")]
    return df.select("*", *[F.lit(v).alias(k) for k, v in lit.items()], *[F.lit(None).cast("double").alias(k) for k in null], *pose.identity())


def test_socket_steps_name_the_right_failure(spark):
    step = lambda **k: sockets.match_steps(pattern_row(spark, **k)).first()
    good = step()
    assert all(good[s] for s in sockets.STEPS)
    moved = step(one=2.0)
    assert not moved.pattern
    shifted = step(move=(2.0, 0.0, 0.0))
    assert [s for s in sockets.STEPS if not shifted[s]] == ["alignment"] and abs(shifted.miss - 2.0) < 1e-9 and abs(shifted.allowance - 0.6) < 1e-9
    assert [s for s in sockets.STEPS if not step(flip=-1.0)[s]] == ["orientation"]


def test_contract_hash_ignores_order_and_metadata(spark):
    iface = "revision_id string, name string, kind string, hole_count int, hole_radius double, fastener string, fit_class string, points array<struct<x:double,y:double,z:double>>, nx double, ny double, nz double"
    row = lambda n, r=3.3: ("r1", n, "bolt_pattern", 1, r, "M6", "clearance", [(0.0, -0.0, 0.001)], 0.0, 0.0, 1.0)
    sock = spark.createDataFrame([], iface + ", fills string, interface_name string")
    dim = spark.createDataFrame([], "revision_id string, name string, nominal double, tol_plus double, tol_minus double, sigma_span double, distribution string")
    head = lambda note: spark.createDataFrame([("r1", 5.0, "{}", note)], "revision_id string, mass_max double, attributes string, metadata string")
    h = lambda rows, note="": contracts.contract_hash(head(note), spark.createDataFrame(rows, iface), sock, dim).first().contract_hash
    assert h([row("a"), row("b")]) == h([row("b"), row("a")], "supplier changed") != h([row("a"), row("b", 3.4)])
