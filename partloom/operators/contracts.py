"""Published interfaces: locating declared patterns in geometry, deriving and drafting
contracts, reading sockets off siblings, and the contract hash."""

from __future__ import annotations

import math

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cluster, digest, fits, geometry as g, pose
from ..session import bucketed, cut
from . import features

# Angles that count as parallel, and the least area share of a seat.
SELECT_ANGLE = math.radians(2.0)
SEAT_ANGLE = math.radians(1.0)
SEAT_SHARE = 0.05
DRAFT_RADIUS_TOL = 0.05


def find_instances(asked: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    """asked(ask_id, root_rev, path) -> (ask_id, revision_id, pose): the revision an instance
    path leads to, placed in the root's frame. A segment matches the instance name, or
    the part number where the instance has no name. Unknown paths are left out.

    One join per path segment for all paths together.
    """
    number = rev.select(F.col("revision_id").alias("child_rev"), "part_id").join(part.select("part_id", "part_number"), "part_id")
    edges = bucketed(occ.join(number, "child_rev").select(
        F.col("parent_rev").alias("rev"), F.when(F.coalesce("instance_name", F.lit("")) != "", F.col("instance_name"))
        .otherwise(F.col("part_number")).alias("step"), "occurrence_id", "child_rev", *[F.col(c).alias(f"e_{c}") for c in pose.COLUMNS]), "rev", "step")
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    state = cut(asked.select("ask_id", F.col("root_rev").alias("rev"), steps.alias("steps")).select("*", *pose.identity()))
    found = []
    for k in count():  # a path has finitely many segments
        found.append(state.filter(F.size("steps") == k).drop("steps"))
        rest = state.filter(F.size("steps") > k).withColumn("step", F.get("steps", F.lit(k)))
        if rest.isEmpty():
            break
        hop = rest.join(edges, ["rev", "step"]).select(
            "ask_id", "steps", "occurrence_id", "child_rev", *pose.compose("", "e_"))
        # Names are not unique below one parent; the first occurrence answers.
        one = hop.groupBy("ask_id").agg(F.min(F.struct("occurrence_id", "child_rev", "steps", *pose.COLUMNS)).alias("h"))
        state = cut(one.select("ask_id", F.col("h.child_rev").alias("rev"), "h.steps", *[f"h.{c}" for c in pose.COLUMNS]))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("rev", "revision_id")


def move_points(points: Column, prefix: str = "") -> Column:
    """An array of x/y/z structs carried through a placement."""
    def move(p: Column) -> Column:
        x, y, z = pose.apply(p["x"], p["y"], p["z"], prefix)
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    return F.transform(points, move)


def derive_sockets(socket: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame, interface: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read socket patterns off sibling interfaces: (derived sockets, problems).

    socket(socket_id, revision_id, name, from_instance, from_interface, ...). Running it
    again after a child changed re-derives the sockets.
    """
    want = socket.filter("from_instance IS NOT NULL")
    return read_off(want, socket_origins(want, occ, rev, part), interface, rev, part)


def socket_origins(want: DataFrame, occ: DataFrame, rev: DataFrame, part: DataFrame) -> DataFrame:
    """(socket_id, sibling_rev, pose): the revision each socket is read off, placed in its owner."""
    at = find_instances(want.select(F.col("socket_id").alias("ask_id"), F.col("revision_id").alias("root_rev"),
                                    F.col("from_instance").alias("path")), occ, rev, part)
    return at.withColumnRenamed("revision_id", "sibling_rev").withColumnRenamed("ask_id", "socket_id")


def read_off(want: DataFrame, at: DataFrame, interface: DataFrame, rev: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`derive_sockets`, the siblings (:func:`socket_origins`) already known."""
    i = interface.select(F.col("revision_id").alias("sibling_rev"), F.col("name").alias("from_interface"), F.col("points").alias("_points"),
                         F.col("hole_radius").alias("_radius"), F.col("fastener").alias("_fastener"), *[F.col(f"n{a}").alias(f"_n{a}") for a in "xyz"])
    j = cut(want.select("socket_id", "revision_id", "name", "from_instance", "from_interface", "hole_radius", "fastener")
            .join(at, "socket_id", "left").join(i, ["sibling_rev", "from_interface"], "left"))
    normal = pose.apply(F.col("_nx"), F.col("_ny"), F.col("_nz"), rotate_only=True)
    ok = j.filter("_points IS NOT NULL").withColumn("points", move_points(F.col("_points")))
    mean = lambda a: F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p[a]) / F.size("points")
    derived = ok.select("socket_id", "revision_id", "name", "points", F.size("points").alias("hole_count"),
                        F.coalesce("hole_radius", "_radius").alias("hole_radius"), F.coalesce("fastener", "_fastener").alias("fastener"),
                        g.pairwise_spacings(F.col("points")).alias("spacings"), *[mean(a).alias(f"o{a}") for a in "xyz"],
                        *[normal[k].alias(f"n{'xyz'[k]}") for k in range(3)], F.lit("derived").alias("derivation"))
    number = rev.select(F.col("revision_id").alias("sibling_rev"), "part_id").join(part.select("part_id", "part_number"), "part_id").drop("part_id")
    why = F.when(F.col("sibling_rev").isNull(), F.format_string("socket '%s': nothing named '%s' in its parent", "name", "from_instance")).otherwise(
        F.format_string("socket '%s': %s offers no interface called '%s'", "name", F.coalesce("part_number", F.lit("?")), F.coalesce("from_interface", F.lit("?"))))
    problems = j.filter("_points IS NULL").join(number, "sibling_rev", "left").select("socket_id", "revision_id", why.alias("problem"))
    return derived, problems


def locate_patterns(decl: DataFrame, bore: DataFrame, plane: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Find declared hole patterns in extracted bores: (located, points, problems).

    decl(decl_id, fingerprint, radius?, radius_tol, count?, ax, ay, az?, cx, cy, cz?,
    within?, sx, sy, sz?, seat_offset?). Points are the bore axes projected on the
    seat: the outermost large plane on the seat side, or ``seat_offset``.
    """
    d = decl.withColumn("radius_tol", F.coalesce("radius_tol", F.lit(0.3)))
    b = bore.filter("complete").select("fingerprint", "bore_id", F.col("radius").alias("b_radius"), *[f"d{a}" for a in "xyz"], *[f"q{a}" for a in "xyz"])
    keep = ((F.col("radius").isNull() | (F.abs(F.col("b_radius") - F.col("radius")) <= F.col("radius_tol")))
            & (F.col("ax").isNull() | (g.axis_angle(g.vec("d"), g.vec("a")) <= SELECT_ANGLE))
            & (F.col("within").isNull() | (g.distance(g.vec("q"), g.vec("c")) <= F.col("within"))))
    cand = cut(d.select("decl_id", "fingerprint", "radius", "radius_tol", "ax", "ay", "az", "cx", "cy", "cz", "within")
               .join(b, "fingerprint").filter(keep).select("decl_id", "fingerprint", "bore_id", "b_radius", *[f"d{a}" for a in "xyz"], *[f"q{a}" for a in "xyz"]))
    near = lambda a, c: g.axis_angle(g.vec(a + "d"), g.vec(c + "d")) <= features.AXIS_ANGLE
    coords = [(f"d{a}", features._AXIS_REACH) for a in "xyz"]
    grouped = cut(cluster.leaders(cand, "decl_id", "bore_id", coords, near, [f"d{a}" for a in "xyz"]))
    groups = grouped.groupBy("decl_id", "leader").agg(F.count(F.lit(1)).alias("n"), F.avg("b_radius").alias("hole_radius"))
    want = d.select("decl_id", "count")
    # Groups that have the declared count come first, then the largest, then the first met.
    best = F.min(F.struct(F.when(F.col("n") == F.col("count"), 0).otherwise(1).alias("o"), (-F.col("n")).alias("m"), "leader", "hole_radius"))
    chosen = groups.join(want, "decl_id").groupBy("decl_id").agg(best.alias("c")).select("decl_id", "c.leader", (-F.col("c.m")).alias("n"), "c.hole_radius")
    lead = grouped.filter("bore_id = leader").select("decl_id", "leader", *[f"d{a}" for a in "xyz"])
    head = chosen.join(lead, ["decl_id", "leader"]).join(d.select("decl_id", "fingerprint", "count", "sx", "sy", "sz", "seat_offset"), "decl_id")
    asked = g.vec("s")
    size = g.norm(asked)
    unit = [F.when(F.col("sx").isNull(), a).otherwise(s / size) for s, a in zip(asked, g.vec("d"))]
    for k, a in enumerate("xyz"):
        head = head.withColumn(f"t{a}", unit[k])
    head = head.withColumn("tilted", F.abs(g.dot(g.vec("t"), g.vec("d"))) < math.cos(SEAT_ANGLE))
    head = head.select("decl_id", "leader", "fingerprint", "count", "n", "hole_radius", "seat_offset", "tilted", *[F.col(f"d{a}") for a in "xyz"],
                       *[F.when(F.col("tilted"), F.col(f"d{a}")).otherwise(F.col(f"t{a}")).alias(f"s{a}") for a in "xyz"])
    p = plane.select("fingerprint", "area", *[f"n{a}" for a in "xyz"], *[f"o{a}" for a in "xyz"])
    par = head.select("decl_id", "fingerprint", *[f"d{a}" for a in "xyz"], *[f"s{a}" for a in "xyz"]).join(p, "fingerprint").filter(
        g.axis_angle(g.vec("n"), g.vec("d")) <= SEAT_ANGLE).select("decl_id", "area", g.dot(g.vec("o"), g.vec("s")).alias("offset"))
    big = par.groupBy("decl_id").agg(F.max("area").alias("biggest"))
    seat = par.join(big, "decl_id").filter(F.col("area") >= SEAT_SHARE * F.col("biggest")).groupBy("decl_id").agg(F.max("offset").alias("offset"))
    head = cut(head.join(seat, "decl_id", "left").withColumn(
        "at", F.when(F.col("offset").isNotNull(), F.coalesce("seat_offset", "offset"))))
    toward = F.when(g.dot(g.vec("s"), g.vec("d")) > 0, 1.0).otherwise(-1.0)
    w = [F.col(f"d{a}") * toward for a in "xyz"]
    pts = grouped.join(head.select("decl_id", "leader", "at", *[F.col(f"s{a}") for a in "xyz"]), ["decl_id", "leader"])
    t = F.when(F.col("at").isNull(), 0.0).otherwise((F.col("at") - g.dot(g.vec("q"), g.vec("s"))) / g.dot(w, g.vec("s")))
    points = pts.select("decl_id", "bore_id", *[(F.col(f"q{a}") + t * w[k]).alias(a) for k, a in enumerate("xyz")])
    centre = points.groupBy("decl_id").agg(*[F.avg(a).alias(f"o{a}") for a in "xyz"])
    located = head.join(centre, "decl_id").select("decl_id", "fingerprint", F.col("n").alias("hole_count"), "hole_radius",
                                                  *[f"o{a}" for a in "xyz"], *[F.col(f"s{a}").alias(f"n{a}") for a in "xyz"])
    none = d.join(head.select("decl_id"), "decl_id", "left_anti").select("decl_id", F.when(
        F.col("radius").isNotNull(), F.format_string("the body has no hole of radius %s (tolerance %s)", F.col("radius").cast("string"), F.col("radius_tol").cast("string")))
        .otherwise("the body has no hole").alias("problem"))
    issue = F.filter(F.array(
        F.when(F.col("count").isNotNull() & (F.col("n") != F.col("count")), F.format_string(
            "%d holes are declared, %d lie along the body's best axis", "count", "n")),
        F.when(F.col("tilted"), "the seat's direction differs from that of the holes"),
        F.when(F.col("at").isNull(), "no plane lies across the holes, so their middles are taken")), lambda x: x.isNotNull())
    problems = none.unionByName(head.select("decl_id", F.explode(issue).alias("problem")))
    return located, points, problems


def pack_points(points: DataFrame, key: str = "decl_id") -> DataFrame:
    """The stored form: one row per interface with its own points, ordered by x, y, z."""
    cell = F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("points")
    return points.groupBy(key).agg(cell).withColumn("spacings", g.pairwise_spacings(F.col("points")))


def derive_contracts(decl: DataFrame, bore: DataFrame, plane: DataFrame, envelope: DataFrame | None = None,
                     bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Declarations checked against geometry: (interfaces, problems).

    decl as for :func:`locate_patterns` plus name, fastener?, fit_class. envelope(owner_id,
    fingerprint, allow_d*) is compared with bounds(fingerprint, bbox_d*).
    """
    located, points, problems = locate_patterns(decl, bore, plane)
    full = located.join(decl.select("decl_id", "name", "fastener", "fit_class"), "decl_id")
    refused = full.filter("fastener IS NOT NULL").filter(~fits.hole_accepts(F.col("fastener"), F.col("fit_class"), F.col("hole_radius"))).select(
        "decl_id", fits.hole_text(F.col("fastener"), F.col("fit_class"), F.col("hole_radius")).alias("problem"))
    named = problems.unionByName(refused).join(decl.select("decl_id", "name"), "decl_id").select(
        F.col("decl_id").cast("string").alias("owner_id"), F.format_string("interface '%s': %s", "name", "problem").alias("problem"))
    if envelope is not None:
        e = envelope.join(bounds, "fingerprint")
        over = F.filter(F.array(*[F.when(
            F.col(f"bbox_d{a}") > F.col(f"allow_d{a}") + 1e-6 * F.greatest(F.col(f"allow_d{a}"), F.lit(1.0)),
            F.format_string(f"envelope: measured {a}-size %.3f mm, allowed are %.3f mm", f"bbox_d{a}", f"allow_d{a}")) for a in "xyz"]),
            lambda x: x.isNotNull())
        named = named.unionByName(e.select(F.col("owner_id").cast("string").alias("owner_id"), F.explode(over).alias("problem")))
    return full.join(pack_points(points), "decl_id"), named


def draft_contracts(shape: DataFrame, pattern: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Contracts for shapes that came with none: (contracts, interface declarations).

    Envelope from the bounds, patterns (the ``most`` largest where the caller asks) as interfaces with a guessed fastener;
    labelled auto-drafted and unreviewed.
    """
    contracts = shape.select("fingerprint", *[F.bround(F.col(f"bbox_d{a}"), 3).alias(f"envelope_d{a}") for a in "xyz"],
                             F.lit("auto_drafted").alias("provenance"), F.lit(0).alias("reviewed"))
    p = features.ranked_patterns(pattern, most)
    null = F.lit(None).cast("double")
    decl = p.select(F.concat_ws("/", "fingerprint", "rank").alias("decl_id"), "fingerprint", F.concat(F.lit("pattern_"), "rank").alias("name"),
                    fits.guess_fastener(F.col("radius")).alias("fastener"), F.lit("clearance").alias("fit_class"), "radius",
                    F.lit(DRAFT_RADIUS_TOL).alias("radius_tol"), F.col("count"), *[F.col(f"d{a}").alias(f"a{a}") for a in "xyz"],
                    *[null.alias(c) for c in ("cx", "cy", "cz", "within", "sx", "sy", "sz", "seat_offset")], F.lit("auto_drafted").alias("source"))
    return contracts, decl


def _rounded(c: str | Column, digits: int) -> Column:
    return F.bround(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def contract_hash(contract: DataFrame, interface: DataFrame, socket: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """(revision_id, contract_hash): digest of a revision's public face; metadata is no part of it.

    Each interface, socket and dimension is rounded, written as JSON and hashed on its
    own; the hashes are added as a multiset. The result does not depend on row order
    and no revision's faces are gathered in one place.
    """
    def rows(df: DataFrame, tag: str, cols: list[Column]) -> DataFrame:
        text = F.concat(F.lit(tag), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
        return df.select("revision_id", *digest.child_lanes(text, F.lit(""), F.lit(1)))

    def pts(c: str) -> Column:
        return F.transform(c, lambda p: F.array(*[F.bround(p[a], 2) + F.lit(0.0) for a in "xyz"])).alias("points")

    have = lambda df, cols: [F.col(c) for c in cols if c in df.columns]
    i = rows(interface, "interface", [F.col("name"), F.col("kind"), F.col("hole_count"), _rounded("hole_radius", 3).alias("hole_radius"), F.col("fastener"),
                                      F.col("fit_class"), pts("points"), *[_rounded(f"n{a}", 3).alias(f"n{a}") for a in "xyz"],
                                      *have(interface, ["radius_tol", "spacing_tol"])])
    s = rows(socket, "socket", [F.col("name"), F.col("kind"), F.col("fills"), F.col("interface_name"), F.col("hole_count"),
                                _rounded("hole_radius", 3).alias("hole_radius"), F.col("fastener"), F.col("fit_class"), pts("points"),
                                *have(socket, ["allow_dx", "allow_dy", "allow_dz", "mass_budget", "power_budget", "thermal_budget"])])
    lanes = i.unionByName(s)
    if dimension is not None:
        lanes = lanes.unionByName(rows(dimension, "dimension", [F.col("name"), *[_rounded(c, 4).alias(c) for c in ("nominal", "tol_plus", "tol_minus")],
                                                         F.col("sigma_span"), F.col("distribution")]))
    lanes = lanes.groupBy("revision_id").agg(F.count(F.lit(1)).alias("children"), *digest.sum_lanes())
    zero = F.lit(0).cast("decimal(38,0)")
    j = contract.join(lanes, "revision_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    for c in digest.LANES:
        j = j.withColumn(c, F.coalesce(F.col(c), zero))
    own = [c for c in ("envelope_dx", "envelope_dy", "envelope_dz", "mass_max") if c in contract.columns]
    head = F.to_json(F.struct(*[_rounded(c, 3).alias(c) for c in own], *have(contract, ["cg_window", "datums", "attributes"])), {"ignoreNullFields": "false"})
    return j.select("revision_id", digest.node(head).alias("contract_hash"))


def author(declaration: DataFrame) -> dict[str, DataFrame]:
    """Split nested declarations into contract, interface, socket and dimension rows.

    declaration(revision_id, envelope_d*, mass_max, cg_window, datums, attributes,
    declared_by, interfaces, sockets, dimensions): the last three are arrays of structs.
    """
    out = {"contract": declaration.drop("interfaces", "sockets", "dimensions")}
    for name in ("interface", "socket", "dimension"):
        out[name] = declaration.select("revision_id", F.explode(f"{name}s").alias("x")).select(
            F.concat_ws("/", "revision_id", F.lit(name), "x.name").alias(f"{name}_id"), "revision_id", "x.*")
    return out


def reload(contract: DataFrame, interface: DataFrame, socket: DataFrame, dimension: DataFrame) -> dict[str, DataFrame]:
    """The declarations behind stored rows, as tables keyed by revision and ordered by name.

    An interface that was located by a selector is declared by the selector: its measured
    points, origin and normal are left out, so it can be located again in new geometry.
    """
    located = F.coalesce(F.col("selector"), F.lit("")) != "" if "selector" in interface.columns else F.lit(False)
    measured = {"points", "spacings", *[f"{p}{a}" for p in "on" for a in "xyz"]}
    declared = interface.select(*[F.when(~located, F.col(c)).alias(c) if c in measured else F.col(c) for c in interface.columns])
    return {"contract": contract, "interface": declared.orderBy("revision_id", "name"), "socket": socket.orderBy("revision_id", "name"),
            "dimension": dimension.orderBy("revision_id", "name")}


def copy_to(replaced: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Contract tables re-keyed from old_rev to new_rev; ids are made new."""
    out = {}
    for name, df in tables.items():
        j = df.join(replaced.select(F.col("old_rev").alias("revision_id"), "new_rev"), "revision_id").drop("revision_id")
        j = j.withColumnRenamed("new_rev", "revision_id")
        ident = f"{name}_id"
        if ident in df.columns:
            j = j.withColumn(ident, F.concat_ws("/", F.col("revision_id").cast("string"), F.col(ident).cast("string")))
        out[name] = j.select(*[c for c in df.columns])
    return out


