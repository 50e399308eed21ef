"""Finding equal or similar shapes and interfaces by bucketed band joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import geometry as g
from ..session import cut, union_all

# Relative size and absolute shape tolerances, one tool and across tools.
SIZE_TOLERANCE = 1e-4
SHAPE_TOLERANCE = 1e-4
CROSS_TOOL_SHAPE_TOLERANCE = 1e-3
WINDOW = 1.5

COMPONENTS = ["sphericity", "j1", "j2", "j3"]
COUNTS = ["n_faces", "n_edges", "n_vertices", "n_shells", "n_solids"]
_WIDE = 16


def _own(df: DataFrame, size_tol: float, shape_tol: float, parts: list[str], prefix: str, exact: list[str]) -> Column:
    width = math.log1p(_WIDE * size_tol)
    return F.xxhash64(*[F.col(prefix + e) for e in exact], F.lit(0).cast("long") if size_tol >= 1 else F.floor(F.ln(F.col(f"{prefix}char_length")) / width),
                      *[F.floor(F.col(prefix + c) / (_WIDE * shape_tol)) for c in parts])


def _touched(df: DataFrame, size_tol: float, shape_tol: float, parts: list[str], prefix: str, exact: list[str]) -> DataFrame:
    """One row per bucket that can hold a partner within the tolerances."""
    width = math.log1p(_WIDE * size_tol)
    if size_tol >= 1:  # any two sizes agree
        out = df.withColumn("_s", F.lit(0).cast("long"))
    else:
        reach = -math.log1p(-size_tol) + 1e-9
        l = F.ln(F.col(f"{prefix}char_length"))
        out = df.withColumn("_s", F.explode(F.sequence(F.floor((l - reach) / width), F.floor((l + reach) / width))))
    names = ["_s"]
    for i, c in enumerate(parts):
        x, w = F.col(prefix + c), _WIDE * shape_tol
        out = out.withColumn(f"_c{i}", F.explode(F.array_distinct(F.array(F.floor((x - shape_tol) / w), F.floor((x + shape_tol) / w)))))
        names.append(f"_c{i}")
    return out.withColumn("_bucket", F.xxhash64(*[F.col(prefix + e) for e in exact], *names)).drop(*names)


def size_error(a: str = "a_", b: str = "b_") -> Column:
    x, y = F.col(f"{a}char_length"), F.col(f"{b}char_length")
    return F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-12))


def shape_error(components: list[str] = COMPONENTS, a: str = "a_", b: str = "b_") -> Column:
    gaps = [F.abs(F.col(a + c) - F.col(b + c)) for c in components]
    return gaps[0] if len(gaps) == 1 else F.greatest(*gaps)


def opposite_hands(a: str = "a_", b: str = "b_") -> Column:
    x, y = F.col(f"{a}chirality"), F.col(f"{b}chirality")
    return (x != 0) & (y != 0) & (x != y)


def compare_reason(size: Column, shape: Column, conflict: Column, size_tol: float = SIZE_TOLERANCE,
                   shape_tol: float = SHAPE_TOLERANCE) -> Column:
    return (F.when((size <= size_tol) & (shape <= shape_tol) & ~conflict, "within tolerance")
            .when(conflict, "mirror images of each other")
            .when(size > size_tol, F.format_string("sizes are apart by %.2e (limit %.0e)", size, F.lit(size_tol)))
            .otherwise(F.format_string("shapes are apart by %.2e (limit %.0e)", shape, F.lit(shape_tol))))


def near_pairs(probe: DataFrame, shape: DataFrame, size_tol: float, shape_tol: float, exact: list[str] = (),
               components: list[str] = COMPONENTS) -> DataFrame:
    """Pairs within size and shape tolerance, columns prefixed a_ (probe) and b_ (shape).

    The bucket covers size and all components, so shapes that merely have the same
    size do not meet; a popular size is no hot key unless the shapes are alike too.
    """
    exact = list(exact)
    a = probe.select(*[F.col(c).alias(f"a_{c}") for c in probe.columns])
    b = shape.select(*[F.col(c).alias(f"b_{c}") for c in shape.columns])
    b = b.withColumn("_bucket", _own(b, size_tol, shape_tol, components, "b_", exact))
    hit = _touched(a, size_tol, shape_tol, components, "a_", exact).join(b, "_bucket").drop("_bucket")
    same = [F.col(f"a_{e}") == F.col(f"b_{e}") for e in exact]
    for s in same:
        hit = hit.filter(s)
    return (hit.withColumn("size_error", size_error()).withColumn("shape_error", shape_error(components))
            .filter((F.col("size_error") <= size_tol) & (F.col("shape_error") <= shape_tol)))


def corroborated(columns: list[str]) -> Column:
    shared = [c for c in [*COUNTS, "face_histogram"] if f"a_{c}" in columns and f"b_{c}" in columns]
    ok = F.lit(True)
    for c in shared:
        ok = ok & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return ok


def bounded_match(probe: DataFrame, shape: DataFrame, size_tol: float = SIZE_TOLERANCE,
                  shape_tol: float = SHAPE_TOLERANCE) -> DataFrame:
    """The best stored shape per probe within tolerance, hands compatible.

    Best: counts agree first, then least shape error, then least size error, then
    fingerprint. All candidates are considered.
    """
    pairs = near_pairs(probe, shape, size_tol, shape_tol).filter(~opposite_hands())
    pairs = pairs.withColumn("corroborated", corroborated(pairs.columns))
    rank = F.struct((~F.col("corroborated")).cast("int").alias("o"), "shape_error", "size_error",
                    F.col("b_fingerprint").alias("fingerprint"), "corroborated")
    return pairs.groupBy(F.col("a_probe_id").alias("probe_id")).agg(F.min(rank).alias("m")).select(
        "probe_id", "m.fingerprint", "m.size_error", "m.shape_error", "m.corroborated")


def resolve_shapes(probe: DataFrame, shape: DataFrame, alias: DataFrame, size_tol: float = SIZE_TOLERANCE,
                   shape_tol: float = SHAPE_TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Strict hash, then alias, then bounded match, else new: (outcome per probe, new alias rows).

    probe(probe_id, strict, invariants...). Only probes that miss both lookups reach
    the band join.
    """
    known = shape.select(F.col("fingerprint").alias("strict"), F.col("fingerprint").alias("_hit"))
    via = alias.select(F.col("alias_fingerprint").alias("strict"), F.col("fingerprint").alias("_via"))
    looked = cut(probe.join(known, "strict", "left").join(via, "strict", "left"))
    open_ = looked.filter("_hit IS NULL AND _via IS NULL")
    match = cut(bounded_match(open_.drop("_hit", "_via"), shape, size_tol, shape_tol))
    out = looked.select("probe_id", "strict", "_hit", "_via").join(match, "probe_id", "left")
    status = F.when(F.coalesce("_hit", "_via").isNotNull(), "exact_hit").when(F.col("fingerprint").isNotNull(), "bounded_hit").otherwise("new")
    outcome = out.select("probe_id", "strict", F.coalesce("_hit", "_via", "fingerprint", "strict").alias("fingerprint"), status.alias("status"))
    fresh = out.filter("_hit IS NULL AND _via IS NULL AND fingerprint IS NOT NULL").groupBy(F.col("strict").alias("alias_fingerprint")).agg(
        F.min(F.struct("fingerprint", "size_error", "shape_error", "corroborated")).alias("m")).select(
        "alias_fingerprint", "m.fingerprint", F.col("m.size_error").alias("char_length_error"), "m.shape_error", "m.corroborated")
    return outcome, fresh


def proximity(a: str = "a_", b: str = "b_", components: list[str] = COMPONENTS) -> Column:
    """Euclidean distance over relative size and the dimensionless components."""
    x, y = F.col(f"{a}char_length"), F.col(f"{b}char_length")
    size = (x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-12))
    total = size * size
    for c in components:
        total = total + (F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c))
    return F.sqrt(total)


def compatible_interfaces(asked: DataFrame, interface: DataFrame, rev: DataFrame, part: DataFrame, shape: DataFrame,
                          contract: DataFrame, current: DataFrame) -> DataFrame:
    """Interfaces of current revisions that satisfy socket descriptions.

    asked(query_id, kind, hole_count?, hole_radius?, radius_tol, spacings?, spacing_tol,
    allow_d{x,y,z}?, fastener?). A null condition does not restrict. Answers have ``query_id``
    and the columns of the interface. Nearly every question can meet every interface of its kind, so
    both are dealt to groups of bounded size, compared there as arrays, and only what fits becomes rows.
    """
    env = [c for c in ("envelope_dx", "envelope_dy", "envelope_dz") if c in contract.columns]
    c = contract.select("revision_id", *env) if env else contract.select("revision_id").withColumns(
        {f"envelope_d{a}": F.lit(None).cast("double") for a in "xyz"})
    i = (interface.join(current.select("revision_id", "part_id", F.col("fingerprint")), "revision_id")
         .join(part.select("part_id", "part_number", "team_id"), "part_id")
         .join(shape.select("fingerprint", "bbox_dx", "bbox_dy", "bbox_dz"), "fingerprint", "left")
         .join(c, "revision_id", "left")
         .withColumn("their_spacings", g.pairwise_spacings(F.col("points")))
         .select("revision_id", F.col("name").alias("interface"), "kind", F.col("hole_count").alias("their_count"),
                 F.col("hole_radius").alias("their_radius"), F.col("fastener").alias("their_fastener"), "fit_class", "their_spacings",
                 "part_number", "team_id", "fingerprint", "bbox_dx", "bbox_dy", "bbox_dz", "envelope_dx", "envelope_dy", "envelope_dz"))
    size = F.when(F.col("envelope_dx").isNotNull(), F.array("envelope_dx", "envelope_dy", "envelope_dz")).when(
        F.col("bbox_dx").isNotNull(), F.array("bbox_dx", "bbox_dy", "bbox_dz"))
    i = cut(i.filter("kind IS NOT NULL").withColumn("_size", F.array_sort(size)).withColumn("_fastener", F.upper("their_fastener")))
    double = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    asked = cut(asked.filter("kind IS NOT NULL").select(
        "query_id", "kind", *double("hole_count", "hole_radius", "radius_tol", "spacing_tol"), F.upper("fastener").alias("_fastener"),
        F.array_sort("spacings").cast("array<double>").alias("_spacings"), F.when(F.col("allow_dx").isNotNull(), F.array_sort(F.array("allow_dx", "allow_dy", "allow_dz"))).cast("array<double>").alias("_allow")))
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, pieces = (max(math.ceil(df.count() / most), 1) for df, most in ((asked, ASKED), (i, OFFERED)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
    key = ["kind", "_block", "_piece"]
    # A fixed number of partitions: the placed rows are few bytes, but each meets very many.
    a = asked.withColumn("_block", dealt(asked, blocks)).withColumn("_piece", every(pieces)).repartition(n, *key)
    b = i.withColumn("_piece", dealt(i, pieces)).withColumn("_block", every(blocks)).repartition(n, *key)
    kept = [f for f in i.schema.fields if not f.name.startswith("_")]
    schema = StructType([*kept, StructField("_queries", ArrayType(asked.schema["query_id"].dataType))])
    met = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_fitting([f.name for f in kept]), schema)
    return met.select(F.explode("_queries").alias("query_id"), *[f.name for f in kept])


# Questions and interfaces that one task compares at once.
ASKED, OFFERED = 2048, 4096


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # a null is NaN, which fits nothing


def _lists(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows whose list has it, and these lists as one matrix. Null lists are left out."""
    flat, lengths = column.combine_chunks(), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = flat.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    lengths = np.nan_to_num(lengths.astype(float), nan=-1).astype(int)
    first = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    return {int(n): (at := np.flatnonzero(lengths == n), values[first[at][:, None] + np.arange(n)]) for n in np.unique(lengths[lengths >= 0])}


def _fits(asked: pa.Table, offered: pa.Table) -> np.ndarray:
    """fits[q, i]: whether interface i satisfies question q."""
    ok = np.ones((asked.num_rows, offered.num_rows), bool)
    count, radius, reach, near = (_numbers(asked[c]) for c in ("hole_count", "hole_radius", "radius_tol", "spacing_tol"))
    their_count, their_radius = _numbers(offered["their_count"]), _numbers(offered["their_radius"])
    words = pc.unique(pa.chunked_array([*asked["_fastener"].chunks, *offered["_fastener"].chunks], asked["_fastener"].type))
    named, their_name = (pc.fill_null(pc.index_in(t["_fastener"], words, skip_nulls=True), -1).to_numpy() for t in (asked, offered))
    spaced, allowed, sizes = _lists(asked["_spacings"]), _lists(asked["_allow"]), _lists(offered["_size"])
    spacings = _lists(offered["their_spacings"])
    asks = {c: asked[c].is_valid().to_numpy() for c in ("hole_count", "hole_radius")}
    for q in range(asked.num_rows):
        if asks["hole_count"][q]:
            ok[q] &= their_count == count[q]
        if asks["hole_radius"][q]:
            ok[q] &= np.abs(their_radius - radius[q]) <= reach[q]
        if named[q] >= 0:
            ok[q] &= their_name == named[q]
    for n, (rows, wanted) in spaced.items():
        at, theirs = spacings.get(n, (np.zeros(0, int), np.zeros((0, n))))
        for q, own in zip(rows, wanted):
            fit = np.zeros(offered.num_rows, bool)
            some = np.flatnonzero(ok[q][at])
            for k in range(n):
                some = some[np.abs(theirs[some, k] - own[k]) <= near[q]]
            fit[at[some]] = True
            ok[q] &= fit
    for rows, wanted in allowed.values():
        for at, theirs in sizes.values():  # an interface without a size fits all
            for q, own in zip(rows, wanted):
                ok[q, at] &= (theirs - own <= 1e-9).all(1)
    return ok


def _fitting(columns: list[str]):
    """Interfaces of one group with the ``query_id`` of all questions of the group that they satisfy."""
    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        ids = asked["query_id"].combine_chunks()
        i, q = np.nonzero(_fits(asked, offered).T)
        times = np.bincount(i, minlength=offered.num_rows)
        several = np.flatnonzero(times)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times[several])]), pa.int32()), ids.take(pa.array(q)))
        return pa.Table.from_arrays([*[offered[c].take(pa.array(several)) for c in columns], lists], [*columns, "_queries"])

    return run


def rank_candidates(candidate: DataFrame, like: DataFrame, shape: DataFrame, limit: int | None = None,
                    components: list[str] = COMPONENTS) -> DataFrame:
    """Candidates of each query by shape distance to like(query_id, like_fingerprint), then part
    number; the first ``limit`` where the caller asks for so many. Queries without a like shape rank at distance zero."""
    cols = ["char_length", *components]
    a = like.join(shape.select(F.col("fingerprint").alias("like_fingerprint"), *[F.col(c).alias(f"a_{c}") for c in cols]), "like_fingerprint").drop("like_fingerprint")
    b = shape.select("fingerprint", *[F.col(c).alias(f"b_{c}") for c in cols])
    d = candidate.join(a, "query_id", "left").join(b, "fingerprint", "left").withColumn(
        "shape_distance", F.coalesce(proximity(components=components), F.lit(0.0)))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("shape_distance", "part_number", "revision_id", "interface"))
    ranked = d.withColumn("rank", rn)
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select(
        "query_id", "rank", "part_number", "team_id", "interface", "revision_id", "shape_distance")


def best_partner(solid: DataFrame, components: list[str] = COMPONENTS) -> DataFrame:
    """For each solid(case_id, variant, solid_id, invariants) the solid of every other
    variant of its case with the least size plus shape error.

    Exact without all pairs: the search radius grows, and a solid is settled once its
    best partner lies within the radius, as any better one would have been met too.
    Solids of a variant whose figures are equal are compared once, by their least name, so
    a shape that is stored very often is no hot bucket.
    Solids without a positive size or with an unknown component, and those for which no
    such solid of the other variant exists, come first, with no partner.
    """
    keep = ["case_id", "variant", "solid_id", "strict", "char_length", "chirality", *components]
    s = cut(solid.select(*keep))
    variants = s.select("case_id", "variant").distinct()
    asked = s.join(variants.select("case_id", F.col("variant").alias("other")), "case_id").filter("variant < other")
    known = F.coalesce(F.col("char_length") > 0, F.lit(False)) & (F.col("char_length") < float("inf"))
    for c in components:
        known = known & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    s = cut(s.withColumn("_known", known))
    there = s.filter("_known").select("case_id", F.col("variant").alias("other")).distinct().withColumn("_there", F.lit(True))
    asked = cut(asked.withColumn("_known", known).join(there, ["case_id", "other"], "left").withColumn("_ok", F.col("_known") & F.col("_there").isNotNull()))
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    settled = [asked.filter("NOT _ok").select("case_id", "variant", "solid_id", "other", null("partner", s.schema["solid_id"].dataType), null("size_error", "double"),
                                              null("shape_error", "double"), null("same_strict", "boolean"))]
    want, s, radius = asked.filter("_ok").drop("_known", "_there", "_ok"), s.filter("_known").drop("_known"), SIZE_TOLERANCE
    figures = ["char_length", *components]
    first = F.min(F.struct("solid_id", "strict")).alias("f")
    shape_b = cut(s.groupBy("case_id", F.col("variant").alias("other"), *figures).agg(first).select(
        "case_id", "other", *figures, F.col("f.solid_id").alias("solid_id"), F.col("f.strict").alias("strict")))
    while not want.isEmpty():
        alike = ["case_id", "variant", "other", *figures]
        pairs = near_pairs(want.select(*alike).distinct(), shape_b, min(radius, 1.0), radius, ["case_id", "other"], components)
        score = F.col("size_error") + F.col("shape_error")
        of_alike = pairs.groupBy(*[F.col(f"a_{k}").alias(k) for k in alike]).agg(
            F.min(F.struct(score.alias("score"), F.col("b_solid_id").alias("partner"), "size_error", "shape_error",
                           F.col("b_strict").alias("their_strict"))).alias("m"))
        best = want.join(of_alike, alike).groupBy("case_id", "variant", "solid_id", "other", "strict").agg(F.min("m").alias("m"))
        done = cut(best.filter(F.col("m.score") <= radius).select(
            "case_id", "variant", "solid_id", "other", F.col("m.partner").alias("partner"), F.col("m.size_error").alias("size_error"),
            F.col("m.shape_error").alias("shape_error"), (F.col("strict") == F.col("m.their_strict")).alias("same_strict")))
        settled.append(done)
        want = cut(want.join(done, ["case_id", "variant", "solid_id", "other"], "left_anti"))
        radius *= 8
    return union_all(settled)


def error_summary(pairs: DataFrame) -> DataFrame:
    """How far two readings of one shape lie apart: median, 95 percent and maximum of both errors."""
    cols = []
    for name in ("size_error", "shape_error"):
        cols += [F.percentile(name, F.lit(p)).alias(f"{name}_p{int(p * 100)}") for p in (0.5, 0.95)] + [F.max(name).alias(f"{name}_max")]
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("same_strict").alias("strict_agree"), *cols)


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two readings(file_id, label, volume, shape_key) of each file: counts, distinct shapes,
    total volume within 1e-6, and how many part names of the left are contained in labels of the right."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("file_id").agg(F.count(F.lit(1)).alias(f"{p}_solids"), F.count_distinct("shape_key").alias(f"{p}_shapes"),
                                         F.sum("volume").alias(f"{p}_volume"))
    l, r = side(left, "left"), side(right, "right")
    # Containment as an equi-join: a label is cut into the lengths that names have.
    names = left.select("file_id", F.col("label").alias("name")).distinct()
    sizes = names.groupBy("file_id").agg(F.collect_set(F.length("name")).alias("sizes"))
    cuts = (right.select("file_id", "label").distinct().join(sizes, "file_id")
            .withColumn("size", F.explode("sizes")).filter(F.col("size") <= F.length("label"))
            .withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("label") - F.col("size") + 1)))
            .select("file_id", F.substring("label", F.col("pos"), F.col("size")).alias("name")).distinct())
    named = names.join(cuts.withColumn("_f", F.lit(1)), ["file_id", "name"], "left").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("names"), F.count("_f").alias("recovered"))
    j = l.join(r, "file_id", "full").join(named, "file_id", "left")
    gap = F.abs(F.col("left_volume") - F.col("right_volume")) / F.greatest(F.abs("left_volume"), F.lit(1.0))
    agree = (F.coalesce(F.col("left_solids") == F.col("right_solids"), F.lit(False)) & F.coalesce(F.col("left_shapes") == F.col("right_shapes"), F.lit(False))
             & F.coalesce(gap < 1e-6, F.lit(False)) & F.coalesce(F.col("names") == F.col("recovered"), F.lit(False)))
    return j.withColumn("agree", agree)
