"""Interfaces that satisfy questions, against all pairs, with unset conditions and unknown figures on both sides."""

import random

import pytest
from pyspark.sql import functions as F

from partloom.functions import geometry
from partloom.operators import matching

ASKED = ("query_id string, kind string, hole_count int, hole_radius double, radius_tol double, spacings array<double>, spacing_tol double, "
         "allow_dx double, allow_dy double, allow_dz double, fastener string")
POINTS = "array<struct<x: double, y: double, z: double>>"


def tables(spark, draw):
    one = lambda *x: draw.choice(x)
    pattern = [[], [(0.0, 0.0, 0.0)], [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0)], [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (3.0, 4.0, 0.0)], [(0.0, 0.0, 0.0), (3.1, 0.0, 0.0), (3.1, 4.0, 0.0)], None]
    asked = [(f"q{k}", one("bolt", "bolt", "bolt", "pin", None), one(None, 2, 3), one(None, 3.0, 3.1, 3.49), one(0.0, 0.1, 0.5, None), one(None, [], [3.0], [5.0, 3.0, 4.0], [3.0, None, 5.0]),
              one(0.01, 0.2, None), one(None, 5.0, 9.0), one(5.0, 9.0, None), one(5.0, 1.0), one(None, "m6", "M8")) for k in range(400)]
    asked += [asked[0], ("q0", *asked[1][1:])]  # rows that come twice, and an id with two questions
    interface = [(f"r{k}", one("a", "b"), one("bolt", "bolt", "pin", None), one(2, 3, None), one(3.0, 3.1, 3.49, 3.6, None), one("M6", "m8", None), "close", one(*pattern)) for k in range(50)]
    interface.append(interface[0])
    rev = [(f"r{k}", f"p{k % 9}", one("f1", "f2", "f3", None)) for k in range(45)]
    shape = [("f1", 9.0, 1.0, 5.0), ("f2", 4.0, 4.0, None), ("f4", 1.0, 1.0, 1.0)]
    contract = [(f"r{k}", *one((None, None, None), (5.0, 0.5, 5.0), (9.5, 1.0, 1.0))) for k in range(20)]
    make = spark.createDataFrame
    return (make(asked, ASKED), make(interface, f"revision_id string, name string, kind string, hole_count int, hole_radius double, fastener string, fit_class string, points {POINTS}"),
            make(rev, "revision_id string, part_id string, fingerprint string"), make([(f"p{k}", f"P{k}", "t") for k in range(8)], "part_id string, part_number string, team_id string"),
            make(shape, "fingerprint string, bbox_dx double, bbox_dy double, bbox_dz double"), make(contract, "revision_id string, envelope_dx double, envelope_dy double, envelope_dz double"))


def fits(q, i):
    le = lambda x, y: x is not None and y is not None and x <= y
    gap = lambda x, y: None if x is None or y is None else abs(x - y)
    order = lambda xs: sorted(xs, key=lambda x: (x is None, x or 0.0))
    if q.kind is None or q.kind != i.kind or (q.hole_count is not None and q.hole_count != i.hole_count):
        return False
    if q.hole_radius is not None and not le(gap(i.hole_radius, q.hole_radius), q.radius_tol):
        return False
    if q.fastener is not None and (i.fastener is None or q.fastener.upper() != i.fastener.upper()):
        return False
    if q.spacings is not None and (i.theirs is None or len(q.spacings) != len(i.theirs) or not all(le(gap(x, y), q.spacing_tol) for x, y in zip(order(q.spacings), i.theirs))):
        return False
    size = [i.envelope_dx, i.envelope_dy, i.envelope_dz] if i.envelope_dx is not None else [i.bbox_dx, i.bbox_dy, i.bbox_dz] if i.bbox_dx is not None else None
    room = [q.allow_dx, q.allow_dy, q.allow_dz]
    return q.allow_dx is None or size is None or all(x is not None and y is not None and x - y <= 1e-9 for x, y in zip(order(size), order(room)))


@pytest.mark.parametrize("asked_at_once, offered_at_once", [(2048, 4096), (7, 5)])
def test_compatible_interfaces_equal_all_pairs(spark, monkeypatch, asked_at_once, offered_at_once):
    monkeypatch.setattr(matching, "ASKED", asked_at_once)
    monkeypatch.setattr(matching, "OFFERED", offered_at_once)
    asked, interface, rev, part, shape, contract = tables(spark, random.Random(4))
    got = matching.compatible_interfaces(asked, interface, rev, part, shape, contract, rev)
    whole = interface.withColumn("theirs", geometry.pairwise_spacings(F.col("points"))).join(rev, "revision_id").join(part, "part_id").join(shape, "fingerprint", "left").join(contract, "revision_id", "left").collect()
    want = sorted((q.query_id, i.revision_id, i.name, i.part_number) for q in asked.collect() for i in whole if fits(q, i))
    assert sorted((r.query_id, r.revision_id, r.interface, r.part_number) for r in got.collect()) == want and len(want) > 100


def test_questions_of_one_kind_and_size_are_compared_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "ASKED", 50)
    monkeypatch.setattr(matching, "OFFERED", 50)
    asked = spark.range(200).selectExpr("concat('q', id) AS query_id", "'bolt' AS kind", "4 AS hole_count", "3.3D AS hole_radius", "0.1D AS radius_tol", "CAST(NULL AS array<double>) AS spacings",
                                        "0.1D AS spacing_tol", *[f"CAST(NULL AS double) AS allow_d{a}" for a in "xyz"], "CAST(NULL AS string) AS fastener")
    interface = spark.range(300).selectExpr("id AS revision_id", "'foot' AS name", "'bolt' AS kind", "4 AS hole_count", "3.3D AS hole_radius", "'M6' AS fastener", "'close' AS fit_class", f"CAST(array() AS {POINTS}) AS points")
    rev = spark.range(300).selectExpr("id AS revision_id", "id AS part_id", "'f' AS fingerprint")
    part = spark.range(300).selectExpr("id AS part_id", "concat('P', id) AS part_number", "'t' AS team_id")
    shape = spark.createDataFrame([("f", 1.0, 1.0, 1.0)], "fingerprint string, bbox_dx double, bbox_dy double, bbox_dz double")
    got = matching.compatible_interfaces(asked, interface, rev, part, shape, rev.select("revision_id"), rev).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in got) == 200 * 300 and max(r["count"] for r in got) < 0.6 * 200 * 300
