"""Small geometry as column expressions. Vectors are lists of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Vec = list[Column]


def vec(prefix: str, axes: str = "xyz") -> Vec:
    return [F.col(f"{prefix}{a}") for a in axes]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def distance(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def axis_angle(a: Vec, b: Vec) -> Column:
    """Angle between two lines (sign ignored); a vanishing vector is at right angle to all."""
    size = norm(a) * norm(b)
    return F.when(size < 1e-30, F.lit(math.pi)).otherwise(F.acos(F.least(F.abs(dot(a, b)) / size, F.lit(1.0))))


def canonical(d: Vec) -> Vec:
    """Unit direction of a line: the first component beyond 1e-9 is positive; zero length gives z."""
    n = norm(d)
    unit = [c / n for c in d]
    lead = F.coalesce(*[F.when(F.abs(u) > 1e-9, u) for u in unit], F.lit(1.0))
    sign = F.when(lead < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [F.when(n < 1e-15, F.lit(z)).otherwise(u * sign) for u, z in zip(unit, (0.0, 0.0, 1.0))]


def nearest_on_axis(point: Vec, direction: Vec, target: Vec) -> Vec:
    """The point of a line (unit direction) closest to the target."""
    t = dot(minus(target, point), direction)
    return [p + t * d for p, d in zip(point, direction)]


def sphericity(volume: Column, area: Column) -> Column:
    return F.lit(math.pi ** (1 / 3)) * F.pow(6 * volume, F.lit(2 / 3)) / F.greatest(area, F.lit(1e-15))


def char_length(volume: Column) -> Column:
    return F.pow(volume, F.lit(1 / 3))


# Third-order monomials by axis letters; the number is how often each occurs in (r.u)^3.
THIRD = {"xxx": 1, "yyy": 1, "zzz": 1, "xxy": 3, "xxz": 3, "xyy": 3, "yyz": 3, "xzz": 3, "yzz": 3, "xyz": 6}
SECOND = ["xx", "xy", "xz", "yy", "yz", "zz"]


def third_along(u: Vec, prefix: str = "t_") -> Column:
    """Third central moment along a unit direction, from the ten stored moments."""
    at = dict(zip("xyz", u))
    terms = [F.col(prefix + m) * n * at[m[0]] * at[m[1]] * at[m[2]] for m, n in THIRD.items()]
    return sum(terms[1:], terms[0])


def inertia(prefix: str = "s_") -> dict[str, Column]:
    """Inertia tensor about the centroid from the second moments: trace times identity minus moments."""
    trace = F.col(prefix + "xx") + F.col(prefix + "yy") + F.col(prefix + "zz")
    return {m: (trace - F.col(prefix + m)) if m[0] == m[1] else -F.col(prefix + m) for m in SECOND}


def pairwise_spacings(points: Column) -> Column:
    """Sorted distances between all pairs in an array of x/y/z structs (one row's own points)."""
    def to(p: Column, q: Column) -> Column:
        return F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2)
    rows = F.transform(points, lambda p, i: F.transform(F.slice(points, i + 2, F.size(points)), lambda q: to(p, q)))
    return F.array_sort(F.flatten(rows))
