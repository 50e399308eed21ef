"""Content digests as column expressions.

Values are sha2-256 cut to 16 hex digits. Pieces are length-prefixed, so no two
lists of pieces run together to the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIGITS = 16
# The face kinds counted in a histogram.
SURFACE_KINDS = ("plane", "cylinder", "cone", "sphere", "torus", "bspline", "revolution", "other")
_LANES = 4
_LANE_HEX = 15


def digest(*pieces: Column, digits: int = DIGITS) -> Column:
    framed = [F.concat(F.length(p).cast("string"), F.lit(":"), p)
              for p in (F.coalesce(x.cast("string"), F.lit("")) for x in pieces)]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, digits)


def significant(value: Column, digits: int = 9) -> Column:
    """Round half-even to significant digits; zero and non-finite values become zero."""
    size = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    usable = value.isNotNull() & ~F.isnan(value) & (value != 0.0) & (F.abs(value) != float("inf"))
    return F.when(usable, F.bround(value * size, 0) / size).otherwise(F.lit(0.0))


def general_text(value: Column, digits: int = 9) -> Column:
    """A double as text with at most ``digits`` significant digits, trailing zeros dropped."""
    return F.when(value.isNotNull(), F.regexp_replace(
        significant(value, digits).cast("decimal(38,18)").cast("string"), r"\.?0+$", ""))


def attributes(contract_hash: Column, material: Column, density: Column) -> Column:
    """Everything about a revision that is neither geometry nor structure."""
    return digest(F.lit("attributes"), contract_hash, material, general_text(density))


def leaf(fingerprint: Column, attrs: Column) -> Column:
    return digest(F.lit("leaf"), fingerprint, attrs)


def empty(revision_id: Column, attrs: Column) -> Column:
    return digest(F.lit("empty"), revision_id, attrs)


# -- multiset hash of children ------------------------------------------------
#
# A node must not depend on the order of its children, and a node may have very
# many. So a child is hashed on its own, its hash is read as four 60-bit numbers
# and these are added up (an additive multiset hash). Sums aggregate partially on
# the map side and in any grouping; no child list is ever gathered in one place.

LANES = [f"lane{i}" for i in range(_LANES)]


def child_lanes(child_hash: Column, pose_key: Column, quantity: Column) -> list[Column]:
    full = F.sha2(F.concat_ws("|", child_hash, pose_key, quantity.cast("string")), 256)
    return [F.conv(F.substring(full, 1 + i * _LANE_HEX, _LANE_HEX), 16, 10).cast("decimal(20,0)").alias(LANES[i])
            for i in range(_LANES)]


def sum_lanes() -> list[Column]:
    return [F.sum(c).cast("decimal(38,0)").alias(c) for c in LANES]


def node(attrs: Column) -> Column:
    return digest(F.lit("node"), attrs, F.col("children").cast("string"), *[F.col(c).cast("string") for c in LANES])


def fingerprint(char_length: Column, dimensionless: list[Column], chirality: Column, histogram: list[Column],
                topology: list[Column]) -> Column:
    """Strict identity of a shape: invariants at nine digits, hand, face counts by kind name, topology."""
    numbers = [F.format_string("%.8e", significant(c)) for c in [char_length, *dimensionless]]
    kinds = [p for k, c in sorted(zip(SURFACE_KINDS, histogram), key=lambda kc: kc[0]) for p in (F.lit(k), c.cast("string"))]
    return digest(F.lit("shape"), *numbers, chirality.cast("string"), *kinds, *[t.cast("string") for t in topology])


