"""Hand-made tables for unit tests."""

from partloom.functions import pose

EYE = dict(m00=1.0, m01=0.0, m02=0.0, m03=0.0, m10=0.0, m11=1.0, m12=0.0, m13=0.0, m20=0.0, m21=0.0, m22=1.0, m23=0.0)
OCC = "occurrence_id string, parent_rev string, child_rev string, instance_name string, quantity int, " + ", ".join(
    f"{c} double" for c in pose.COLUMNS) + ", transform_key string, sort_key string"
REV = "revision_id string, part_id string, revision_index int, fingerprint string, is_assembly int, density double, material string, status string, author string"
PART = "part_id string, part_number string, team_id string, description string"
SHAPE = "fingerprint string, volume double, volume_exact double, com_x double, com_y double, com_z double"
CONTRACT = "revision_id string, contract_id string, contract_hash string, attributes string, mass_max double, provenance string, reviewed int"


def edge(n, parent, child, name="", qty=1, **at):
    m = {**EYE, **at}
    key = "t:" + "|".join(str(round(m[c] * 1000)) for c in ("m03", "m13", "m23"))
    return (f"o{n}", parent, child, name, qty, *[float(m[c]) for c in pose.COLUMNS], key, f"{child}|{key}")


def occ(spark, rows):
    return spark.createDataFrame([edge(i, *r[:2], **(r[2] if len(r) > 2 else {})) for i, r in enumerate(rows)], OCC)


def rev(spark, rows):
    """(id, part, fingerprint or None, density or None); assemblies have no fingerprint."""
    return spark.createDataFrame([(r, p, int(r[-1]) if r[-1].isdigit() else 1, f, int(f is None), d, "steel", "released", "ann") for r, p, f, d in rows], REV)


def part(spark, ids):
    return spark.createDataFrame([(p, p.upper(), "team-" + p[0], p) for p in ids], PART)


def contract(spark, rows):
    return spark.createDataFrame([(r, "c-" + r, h, a, None, "declared", 1) for r, h, a in rows], CONTRACT)
