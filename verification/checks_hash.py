"""Pose keys, configuration hashes and structural diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import digest, pose
from partloom.operators import diff, graph, hashing
from partloom.session import cut

from .registry import query, shared

_TURN = "CASE quarter_turns WHEN 0 THEN '100000|0|0|0' WHEN 1 THEN '70711|0|0|70711' WHEN 2 THEN '0|0|0|100000' ELSE '70711|0|0|-70711' END"
_OCC = f"""occ AS (SELECT *, 't:' || CAST(CAST(tx * 1000 AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(ty * 1000 AS BIGINT) AS VARCHAR) || '|0;q:' || {_TURN} AS pose FROM fx_occurrence)"""


@query("f05_pose_key", f"WITH {_OCC} SELECT parent_rev, child_rev, instance_name, pose AS transform_key FROM occ")
def _(fx):
    # A little noise below the grid must not change the key.
    noisy = fx.occurrence.drop("transform_key")
    for i, c in enumerate(pose.COLUMNS):
        noisy = noisy.withColumn(c, F.col(c) + F.lit(1e-8) * (i - 6))
    return pose.with_pose_key(noisy).select("parent_rev", "child_rev", "instance_name", "transform_key")


@query("f01_compose_invert", "SELECT parent_rev, child_rev, instance_name, 'identity' AS placement FROM fx_occurrence")
def _(fx):
    back = fx.occurrence.select("*", *pose.invert(out="i_"))
    both = back.select("parent_rev", "child_rev", "instance_name", *pose.compose("", "i_", "c_"))
    same = sum((F.abs(F.col(f"c_{c}") - i) for c, i in zip(pose.COLUMNS, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])), F.lit(0.0)) < 1e-9
    return both.select("parent_rev", "child_rev", "instance_name", F.when(same, "identity").otherwise("other").alias("placement"))


@query("f02_snap", """
SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount IN (0.0, 0.5, 1.0) THEN l_discount ELSE l_discount + 0.0000005 END AS snapped
FROM lineitem""")
def _(fx):
    x = F.col("l_discount") + 0.0000005
    return fx.raw("lineitem").select("l_orderkey", "l_linenumber", "l_discount", pose.snap(x).alias("snapped"))


def _dig(*parts: str) -> str:
    def framed(p):
        v = f"COALESCE(CAST({p} AS VARCHAR), '')"
        return f"CAST(length({v}) AS VARCHAR) || ':' || {v}"
    return "substr(sha256(" + " || ".join(framed(p) for p in parts) + "), 1, 16)"


_DENS = "regexp_replace(CAST(CAST(round(density, 9) AS DECIMAL(38,18)) AS VARCHAR), '\\.?0+$', '')"
_ATTR = f"""attr AS (SELECT r.*, {_dig("'attributes'", "c.contract_hash", "r.material", f"CASE WHEN r.density IS NOT NULL THEN {_DENS.replace('density', 'r.density')} END")} AS attrs
                     FROM fx_revision r LEFT JOIN fx_contract c ON c.revision_id = r.revision_id)"""


@query("f08_attribute_digest", f"WITH {_ATTR} SELECT revision_id, attrs FROM attr")
def _(fx):
    df = fx.revision.join(fx.contract.select("revision_id", "contract_hash"), "revision_id", "left")
    return df.select("revision_id", digest.attributes(F.col("contract_hash"), F.col("material"), F.col("density")).alias("attrs"))


_LANE = "CAST('0x' || substr(sha256(h.node_hash || '|' || o.pose || '|' || CAST(o.quantity AS VARCHAR)), {s}, 15) AS BIGINT)"


def _merkle_sql(levels: int = 7) -> str:
    """One CTE per height; the height of a revision is its longest way down."""
    out = [_OCC, _ATTR, """hgt AS (SELECT rev, MAX(h) AS h FROM up GROUP BY rev)""",
           f"""l0 AS (SELECT a.revision_id, {_dig("'leaf'", "a.fingerprint", "a.attrs")} AS node_hash FROM attr a JOIN hgt ON hgt.rev = a.revision_id WHERE hgt.h = 0)""",
           "u0 AS (SELECT * FROM l0)"]
    for k in range(1, levels + 1):
        lanes = ", ".join(f"SUM({_LANE.format(s=1 + 15 * i)}) AS x{i}" for i in range(4))
        out.append(f"""l{k} AS (SELECT t.revision_id, {_dig("'node'", "t.attrs", "t.n", "t.x0", "t.x1", "t.x2", "t.x3")} AS node_hash FROM (
            SELECT a.revision_id, a.attrs, COUNT(*) AS n, {lanes} FROM attr a JOIN hgt ON hgt.rev = a.revision_id AND hgt.h = {k}
            JOIN occ o ON o.parent_rev = a.revision_id JOIN u{k - 1} h ON h.revision_id = o.child_rev GROUP BY a.revision_id, a.attrs) t)""")
        out.append(f"u{k} AS MATERIALIZED (SELECT * FROM u{k - 1} UNION ALL SELECT * FROM l{k})")
    rec = """up(rev, h) AS (SELECT r.revision_id, 0 FROM fx_revision r WHERE r.is_assembly = 0
             UNION SELECT o.parent_rev, up.h + 1 FROM up JOIN fx_occurrence o ON o.child_rev = up.rev)"""
    return "WITH RECURSIVE " + ", ".join([rec, *out]) + f" SELECT revision_id, node_hash FROM u{levels}"


def hashes(fx):
    return shared(fx, "hashes", lambda: cut(hashing.node_hashes(fx.revision, fx.occurrence, fx.contract)))


@query("a13_node_hashes", _merkle_sql())
def _(fx):
    return hashes(fx).select("revision_id", "node_hash")


@query("s18_store_hashes", _merkle_sql().replace("SELECT revision_id, node_hash FROM u7",
       "SELECT r.revision_id, r.part_id, u.node_hash AS merkle_hash FROM fx_revision r LEFT JOIN u7 u ON u.revision_id = r.revision_id"))
def _(fx):
    return hashing.with_hashes(fx.revision, hashes(fx)).select("revision_id", "part_id", "merkle_hash")


@query("s13_hashed_tree", _merkle_sql().replace("SELECT revision_id, node_hash FROM u7", """,
walk(rev, path, qty) AS (
  SELECT r.revision_id, p.part_number, CAST(1 AS BIGINT) FROM fx_revision r JOIN fx_part p ON p.part_id = r.part_id
  WHERE r.revision_id = (SELECT MAX(revision_id) FROM fx_revision WHERE part_id = 0)
  UNION ALL SELECT o.child_rev, w.path || '/' || o.instance_name, w.qty * o.quantity FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev)
SELECT w.path, w.qty AS quantity, u.node_hash, r.fingerprint FROM walk w JOIN u7 u ON u.revision_id = w.rev JOIN fx_revision r ON r.revision_id = w.rev"""))
def _(fx):
    tree = hashing.hashed_tree(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape, hashes(fx))
    return tree.select("path", "quantity", "node_hash", "fingerprint")


@query("g09_occurrences_of_part", """
WITH RECURSIVE walk(rev, path, depth) AS (
  SELECT r.revision_id, p.part_number, 0 FROM fx_revision r JOIN fx_part p ON p.part_id = r.part_id
  WHERE r.revision_id = (SELECT MAX(revision_id) FROM fx_revision WHERE part_id = 0)
  UNION ALL SELECT o.child_rev, w.path || '/' || o.instance_name, w.depth + 1 FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev)
SELECT w.path, w.rev AS revision_id, w.depth FROM walk w JOIN fx_revision r ON r.revision_id = w.rev
WHERE r.part_id = (SELECT MAX(part_id) FROM fx_part)""")
def _(fx):
    number = "BOLT-" + str(fx.part.agg(F.max("part_id")).first()[0])
    tree = hashing.hashed_tree(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape, hashes(fx))
    return hashing.occurrences_of(tree, number).select("path", "revision_id", "depth")


def revision_pairs(fx):
    """Each assembly revision with the next one of the same part."""
    r = fx.revision.filter("is_assembly = 1").select("part_id", "revision_index", "revision_id")
    nxt = r.select("part_id", (F.col("revision_index") - 1).alias("revision_index"), F.col("revision_id").alias("right_rev"))
    return r.join(nxt, ["part_id", "revision_index"]).select(
        F.col("revision_id").alias("pair_id"), F.col("revision_id").alias("left_rev"), "right_rev")


def differences(fx):
    return shared(fx, "differences", lambda: cut(diff.diff_configurations(revision_pairs(fx), fx.occurrence, fx.revision, fx.part, hashes(fx))))


@query("g08_diff")
def _(fx):
    return differences(fx)


@query("u06_directly_changed")
def _(fx):
    return diff.directly_changed(differences(fx))


# Every revision against the next one of its part. The older list lacks every fifth child, the newer one every
# seventh; odd children differ in quantity, and in the newer list some moved and some of these have another name.
_SIB_KEYS = [["h", "pose", "quantity"], ["part_id", "pose"], ["part_id", "instance_name"], ["part_id"]]
_SIB = f"""WITH {_OCC}, base AS (
  SELECT p.part_id AS parent, p.n_rev, r.revision_index AS idx, CONCAT(CAST(o.parent_rev AS STRING), '/', o.instance_name) AS id,
         CAST(o.child_rev AS STRING) || '|' || o.pose AS sort_key, c.part_id, o.instance_name, o.pose, CAST(o.quantity AS BIGINT) AS quantity, COALESCE(c.fingerprint, 'none') AS h
  FROM occ o JOIN fx_revision r ON r.revision_id = o.parent_rev JOIN fx_part p ON p.part_id = r.part_id JOIN fx_revision c ON c.revision_id = o.child_rev),
p0 AS (
  SELECT parent || '/' || idx AS grp, 0 AS side, id, sort_key, part_id, instance_name, pose, quantity + part_id % 2 AS quantity, h FROM base WHERE idx < n_rev AND part_id % 5 > 0
  UNION ALL SELECT parent || '/' || (idx - 1), 1, id, sort_key, part_id, CASE WHEN part_id % 9 = 0 THEN 'renamed' ELSE instance_name END,
    CASE WHEN part_id % 3 = 0 THEN 'moved' ELSE pose END, quantity, h FROM base WHERE idx > 1 AND part_id % 7 > 0)"""
for _n, _key in enumerate(_SIB_KEYS, start=1):
    _SIB += f""",
r{_n} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp, side, {', '.join(_key)} ORDER BY sort_key, id) AS rn FROM p{_n - 1}),
m{_n} AS (SELECT a.grp, a.id AS left_id, b.id AS right_id FROM r{_n} a JOIN r{_n} b ON a.side = 0 AND b.side = 1 AND a.grp = b.grp AND a.rn = b.rn AND {' AND '.join(f'a.{k} = b.{k}' for k in _key)}),
p{_n} AS (SELECT * EXCLUDE (rn) FROM r{_n} x WHERE NOT EXISTS (SELECT 1 FROM m{_n} m WHERE m.grp = x.grp AND x.id = CASE x.side WHEN 0 THEN m.left_id ELSE m.right_id END))"""


@query("j12_pair_children", _SIB + """
SELECT grp, 'both' AS side, left_id, right_id FROM (SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4) m
UNION ALL SELECT grp, CASE side WHEN 0 THEN 'left' ELSE 'right' END, CASE side WHEN 0 THEN id END, CASE side WHEN 1 THEN id END FROM p4""")
def _(fx):
    r = fx.revision.join(fx.part.select("part_id", "n_rev"), "part_id")
    par = r.select(F.col("revision_id").alias("parent_rev"), F.col("part_id").alias("parent"), F.col("revision_index").alias("idx"), "n_rev")
    kid = fx.revision.select(F.col("revision_id").alias("child_rev"), "part_id", F.coalesce("fingerprint", F.lit("none")).alias("node_hash"))
    e = fx.occurrence.join(par, "parent_rev").join(kid, "child_rev").withColumn("label", F.col("occurrence_id"))
    group = lambda back: F.concat_ws("/", F.col("parent").cast("string"), (F.col("idx") - back).cast("string"))
    left = e.filter("idx < n_rev AND part_id % 5 > 0").withColumn("grp", group(0)).withColumn("quantity", F.col("quantity") + F.col("part_id") % 2)
    right = e.filter("idx > 1 AND part_id % 7 > 0").withColumn("grp", group(1)).withColumn(
        "instance_name", F.when(F.expr("part_id % 9 = 0"), "renamed").otherwise(F.col("instance_name"))).withColumn(
        "transform_key", F.when(F.expr("part_id % 3 = 0"), "moved").otherwise(F.col("transform_key")))
    both, lost, new = diff.pair_children(left, right, "grp")
    none = F.lit(None).cast("string")
    return both.select("grp", F.lit("both").alias("side"), F.col("l_occurrence_id").alias("left_id"), F.col("r_occurrence_id").alias("right_id")).unionByName(
        lost.select("grp", F.lit("left").alias("side"), F.col("occurrence_id").alias("left_id"), none.alias("right_id"))).unionByName(
        new.select("grp", F.lit("right").alias("side"), none.alias("left_id"), F.col("occurrence_id").alias("right_id")))


@query("f03_nearest_rotation", """
SELECT parent_rev, instance_name, CASE quarter_turns WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS r00, CASE quarter_turns WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS r10, 1 AS r22 FROM fx_occurrence""")
def _(fx):
    # Scaled and slightly sheared rotations come back proper.
    m = [F.col(f"m{i}{j}") * 1.5 + (1e-9 if i < j else 0.0) for i in range(3) for j in range(3)]
    r = fx.occurrence.select("parent_rev", "instance_name", pose.nearest_rotation(*m).alias("r"))
    return r.select("parent_rev", "instance_name", *[F.round(F.col(f"r.{c}")).cast("int").alias(c) for c in ("r00", "r10", "r22")])


@query("f04_quaternion", """
SELECT parent_rev, instance_name, CASE quarter_turns WHEN 0 THEN 100000 WHEN 2 THEN 0 ELSE 70711 END AS w, CASE quarter_turns WHEN 0 THEN 0 WHEN 1 THEN 70711 WHEN 2 THEN 100000 ELSE -70711 END AS z FROM fx_occurrence""")
def _(fx):
    k = pose.with_pose_key(fx.occurrence.select("parent_rev", "instance_name", *pose.COLUMNS))
    q = F.split(F.substring_index("transform_key", "q:", -1), "[|]")
    return k.select("parent_rev", "instance_name", q[0].cast("int").alias("w"), q[3].cast("int").alias("z"))
