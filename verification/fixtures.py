"""Product tables derived from the star-schema tables of a folder.

The same rows as the SQL views in FIXTURES.md, written so that each view is a
narrow pass over one Parquet scan wherever the keys allow it: no cross joins, and
no join where a column can be computed from the key.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from partloom.functions.ranking import rank_within
from partloom.session import cut, sizes_of_rows

_BOX_CORNERS = "array(struct(0,0,0), struct(1,0,0), struct(1,1,0), struct(0,1,0), " \
               "struct(0,0,1), struct(1,0,1), struct(1,1,1), struct(0,1,1))"
# Twelve outward-wound triangles over the corner numbers above.
_BOX_FACES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4),
              (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def _stored(build):
    """Write a base table once per session, as a deployment would have it on disk."""
    def table(self: "Fixtures") -> DataFrame:
        return cut(build(self))
    return table


class Fixtures:
    """Lazy tables over one data folder; each attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        sizes_of_rows(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    @cached_property
    def keyed_part(self) -> DataFrame:
        p = self.raw("part")
        return self.sql("SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, (SELECT COUNT(*) FROM {p}) AS n FROM {p}", p=p)

    @cached_property
    @_stored
    def part(self) -> DataFrame:
        return self.sql("""
            SELECT k AS part_id, CONCAT(CASE WHEN k >= n - 40 THEN 'BOLT-' ELSE 'PN-' END, k) AS part_number,
                   p_name AS description, p_brand AS team_id, CONCAT(p_type, '-', p_size) AS fingerprint,
                   1 + k % 3 AS n_rev, CASE WHEN 4 * k + 1 < n THEN 1 ELSE 0 END AS is_assembly
            FROM {p}""", p=self.keyed_part)

    @cached_property
    @_stored
    def edge(self) -> DataFrame:
        return self.sql("""
            SELECT CAST(FLOOR((k - 1) / 4) AS BIGINT) AS parent_part, k AS child_part, CONCAT('i', k) AS instance_name,
                   1 + k % 3 AS quantity, CAST(10 * (k % 7) AS DOUBLE) AS tx, CAST(5 * (k % 11) AS DOUBLE) AS ty,
                   CAST(k % 4 AS BIGINT) AS quarter_turns
            FROM {p} WHERE k > 0
            UNION ALL
            SELECT k, n - 1 - (k % 40), 'std', 1 + k % 6, 0D, 0D, 0L FROM {p} WHERE 4 * k + 1 < n""",
                        p=self.keyed_part)

    @cached_property
    @_stored
    def revision(self) -> DataFrame:
        return self.sql("""
            SELECT part_id * 10 + i AS revision_id, part_id, i AS revision_index,
                   CASE WHEN is_assembly = 1 THEN NULL ELSE fingerprint END AS fingerprint, is_assembly,
                   CASE WHEN is_assembly = 1 OR part_id % 17 = 0 THEN NULL
                        ELSE 0.0027D + 0.001D * (part_id % 5) END AS density,
                   CASE WHEN part_id % 17 = 0 THEN NULL WHEN part_id % 2 = 0 THEN 'steel' ELSE 'aluminium' END AS material,
                   CASE WHEN part_id % 23 = 0 THEN 'draft' ELSE 'released' END AS status,
                   CONCAT('author', part_id % 9) AS author
            FROM (SELECT *, explode(sequence(1, CAST(n_rev AS INT))) AS i FROM {p})""", p=self.part)

    @cached_property
    def edges_by_revision(self) -> DataFrame:
        return self.sql("""
            SELECT parent_part * 10 + i AS parent_rev,
                   child_part * 10 + CASE WHEN i < 1 + parent_part % 3 AND i < 1 + child_part % 3 THEN i
                                          ELSE 1 + child_part % 3 END AS child_rev,
                   instance_name, quantity, tx, ty, quarter_turns
            FROM (SELECT *, explode(sequence(1, CAST(1 + parent_part % 3 AS INT))) AS i FROM {e})""", e=self.edge)

    @cached_property
    @_stored
    def occurrence(self) -> DataFrame:
        """Edges in the stored shape: pose columns, pose key, sort key and an id."""
        return self.sql("""
            SELECT CONCAT(parent_rev, '/', instance_name) AS occurrence_id, parent_rev, child_rev, instance_name,
                   CAST(quantity AS BIGINT) AS quantity,
                   c AS m00, -s AS m01, 0D AS m02, tx AS m03, s AS m10, c AS m11, 0D AS m12, ty AS m13,
                   0D AS m20, 0D AS m21, 1D AS m22, 0D AS m23, pose AS transform_key,
                   CONCAT(child_rev, '|', pose) AS sort_key
            FROM (SELECT *, CASE quarter_turns WHEN 0 THEN 1D WHEN 2 THEN -1D ELSE 0D END AS c,
                         CASE quarter_turns WHEN 1 THEN 1D WHEN 3 THEN -1D ELSE 0D END AS s,
                         CONCAT('t:', CAST(tx * 1000 AS BIGINT), '|', CAST(ty * 1000 AS BIGINT), '|0;q:',
                                CASE quarter_turns WHEN 0 THEN '100000|0|0|0' WHEN 1 THEN '70711|0|0|70711'
                                     WHEN 2 THEN '0|0|0|100000' ELSE '70711|0|0|-70711' END) AS pose
                  FROM {e})""", e=self.edges_by_revision)

    @cached_property
    @_stored
    def shape(self) -> DataFrame:
        return self.sql("""
            SELECT fingerprint, dx, dy, dz, dx * dy * dz AS volume,
                   CASE WHEN s % 11 = 0 THEN NULL ELSE dx * dy * dz END AS volume_exact,
                   2 * (dx * dy + dy * dz + dx * dz) AS area, POWER(dx * dy * dz, 1D / 3) AS char_length,
                   CAST(s % 3 - 1 AS INT) AS chirality, dx / 2 AS com_x, dy / 2 AS com_y, dz / 2 AS com_z,
                   dx AS bbox_dx, dy AS bbox_dy, dz AS bbox_dz, 0D AS bbox_xmin, 0D AS bbox_ymin, 0D AS bbox_zmin,
                   dx AS bbox_xmax, dy AS bbox_ymax, dz AS bbox_zmax
            FROM (SELECT DISTINCT CONCAT(p_type, '-', p_size) AS fingerprint, p_size AS s,
                         CAST(10 + p_size AS DOUBLE) AS dx, CAST(20 + LENGTH(p_type) AS DOUBLE) AS dy,
                         CAST(5 + p_size % 7 AS DOUBLE) AS dz FROM {p})""", p=self.keyed_part)

    @cached_property
    @_stored
    def contract(self) -> DataFrame:
        return self.sql("""
            SELECT revision_id, CONCAT('con-', revision_id) AS contract_id,
                   CASE WHEN part_id % 19 = 0 THEN 'auto_drafted' ELSE 'declared' END AS provenance,
                   CASE WHEN part_id % 19 = 0 THEN 0 ELSE 1 END AS reviewed,
                   CAST(2000 * (1 + part_id % 50) AS DOUBLE) AS mass_max,
                   CONCAT('{{"power_w":', part_id % 8, ',"thermal_w":', part_id % 5, '}}') AS attributes,
                   CONCAT('h', part_id % 101, '-', CASE WHEN part_id % 2 = 0 THEN 1 ELSE revision_index END) AS contract_hash
            FROM {r} WHERE part_id % 13 <> 0""", r=self.revision)

    @cached_property
    def interface(self) -> DataFrame:
        return self.sql("""
            SELECT revision_id, CONCAT('if-', revision_id) AS interface_id, 'foot' AS name, 'bolt_pattern' AS kind,
                   4 AS hole_count, 3.3D + 0.05D * (part_id % 5) AS hole_radius, 'M6' AS fastener,
                   CASE WHEN part_id % 4 = 0 THEN 'close' ELSE 'clearance' END AS fit_class, 0.1D AS spacing_tol,
                   CAST(40 + 10 * (part_id % 3) AS DOUBLE) AS w, 30D AS h
            FROM {r} WHERE is_assembly = 0""", r=self.revision)

    @cached_property
    def interface_point(self) -> DataFrame:
        return self.sql("""
            SELECT interface_id, k AS seq, CASE WHEN k IN (1, 2) THEN w ELSE 0D END AS x,
                   CASE WHEN k IN (2, 3) THEN h ELSE 0D END AS y, 0D AS z
            FROM (SELECT *, explode(sequence(0, 3)) AS k FROM {i})""", i=self.interface)

    @cached_property
    def full_interface(self) -> DataFrame:
        """Interfaces with their points as one array cell, in the stored shape."""
        return self.sql("""
            SELECT revision_id, interface_id, name, kind, hole_count, hole_radius, fastener, fit_class,
                   0.1D AS radius_tol, spacing_tol, w / 2 AS ox, h / 2 AS oy, 0D AS oz, 0D AS nx, 0D AS ny, -1D AS nz,
                   array(named_struct('x', 0D, 'y', 0D, 'z', 0D), named_struct('x', w, 'y', 0D, 'z', 0D),
                         named_struct('x', w, 'y', h, 'z', 0D), named_struct('x', 0D, 'y', h, 'z', 0D)) AS points
            FROM {i}""", i=self.interface)

    @cached_property
    @_stored
    def numbered_line(self) -> DataFrame:
        """Line items numbered within their order, once for all tables that are made of them."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        return rank_within(self.raw("lineitem"), ["l_orderkey"], order, "n", split=False).select(
            "n", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

    @cached_property
    @_stored
    def source_line(self) -> DataFrame:
        """Line items with the names of their part, for source trees: ``n`` is the number in the order of those that have a
        part (``found``), ``kit`` the least line of their supplier there, and one of these lines ``opens``."""
        l, p = self.raw("lineitem"), self.raw("part")
        named = self.sql("""
            SELECT l.*, p_brand, CONCAT(p_type, '-', CAST(p_size AS STRING)) AS solid, p_partkey IS NOT NULL AS found
            FROM {l} l LEFT JOIN {p} p ON p_partkey = l_partkey""", l=l, p=p).repartition("l_orderkey")
        return self.sql("""
            SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, p_brand, solid, found,
                   ROW_NUMBER() OVER (PARTITION BY l_orderkey, found ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
                   MIN(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS kit,
                   ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 1 AS opens
            FROM {l}""", l=named)

    @cached_property
    def source_node(self) -> DataFrame:
        """Source trees, as fx_source_node in SQL: a narrow pass over the stored lines."""
        return self.sql("""
            SELECT l_suppkey AS file_id, CONCAT('r', CAST(l_suppkey AS STRING)) AS node_id, CAST(NULL AS STRING) AS parent_id,
                   CONCAT('root-', CAST(l_suppkey AS STRING)) AS definition_key, CONCAT('FILE-', CAST(l_suppkey AS STRING)) AS name,
                   '' AS instance_name, CAST(NULL AS STRING) AS solid_id, 1 AS quantity, CAST(0 AS BIGINT) AS position,
                   CAST(0 AS DOUBLE) AS tx, CAST(0 AS BIGINT) AS quarter_turns
            FROM (SELECT DISTINCT l_suppkey FROM {l})
            UNION ALL
            SELECT l_suppkey, CONCAT('o', CAST(l_orderkey AS STRING)), CONCAT('r', CAST(l_suppkey AS STRING)), CONCAT('order-', CAST(l_orderkey AS STRING)),
                   CONCAT('KIT-', CAST(kit AS STRING)), CONCAT('k', CAST(l_orderkey AS STRING)), NULL, 1, CAST(l_orderkey * 100 AS BIGINT),
                   CAST(l_orderkey % 50 AS DOUBLE), CAST(l_orderkey % 4 AS BIGINT)
            FROM {l} WHERE opens
            UNION ALL
            SELECT l_suppkey, CONCAT('l', CAST(l_orderkey AS STRING), '-', CAST(n AS STRING)), CONCAT('o', CAST(l_orderkey AS STRING)),
                   CONCAT('part-', CAST(l_partkey AS STRING)), p_brand, '', solid, CAST(l_quantity AS INT), CAST(l_orderkey * 100 + l_linenumber AS BIGINT),
                   CAST(l_linenumber AS DOUBLE), CAST(l_linenumber % 4 AS BIGINT)
            FROM {l} WHERE found""", l=self.source_line)

    @cached_property
    def dimension(self) -> DataFrame:
        """Chain members with their dimension, numbered in the chain."""
        return self.sql("""
            SELECT l_orderkey AS chain_id, n AS seq, l_partkey AS part_id, l_quantity AS nominal, l_discount AS tol_plus,
                   l_tax AS tol_minus, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS direction,
                   CASE WHEN l_linenumber % 3 = 0 THEN 1D ELSE 3D END AS sigma_span,
                   CASE WHEN l_linestatus = 'F' THEN 'normal' WHEN l_linenumber % 2 = 0 THEN 'uniform'
                        ELSE 'triangular' END AS distribution
            FROM {l}""", l=self.numbered_line)

    @cached_property
    def member(self) -> DataFrame:
        """Members without their number, for answers that do not use it (no window)."""
        return self.sql("""
            SELECT l_orderkey AS chain_id, l_partkey AS part_id, l_quantity AS nominal, l_discount AS tol_plus,
                   l_tax AS tol_minus, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS direction,
                   CASE WHEN l_linenumber % 3 = 0 THEN 1D ELSE 3D END AS sigma_span,
                   CASE WHEN l_linestatus = 'F' THEN 'normal' WHEN l_linenumber % 2 = 0 THEN 'uniform'
                        ELSE 'triangular' END AS distribution
            FROM {l}""", l=self.raw("lineitem"))

    @cached_property
    def chain(self) -> DataFrame:
        return self.sql("""
            SELECT o_orderkey AS chain_id, CONCAT('chain', o_orderkey) AS name,
                   CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS target_low,
                   CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(60 + o_orderkey % 90 AS DOUBLE) END AS target_high,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'worst_case'
                        WHEN o_orderpriority = '5-LOW' THEN 'monte_carlo' ELSE 'rss' END AS method
            FROM {o}""", o=self.raw("orders"))

    @cached_property
    def commit(self) -> DataFrame:
        return self.sql("""
            SELECT o_orderkey AS commit_id, CONCAT('author', o_custkey % 9) AS author, o_orderdate AS created_at,
                   CASE o_orderstatus WHEN 'F' THEN 'landed' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS verdict
            FROM {o}""", o=self.raw("orders"))

    @cached_property
    def validation(self) -> DataFrame:
        return self.sql("""
            SELECT l_orderkey AS commit_id, n AS validation_id,
                   CASE l_linenumber WHEN 1 THEN 'concurrency' WHEN 2 THEN 'declaration' WHEN 3 THEN 'classification'
                        WHEN 4 THEN 'envelope' WHEN 5 THEN 'socket' WHEN 6 THEN 'budget' ELSE 'chain' END AS stage,
                   CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS passed, l_partkey AS part_id
            FROM {l}""", l=self.numbered_line)

    @cached_property
    def subscription(self) -> DataFrame:
        return self.sql("""
            SELECT CONCAT('Brand#', team) AS team_id, part_id, CASE place WHEN 0 THEN NULL WHEN 1 THEN 'foot' ELSE 'face' END AS interface_name
            FROM (SELECT DISTINCT 1 + l_suppkey % 25 AS team, l_partkey AS part_id,
                         CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN 1 ELSE 2 END AS place
                  FROM {l})""", l=self.raw("lineitem"))

    @cached_property
    def outbox(self) -> DataFrame:
        return self.sql("""
            SELECT event_id AS outbox_id, event_type AS topic, CONCAT(event_type, '-', user_id) AS doc_key,
                   props AS payload, ts AS created_at FROM {e}""", e=self.raw("events"))

    @cached_property
    def notification(self) -> DataFrame:
        return self.sql("""
            SELECT event_id AS notification_id, CONCAT('Brand#', 1 + user_id % 25) AS team_id,
                   event_id % (SELECT COUNT(*) FROM {p}) AS part_id, event_id AS commit_id,
                   CASE WHEN value > 20 THEN 1 ELSE 0 END AS acknowledged
            FROM {e} WHERE event_type = 'error'""", e=self.raw("events"), p=self.raw("part"))

    @cached_property
    def triangle(self) -> DataFrame:
        faces = ", ".join(f"struct({a}, {b}, {c})" for a, b, c in _BOX_FACES)
        corner = ", ".join(f"k[f.col{i}].col{j} * d{'xyz'[j - 1]} AS {'abc'[i - 1]}{'xyz'[j - 1]}"
                           for i in (1, 2, 3) for j in (1, 2, 3))
        return self.sql(f"""
            SELECT fingerprint, t AS tri, {corner}
            FROM (SELECT fingerprint, dx, dy, dz, {_BOX_CORNERS} AS k, posexplode(array({faces})) AS (t, f) FROM {{s}})""",
                        s=self.shape)

    @cached_property
    def shape_probe(self) -> DataFrame:
        return self.sql("""
            SELECT CONCAT(fingerprint, '#', k) AS probe_id, fingerprint AS truth,
                   char_length * (1 + (k - 3) * 0.00004D) AS char_length,
                   CASE WHEN k = 5 THEN -chirality ELSE chirality END AS chirality
            FROM (SELECT *, explode(sequence(1, 5)) AS k FROM {s})""", s=self.shape)

    @cached_property
    def proposal(self) -> DataFrame:
        return self.sql("""
            SELECT part_id AS commit_id, part_id, CONCAT('author', part_id % 9) AS author,
                   CONCAT('LARGE-', 1 + part_id % 50) AS new_fingerprint,
                   CONCAT('h', part_id % 101, '-', 1 + part_id % 4) AS new_contract_hash
            FROM {p} WHERE is_assembly = 0 AND part_id % 97 = 5""", p=self.part)

    # -- derived inputs used by several operators -----------------------------

    @cached_property
    def top_root(self) -> DataFrame:
        """The newest revision of part 0, the product root."""
        return self.sql("SELECT MAX(revision_id) AS root_rev FROM {r} WHERE part_id = 0", r=self.revision)

    @cached_property
    def live(self) -> DataFrame:
        """Revisions of the live configuration (below the product root)."""
        from partloom.operators import graph
        return cut(graph.reachable(self.top_root, self.occurrence))
