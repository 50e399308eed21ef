"""Further derived inputs, as SQL that runs on both engines (Spark reads them with
the fixture tables bound to the ``fx_`` names)."""

VIEWS = {
    # Sockets of assemblies for their directly held leaf parts.
    "fx_socket": """
SELECT CONCAT('sk-', CAST(o.parent_rev AS STRING), '-', o.instance_name) AS socket_id, o.parent_rev AS revision_id,
       CONCAT('s-', o.instance_name) AS name, 'bolt_pattern' AS kind, r.part_id AS filler_part,
       CASE WHEN r.part_id % 11 = 0 THEN CONCAT(o.instance_name, '/', p.part_number) ELSE o.instance_name END AS fills,
       CASE WHEN r.part_id % 6 = 0 THEN 'foot' WHEN r.part_id % 6 = 1 THEN 'face' ELSE NULL END AS interface_name,
       CASE WHEN r.part_id % 9 = 0 THEN 3 WHEN r.part_id % 9 = 1 THEN NULL ELSE 4 END AS hole_count,
       CAST(3.3 AS DOUBLE) AS hole_radius, 'M6' AS fastener, 'clearance' AS fit_class,
       CAST(0.2 AS DOUBLE) AS radius_tol, CAST(0.2 AS DOUBLE) AS spacing_tol,
       CASE WHEN r.part_id % 4 = 0 THEN CAST(40 + r.part_id % 80 AS DOUBLE) ELSE NULL END AS mass_budget,
       CASE WHEN r.part_id % 4 = 1 THEN CAST(3 AS DOUBLE) ELSE NULL END AS power_budget,
       CASE WHEN r.part_id % 4 = 2 THEN CAST(2 AS DOUBLE) ELSE NULL END AS thermal_budget
FROM fx_occurrence o JOIN fx_revision r ON r.revision_id = o.child_rev JOIN fx_part p ON p.part_id = r.part_id
WHERE r.is_assembly = 0 AND o.instance_name <> 'std'""",
    # Named dimensions of revisions, and chain members bound to them.
    "fx_named_dimension": """
SELECT r.revision_id * 10 + k.k AS dimension_id, r.revision_id, CONCAT('d', CAST(k.k AS STRING)) AS name
FROM fx_revision r JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k ON k.k <= 2 + r.revision_index % 2""",
    "fx_bound_member": """
SELECT chain_id, seq, (part_id * 10 + 1) * 10 + 1 + seq % 3 AS dimension_id, direction FROM fx_dimension""",
    "fx_replaced": """
SELECT part_id * 10 + 1 AS old_rev, part_id * 10 + 2 AS new_rev FROM fx_part WHERE n_rev >= 2""",
    "fx_ref": """
SELECT 'main' AS ref_name, MAX(revision_id) AS revision_id FROM fx_revision WHERE part_id = 0
UNION ALL SELECT CONCAT('branch-', CAST(part_id AS STRING)), part_id * 10 + 1 FROM fx_proposal""",
    "fx_name": """
SELECT CAST(revision_id AS STRING) AS name FROM fx_revision UNION ALL SELECT part_number FROM fx_part
UNION ALL SELECT ref_name FROM fx_ref UNION ALL SELECT CONCAT('none-', CAST(part_id AS STRING)) FROM fx_part""",
    "fx_ack": """
SELECT notification_id, CONCAT('user', CAST(notification_id % 3 AS STRING)) AS acknowledged_by, commit_id AS at
FROM fx_notification WHERE notification_id % 2 = 0""",
    "fx_text": """
SELECT part_id AS text_id, CONCAT('does ', LOWER(part_number), ' fit ', description, '? see AB-', CAST(part_id % 7 AS STRING)) AS text
FROM fx_part WHERE part_id % 3 > 0
UNION ALL SELECT part_id, CONCAT('how about XZ-', CAST(part_id AS STRING), '-Q then') FROM fx_part WHERE part_id % 3 = 0""",
    "fx_definition": """
SELECT l_suppkey AS file_id, l_partkey AS definition_key, p_brand AS name, MIN(l_orderkey * 10 + l_linenumber) AS first_seen
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey, p_brand""",
    # Invariants of the box shapes in closed form, and probes a little off them.
    "fx_invariant": """
SELECT fingerprint, chirality, char_length, volume, area, dx, dy, dz,
       POWER(CAST(3.141592653589793 AS DOUBLE), CAST(1 AS DOUBLE) / 3) * POWER(6 * volume, CAST(2 AS DOUBLE) / 3) / area AS sphericity,
       POWER(volume, CAST(-2 AS DOUBLE) / 3) * LEAST(dx, dy, dz) * LEAST(dx, dy, dz) / 12 AS j1,
       POWER(volume, CAST(-2 AS DOUBLE) / 3) * (dx + dy + dz - LEAST(dx, dy, dz) - GREATEST(dx, dy, dz)) * (dx + dy + dz - LEAST(dx, dy, dz) - GREATEST(dx, dy, dz)) / 12 AS j2,
       POWER(volume, CAST(-2 AS DOUBLE) / 3) * GREATEST(dx, dy, dz) * GREATEST(dx, dy, dz) / 12 AS j3
FROM fx_shape""",
    "fx_probe": """
SELECT p.probe_id, p.truth, p.char_length, p.chirality, i.sphericity, i.j1, i.j2, i.j3,
       CASE WHEN RIGHT(p.probe_id, 1) = '3' THEN p.truth WHEN RIGHT(p.probe_id, 1) = '1' THEN CONCAT('alias-', p.truth) ELSE p.probe_id END AS strict
FROM fx_shape_probe p JOIN fx_invariant i ON i.fingerprint = p.truth""",
    "fx_alias": "SELECT CONCAT('alias-', fingerprint) AS alias_fingerprint, fingerprint FROM fx_shape WHERE chirality > 0",
    # Faces of the box shapes: six planes, and four holes as seam-split half cylinders,
    # some counterbored, chamfered or broken out.
    "fx_face": """
SELECT fingerprint, CAST(f.f AS BIGINT) AS face_id, 'plane' AS kind,
       CASE WHEN f.f < 2 THEN dy * dz WHEN f.f < 4 THEN dx * dz ELSE dx * dy END AS area,
       CAST(CASE WHEN f.f = 0 THEN -1 WHEN f.f = 1 THEN 1 ELSE 0 END AS DOUBLE) AS nx,
       CAST(CASE WHEN f.f = 2 THEN -1 WHEN f.f = 3 THEN 1 ELSE 0 END AS DOUBLE) AS ny,
       CAST(CASE WHEN f.f = 4 THEN -1 WHEN f.f = 5 THEN 1 ELSE 0 END AS DOUBLE) AS nz,
       CASE WHEN f.f = 1 THEN dx ELSE CAST(0 AS DOUBLE) END AS ox, CASE WHEN f.f = 3 THEN dy ELSE CAST(0 AS DOUBLE) END AS oy,
       CASE WHEN f.f = 5 THEN dz ELSE CAST(0 AS DOUBLE) END AS oz,
       CAST(NULL AS DOUBLE) AS axis_x, CAST(NULL AS DOUBLE) AS axis_y, CAST(NULL AS DOUBLE) AS axis_z,
       CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, CAST(NULL AS DOUBLE) AS pz, CAST(NULL AS DOUBLE) AS radius,
       FALSE AS internal, CAST(NULL AS DOUBLE) AS extent, CAST(NULL AS DOUBLE) AS sweep
FROM fx_shape s JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) f ON f.f >= 0
UNION ALL
SELECT fingerprint, CAST(10 + h.h * 10 + r.r AS BIGINT), CASE WHEN r.r = 4 THEN 'cone' ELSE 'cylinder' END, CAST(1 AS DOUBLE),
       NULL, NULL, NULL, NULL, NULL, NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(CASE WHEN r.r % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE),
       dx / 5 + CASE WHEN h.h IN (1, 3) THEN dx / 2 ELSE CAST(0 AS DOUBLE) END, dy / 5 + CASE WHEN h.h >= 2 THEN dy / 2 ELSE CAST(0 AS DOUBLE) END,
       CAST(r.r * 3 AS DOUBLE), CASE WHEN r.r IN (2, 3) THEN CAST(5.5 AS DOUBLE) ELSE CAST(3.3 AS DOUBLE) + CAST(h.h AS DOUBLE) / 100000 END, TRUE,
       CASE WHEN r.r IN (2, 3) THEN CAST(2 AS DOUBLE) ELSE dz - CASE WHEN chirality = 1 THEN 2 ELSE 0 END END, CAST(3.141592653589793 AS DOUBLE)
FROM fx_shape s JOIN (SELECT 0 AS h UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) h ON h.h >= 0
JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r
  ON r.r < 2 AND NOT (r.r = 1 AND h.h = 3 AND dx > 50) OR r.r IN (2, 3) AND chirality = 1 OR r.r = 4 AND h.h = 0""",
    "fx_solid": """
SELECT CONCAT('S', CAST(p_partkey AS STRING)) AS solid_id, p_brand AS case_id, CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 3 = 1 THEN 'b' ELSE 'c' END AS variant,
       i.fingerprint AS strict, i.char_length, i.chirality, i.sphericity, i.j1, i.j2, i.j3
FROM part JOIN fx_invariant i ON i.fingerprint = CONCAT(p_type, '-', CAST(p_size AS STRING))""",
    # Source trees: every supplier's file holds the parts of its line items below one node per order.
    "fx_source_node": """
SELECT l_suppkey AS file_id, CONCAT('r', CAST(l_suppkey AS STRING)) AS node_id, CAST(NULL AS STRING) AS parent_id, CONCAT('root-', CAST(l_suppkey AS STRING)) AS definition_key,
       CONCAT('FILE-', CAST(l_suppkey AS STRING)) AS name, '' AS instance_name, CAST(NULL AS STRING) AS solid_id, 1 AS quantity, CAST(0 AS BIGINT) AS position,
       CAST(0 AS DOUBLE) AS tx, CAST(0 AS BIGINT) AS quarter_turns FROM lineitem GROUP BY l_suppkey
UNION ALL
SELECT l_suppkey, CONCAT('o', CAST(l_orderkey AS STRING)), CONCAT('r', CAST(l_suppkey AS STRING)), CONCAT('order-', CAST(l_orderkey AS STRING)), CONCAT('KIT-', CAST(MIN(l_linenumber) AS STRING)),
       CONCAT('k', CAST(l_orderkey AS STRING)), NULL, 1, CAST(l_orderkey * 100 AS BIGINT), CAST(l_orderkey % 50 AS DOUBLE), CAST(l_orderkey % 4 AS BIGINT) FROM lineitem GROUP BY l_suppkey, l_orderkey
UNION ALL
SELECT l_suppkey, CONCAT('l', CAST(l_orderkey AS STRING), '-', CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS STRING)), CONCAT('o', CAST(l_orderkey AS STRING)),
       CONCAT('part-', CAST(l_partkey AS STRING)), p_brand, '', CONCAT(p_type, '-', CAST(p_size AS STRING)), CAST(l_quantity AS INT), CAST(l_orderkey * 100 + l_linenumber AS BIGINT), CAST(l_linenumber AS DOUBLE), CAST(l_linenumber % 4 AS BIGINT)
FROM lineitem JOIN part ON p_partkey = l_partkey""",
}
