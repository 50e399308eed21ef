"""Lookups, windows, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from partloom.functions import digest, fits, geometry, text
from partloom.operators import graph, impact, lookup, shapes, tolerance

from .checks_graph import _HOLDERS, _REACH
from .registry import extra, grid, grid_sql, query

_CURRENT = "(SELECT r.* FROM fx_revision r JOIN (SELECT part_id, MAX(revision_index) AS top FROM fx_revision GROUP BY part_id) x ON x.part_id = r.part_id AND x.top = r.revision_index)"


@query("w01_current_revision", f"SELECT revision_id, part_id, revision_index FROM {_CURRENT} c")
def _(fx):
    return lookup.current_revision(fx.revision).select("revision_id", "part_id", "revision_index")


@query("p01_resolve_revisions", f"""
SELECT n.name, COALESCE(a.revision_id, b.revision_id, c.revision_id) AS revision_id,
       CASE WHEN a.revision_id IS NOT NULL THEN 'revision' WHEN b.revision_id IS NOT NULL THEN 'part' WHEN c.revision_id IS NOT NULL THEN 'ref' END AS how
FROM (SELECT DISTINCT name FROM fx_name) n
LEFT JOIN fx_revision a ON CAST(a.revision_id AS STRING) = n.name
LEFT JOIN (SELECT c.revision_id, p.part_number FROM {_CURRENT} c JOIN fx_part p ON p.part_id = c.part_id) b ON b.part_number = n.name
LEFT JOIN fx_ref c ON c.ref_name = n.name""")
def _(fx):
    return lookup.resolve_revisions(extra(fx, "fx_name"), fx.revision, fx.part, extra(fx, "fx_ref"))


@query("p02_resolve_parts", """
SELECT n.name, COALESCE(p.part_id, r.part_id) AS part_id FROM (SELECT DISTINCT name FROM fx_name) n
LEFT JOIN fx_part p ON CAST(p.part_id AS STRING) = n.name OR p.part_number = n.name
LEFT JOIN fx_revision r ON CAST(r.revision_id AS STRING) = n.name""")
def _(fx):
    return lookup.resolve_parts(extra(fx, "fx_name"), fx.revision, fx.part)


@query("p03_revision_of_root", """
SELECT h.root_hash, (SELECT MAX(CAST(revision_index AS BIGINT) * 1000000000 + revision_id) % 1000000000 FROM fx_contract c JOIN fx_revision r USING (revision_id)
                     WHERE c.contract_hash = h.root_hash) AS revision_id
FROM (SELECT DISTINCT new_contract_hash AS root_hash FROM fx_proposal) h""")
def _(fx):
    hashed = fx.revision.join(fx.contract.select("revision_id", F.col("contract_hash").alias("merkle_hash")), "revision_id")
    return lookup.revision_of_root(fx.proposal.select(F.col("new_contract_hash").alias("root_hash")), hashed)


@query("p04_part_mass", """
SELECT r.revision_id, r.part_id, p.part_number, p.team_id, COALESCE(s.volume_exact, s.volume) AS volume, r.density,
       COALESCE(s.volume_exact, s.volume) * COALESCE(r.density, 0) AS mass_g
FROM fx_revision r JOIN fx_part p ON p.part_id = r.part_id LEFT JOIN fx_shape s ON s.fingerprint = r.fingerprint""")
def _(fx):
    return lookup.part_mass(fx.revision, fx.part, fx.shape)


@query("p05_part_listing", f"""
SELECT p.part_number, p.team_id, r.revision_index, r.material, r.fingerprint,
       COALESCE(s.volume_exact, s.volume) * r.density AS mass_g, c.contract_hash, c.provenance
FROM {_CURRENT} r JOIN fx_part p ON p.part_id = r.part_id LEFT JOIN fx_shape s ON s.fingerprint = r.fingerprint
LEFT JOIN fx_contract c ON c.revision_id = r.revision_id""")
def _(fx):
    return lookup.part_listing(fx.revision, fx.part, fx.shape, fx.contract)


@query("p06_part_summary", f"""
SELECT r.revision_id, p.part_number, p.description, p.team_id, s.area, s.chirality, s.dx AS bbox_dx,
       NULLIF(COALESCE(s.volume_exact, s.volume) * r.density, 0) AS mass_g
FROM {_CURRENT} r JOIN fx_part p ON p.part_id = r.part_id LEFT JOIN fx_shape s ON s.fingerprint = r.fingerprint""")
def _(fx):
    return lookup.part_summary(lookup.current_revision(fx.revision), fx.revision, fx.part, fx.shape).select(
        "revision_id", "part_number", "description", "team_id", "area", "chirality", "bbox_dx", "mass_g")


@query("p07_published_contract", """
SELECT c.revision_id, c.contract_hash, c.provenance, f.face, f.name, f.hole_count, f.fastener, f.fills
FROM fx_contract c LEFT JOIN (
  SELECT revision_id, 'interface' AS face, name, hole_count, fastener, CAST(NULL AS VARCHAR) AS fills FROM fx_interface
  UNION ALL SELECT revision_id, 'socket', name, hole_count, fastener, fills FROM fx_socket) f ON f.revision_id = c.revision_id""")
def _(fx):
    return lookup.published_contract(fx.revision, fx.contract, fx.interface, extra(fx, "fx_socket")).select(
        "revision_id", "contract_hash", "provenance", "face", "name", "hole_count", "fastener", "fills")


@query("p08_children", f"""
SELECT o.parent_rev, o.child_rev, o.instance_name, o.quantity, p.part_number
FROM fx_occurrence o JOIN {_CURRENT} c ON c.revision_id = o.parent_rev
JOIN fx_revision r ON r.revision_id = o.child_rev JOIN fx_part p ON p.part_id = r.part_id""")
def _(fx):
    return lookup.children(lookup.current_revision(fx.revision), fx.occurrence, fx.revision, fx.part).drop("occurrence_id")


@query("p08_revision_history", """
SELECT r.part_id, r.revision_index, r.status, r.revision_id AS commit_id, c.author, c.created_at
FROM fx_revision r LEFT JOIN fx_commit c ON c.commit_id = r.revision_id""")
def _(fx):
    return lookup.revision_history(fx.revision.withColumn("commit_id", F.col("revision_id")), fx.commit)


@query("p09_validation_trace", """
SELECT a.prefix, v.commit_id, v.validation_id, v.stage, v.passed, c.author, c.verdict
FROM (SELECT q.prefix, MIN(c.commit_id) AS commit_id FROM (SELECT DISTINCT CAST(part_id AS VARCHAR) AS prefix FROM fx_proposal) q
      JOIN fx_commit c ON starts_with(CAST(c.commit_id AS VARCHAR), q.prefix) GROUP BY q.prefix) a
JOIN fx_validation v ON v.commit_id = a.commit_id JOIN fx_commit c ON c.commit_id = a.commit_id""")
def _(fx):
    asked = fx.proposal.select(F.col("part_id").cast("string").alias("prefix"))
    return lookup.validation_trace(asked, fx.commit, fx.validation).select(
        "prefix", "commit_id", "validation_id", "stage", "passed", "author", "verdict")


@query("p10_fastener_filter", """
SELECT part_id, part_number FROM fx_part WHERE UPPER(part_number) LIKE '%BOLT%' OR UPPER(part_number) LIKE '%SCREW%'
  OR UPPER(part_number) LIKE '%WASHER%' OR UPPER(part_number) LIKE '%NUT%' OR UPPER(part_number) LIKE '%PIN%'
  OR UPPER(part_number) LIKE '%DOWEL%' OR UPPER(part_number) LIKE '%RIVET%' OR UPPER(part_number) LIKE '%STUD%'""")
def _(fx):
    return fx.part.filter(text.is_fastener("part_number")).select("part_id", "part_number")


@query("p11_rule_resolver", """
SELECT part_id, CASE WHEN regexp_matches(part_number, '^BOLT') THEN 'fasteners' WHEN regexp_matches(part_number, '[02468]$') THEN 'even' ELSE 'general' END AS team,
       CASE WHEN regexp_matches(part_number, '^BOLT') THEN NULL WHEN regexp_matches(part_number, '1$') THEN 'steel' END AS material
FROM fx_part""")
def _(fx):
    n = F.col("part_number")
    return fx.part.select("part_id", text.first_rule(n, [("^BOLT", "fasteners"), ("[02468]$", "even")], "general").alias("team"),
                          text.first_rule(n, [("^BOLT", ""), ("1$", "steel")]).alias("material"))


@query("p13_mentioned_part", """
SELECT t.text_id, COALESCE(
  (SELECT substr(MIN(printf('%04d', 1000 - length(p.part_number)) || p.part_number), 5) FROM fx_part p WHERE contains(UPPER(t.text), p.part_number)),
  NULLIF(regexp_extract(UPPER(t.text), '\\b([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)\\b', 1), '')) AS part_number
FROM fx_text t""")
def _(fx):
    return lookup.mentioned_part(extra(fx, "fx_text"), fx.part)


@query("p15_acknowledge", """
SELECT n.notification_id, n.team_id, CASE WHEN a.notification_id IS NOT NULL THEN 1 ELSE n.acknowledged END AS acknowledged, a.acknowledged_by
FROM fx_notification n LEFT JOIN fx_ack a ON a.notification_id = n.notification_id""")
def _(fx):
    return lookup.acknowledged(fx.notification, extra(fx, "fx_ack")).select(
        "notification_id", "team_id", "acknowledged", "acknowledged_by")


@query("p16_gaps", """
SELECT r.revision_id,
  (CASE WHEN c.revision_id IS NULL OR (c.provenance = 'auto_drafted' AND c.reviewed = 0) THEN 1 ELSE 0 END
   + CASE WHEN r.is_assembly = 0 AND r.fingerprint IS NOT NULL AND r.density IS NULL THEN 1 ELSE 0 END
   + CASE WHEN r.status = 'draft' THEN 1 ELSE 0 END) AS gaps,
  CASE WHEN c.revision_id IS NULL THEN 'lacks a contract' WHEN c.provenance = 'auto_drafted' AND c.reviewed = 0 THEN 'its drafted contract awaits review'
       WHEN r.is_assembly = 0 AND r.fingerprint IS NOT NULL AND r.density IS NULL THEN 'has no density and counts as weightless'
       WHEN r.status = 'draft' THEN 'is a draft' END AS first_gap
FROM fx_revision r LEFT JOIN fx_contract c ON c.revision_id = r.revision_id""")
def _(fx):
    df = fx.revision.join(fx.contract.select("revision_id", "contract_id", "provenance", "reviewed"), "revision_id", "left")
    return df.withColumn("g", lookup.gaps()).select("revision_id", F.size("g").alias("gaps"), F.get("g", F.lit(0)).alias("first_gap"))


@query("w02_next_revision_index", """
SELECT l.l_orderkey, l.l_linenumber, p.part_id, p.n_rev + ROW_NUMBER() OVER (PARTITION BY p.part_id ORDER BY l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice) AS revision_index
FROM lineitem l JOIN fx_part p ON p.part_id = l.l_partkey""")
def _(fx):
    batch = fx.raw("lineitem").withColumnRenamed("l_partkey", "part_id")
    return lookup.next_revision_index(batch, fx.revision, ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "part_id", "revision_index")


@query("w03_classification", """
SELECT r.revision_id, c.contract_hash IS DISTINCT FROM LAG(c.contract_hash) OVER w AS contract_changed,
       r.fingerprint IS DISTINCT FROM LAG(r.fingerprint) OVER w AS body_changed,
       CASE WHEN LAG(r.revision_id) OVER w IS NULL OR c.contract_hash IS DISTINCT FROM LAG(c.contract_hash) OVER w THEN 'breaking'
            WHEN r.fingerprint IS DISTINCT FROM LAG(r.fingerprint) OVER w THEN 'internal' ELSE 'no_op' END AS classification
FROM fx_revision r LEFT JOIN fx_contract c ON c.revision_id = r.revision_id
WINDOW w AS (PARTITION BY r.part_id ORDER BY r.revision_index)""")
def _(fx):
    return lookup.classify_changes(fx.revision, fx.contract).drop("part_id", "revision_index")


@query("w04_cut_traces", """
SELECT v.commit_id, v.validation_id, v.stage, v.passed, COALESCE(v.validation_id = f.first, FALSE) AS is_first_failure
FROM fx_validation v JOIN (SELECT commit_id, MIN(CASE WHEN passed = 0 THEN validation_id END) AS first FROM fx_validation GROUP BY commit_id) f
  ON f.commit_id = v.commit_id WHERE f.first IS NULL OR v.validation_id <= f.first""")
def _(fx):
    return lookup.cut_traces(fx.validation).select("commit_id", "validation_id", "stage", "passed", "is_first_failure")


@query("w06_latest_author", "SELECT part_id, arg_max(author, revision_index) AS author FROM fx_revision GROUP BY part_id")
def _(fx):
    return lookup.latest_author(fx.revision)


@query("w07_colliding_names", """
SELECT file_id, definition_key, CASE WHEN rn = 1 THEN name ELSE name || '#' || CAST(rn AS VARCHAR) END AS part_number
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id, name ORDER BY first_seen, definition_key) AS rn FROM fx_definition) t""")
def _(fx):
    return lookup.number_colliding_names(extra(fx, "fx_definition")).select("file_id", "definition_key", "part_number")


@query("w08_first_seen", """
WITH RECURSIVE walk(rev, path) AS (
  SELECT r.revision_id, p.part_number FROM fx_revision r JOIN fx_part p ON p.part_id = r.part_id
  WHERE r.revision_id = (SELECT MAX(revision_id) FROM fx_revision WHERE part_id = 0)
  UNION ALL SELECT o.child_rev, w.path || '/' || o.instance_name FROM walk w JOIN fx_occurrence o ON o.parent_rev = w.rev)
SELECT rev AS revision_id, MIN(path) AS first_path FROM walk GROUP BY rev""")
def _(fx):
    return lookup.first_seen(graph.explode_structure(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape)).drop("root_rev")


@query("t03_commit_history", "SELECT commit_id, author, created_at, verdict FROM fx_commit ORDER BY created_at DESC, commit_id DESC LIMIT 200")
def _(fx):
    return lookup.commit_history(fx.commit, 200)


@query("t07_parts_by_team", "SELECT team_id, part_number FROM fx_part ORDER BY team_id, part_number")
def _(fx):
    return fx.part.select("team_id", "part_number").orderBy("team_id", "part_number")


@query("t06_top_per_group", """
SELECT chain_id, seq, nominal FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chain_id ORDER BY nominal DESC, seq) AS rn FROM fx_dimension) t WHERE rn <= 3""")
def _(fx):
    return lookup.top_per_group(fx.dimension, ["chain_id"], [F.desc("nominal"), "seq"], 3).select("chain_id", "seq", "nominal")


# -- chains -------------------------------------------------------------------

@query("j18_chain_members", """
SELECT d.chain_id, d.seq, d.direction, d.nominal, p.part_number, p.team_id
FROM fx_dimension d JOIN fx_part p ON p.part_id = d.part_id""")
def _(fx):
    cm = fx.dimension.select("chain_id", "seq", "direction", F.concat_ws("/", "chain_id", "seq").alias("dimension_id"))
    dim = fx.dimension.select(F.concat_ws("/", "chain_id", "seq").alias("dimension_id"), (F.col("part_id") * 10 + 1).alias("revision_id"), "nominal")
    return tolerance.members(cm, dim, fx.revision, fx.part).select("chain_id", "seq", "direction", "nominal", "part_number", "team_id")


@query("a03_cross_team_chains", """
SELECT d.chain_id, COUNT(DISTINCT p.team_id) AS team_count, string_agg(DISTINCT p.team_id, ', ' ORDER BY p.team_id) AS teams
FROM fx_dimension d JOIN fx_part p ON p.part_id = d.part_id GROUP BY d.chain_id""")
def _(fx):
    return tolerance.teams_per_chain(fx.member, fx.part)


_SIGMA = "(CASE distribution WHEN 'uniform' THEN (tol_plus + tol_minus) / 2 / sqrt(CAST(3 AS DOUBLE)) WHEN 'triangular' THEN (tol_plus + tol_minus) / 2 / sqrt(CAST(6 AS DOUBLE)) ELSE (tol_plus + tol_minus) / 2 / sigma_span END)"
_TOTAL = f"""
WITH agg AS (
  SELECT chain_id, COUNT(*) AS members, SUM(direction * nominal) AS nominal,
         SUM(CASE WHEN direction > 0 THEN tol_minus ELSE tol_plus END) AS down, SUM(CASE WHEN direction > 0 THEN tol_plus ELSE tol_minus END) AS up,
         sqrt(SUM({_SIGMA} * {_SIGMA})) AS sigma_total, MAX(sigma_span) AS span, MIN(sigma_span) AS least,
         SUM(direction * (tol_plus - tol_minus) / 2) AS bias,
         string_agg(DISTINCT distribution || '/' || regexp_replace(CAST(sigma_span AS VARCHAR), '\\.0$', '') || 'sigma', ', '
                    ORDER BY distribution || '/' || regexp_replace(CAST(sigma_span AS VARCHAR), '\\.0$', '') || 'sigma') AS conv
  FROM fx_dimension GROUP BY chain_id
), t AS (
  SELECT c.chain_id, c.method, c.target_low, c.target_high, COALESCE(a.members, 0) AS members, COALESCE(a.nominal, 0) AS nominal,
         COALESCE(a.nominal - a.down, 0) AS worst_low, COALESCE(a.nominal + a.up, 0) AS worst_high, COALESCE(a.sigma_total, 0) AS sigma_total,
         COALESCE(a.nominal + a.bias - a.span * a.sigma_total, 0) AS rss_low, COALESCE(a.nominal + a.bias + a.span * a.sigma_total, 0) AS rss_high,
         COALESCE(a.conv, '') AS conv, a.span <> a.least AS mixed
  FROM fx_chain c LEFT JOIN agg a ON a.chain_id = c.chain_id
)"""


@query("a04_chain_totals", _TOTAL + f"""
SELECT chain_id, members, {grid_sql('nominal')} AS nominal, {grid_sql('worst_low')} AS worst_low, {grid_sql('worst_high')} AS worst_high,
       {grid_sql('sigma_total')} AS sigma_total, {grid_sql('rss_low')} AS rss_low, {grid_sql('rss_high')} AS rss_high, conv AS sigma_conventions,
       CASE WHEN members = 0 THEN 'is empty, all totals are zero' WHEN mixed THEN 'spans differ between members: ' || conv ELSE '' END AS warnings,
       (target_low IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_low ELSE rss_low END) >= target_low - 1e-12)
       AND (target_high IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_high ELSE rss_high END) <= target_high + 1e-12) AS passes
FROM t""")
def _(fx):
    t = tolerance.with_verdict(tolerance.totals(fx.chain, fx.member))
    return t.select("chain_id", "members", *[grid(c).alias(c) for c in ("nominal", "worst_low", "worst_high", "sigma_total", "rss_low", "rss_high")],
                    "sigma_conventions", "warnings", "passes")


@query("a05_monte_carlo")
def _(fx):
    return tolerance.monte_carlo(fx.chain, fx.dimension)


@query("a06_worst_contributor", f"""
SELECT chain_id, seq, part_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chain_id ORDER BY {_SIGMA} DESC, seq) AS rn FROM fx_dimension) t WHERE rn = 1""")
def _(fx):
    return tolerance.worst_contributor(fx.dimension).drop("sigma")


@query("t02_chains_ranked", _TOTAL + """, v AS (
  SELECT t.chain_id, COALESCE(x.n, 0) > 1 AS cross_team,
       (target_low IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_low ELSE rss_low END) >= target_low - 1e-12)
       AND (target_high IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_high ELSE rss_high END) <= target_high + 1e-12) AS passes
  FROM t LEFT JOIN (SELECT d.chain_id, COUNT(DISTINCT p.team_id) AS n FROM fx_dimension d JOIN fx_part p ON p.part_id = d.part_id GROUP BY d.chain_id) x ON x.chain_id = t.chain_id)
SELECT chain_id, cross_team, passes FROM v""")
def _(fx):
    return tolerance.evaluate(fx.chain, fx.member, fx.part).select("chain_id", "cross_team", "passes")


@query("j14_chains_touching", "SELECT DISTINCT chain_id FROM fx_dimension d JOIN fx_part p ON p.part_id = d.part_id WHERE p.is_assembly = 1")
def _(fx):
    return tolerance.chains_touching(fx.member, fx.part.filter("is_assembly = 1"))


@query("j13_rebind_members", """
SELECT m.chain_id, m.seq, COALESCE(n.dimension_id, m.dimension_id) AS dimension_id, m.direction
FROM fx_bound_member m LEFT JOIN fx_named_dimension o ON o.dimension_id = m.dimension_id
LEFT JOIN fx_replaced r ON r.old_rev = o.revision_id LEFT JOIN fx_named_dimension n ON n.revision_id = r.new_rev AND n.name = o.name""")
def _(fx):
    return tolerance.rebind_members(extra(fx, "fx_bound_member"), extra(fx, "fx_named_dimension"), extra(fx, "fx_replaced"))


@query("s17_author_chains", """
WITH spec AS (SELECT part_id, 'c' || CAST(part_id AS VARCHAR) AS name FROM fx_part),
mem AS (SELECT s.name, k.k AS seq, CASE WHEN k.k = 3 AND s.part_id % 7 = 0 THEN 'NONE' ELSE p.part_number END AS part_number, 'd' || CAST(k.k AS VARCHAR) AS dimension_name
        FROM spec s JOIN fx_part p ON p.part_id = s.part_id CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k),
dim AS (SELECT p.part_number, d.name AS dimension_name, MAX(r.revision_index * 100000000 + d.dimension_id) % 100000000 AS dimension_id
        FROM fx_named_dimension d JOIN fx_revision r ON r.revision_id = d.revision_id JOIN fx_part p ON p.part_id = r.part_id GROUP BY p.part_number, d.name),
bound AS (SELECT m.*, d.dimension_id, COUNT(*) OVER (PARTITION BY m.name) AS n, COUNT(d.dimension_id) OVER (PARTITION BY m.name) AS b
          FROM mem m LEFT JOIN dim d ON d.part_number = m.part_number AND d.dimension_name = m.dimension_name)
SELECT name, seq, dimension_id FROM bound WHERE n = b AND name NOT IN (SELECT 'c' || CAST(part_id AS VARCHAR) FROM fx_proposal)""")
def _(fx):
    spec = fx.part.select(F.concat(F.lit("c"), "part_id").alias("name"))
    mem = fx.part.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        F.concat(F.lit("c"), "part_id").alias("name"), "seq",
        F.when((F.col("seq") == 3) & (F.col("part_id") % 7 == 0), "NONE").otherwise(F.col("part_number")).alias("part_number"),
        F.concat(F.lit("d"), "seq").alias("dimension_name"), F.lit(1).alias("direction"))
    existing = fx.proposal.select(F.concat(F.lit("c"), "part_id").alias("name"))
    return tolerance.author_chains(spec, mem, existing, extra(fx, "fx_named_dimension"), fx.revision, fx.part)[1].drop("direction")


# -- coupling and impact --------------------------------------------------------

@query("j04_chain_coupling", """
SELECT DISTINCT a.part_id AS source_part, b.chain_id, b.part_id FROM fx_dimension a JOIN fx_proposal q ON q.part_id = a.part_id
JOIN fx_dimension b ON b.chain_id = a.chain_id""")
def _(fx):
    return impact.chain_partners(fx.proposal, fx.member)


@query("j05_budget_coupling", """
SELECT r.part_id AS source_part, cr.part_id, MIN(s.name) AS socket_name
FROM fx_socket s JOIN fx_revision r ON r.revision_id = s.revision_id JOIN fx_occurrence o ON o.parent_rev = r.revision_id
JOIN fx_revision cr ON cr.revision_id = o.child_rev
WHERE (s.mass_budget IS NOT NULL OR s.power_budget IS NOT NULL OR s.thermal_budget IS NOT NULL)
GROUP BY r.part_id, cr.part_id""")
def _(fx):
    return impact.budget_children(fx.part, extra(fx, "fx_socket"), fx.occurrence, fx.revision)


_ASK = "(SELECT part_id, CASE WHEN part_id % 2 = 0 THEN 'foot' END AS interface_name FROM fx_proposal)"


def _asked(fx):
    return fx.proposal.selectExpr("part_id", "CASE WHEN part_id % 2 = 0 THEN 'foot' END AS interface_name")


@query("j06_subscription_match", f"""
SELECT a.part_id, a.interface_name, s.team_id, s.interface_name AS subscribed FROM (SELECT part_id, CASE WHEN is_assembly = 1 THEN 'foot' END AS interface_name FROM fx_part) a JOIN fx_subscription s ON s.part_id = a.part_id
WHERE a.interface_name IS NULL OR s.interface_name IS NULL OR a.interface_name = s.interface_name""")
def _(fx):
    return impact.subscribers(fx.part.selectExpr("part_id", "CASE WHEN is_assembly = 1 THEN 'foot' END AS interface_name"), fx.subscription)


@query("j07_socket_owner", """
SELECT p.part_id AS source_part, s.name AS socket_name, s.revision_id, r.part_id
FROM fx_socket s JOIN fx_part p ON s.fills = p.part_number OR s.fills LIKE '%/' || p.part_number
JOIN fx_revision r ON r.revision_id = s.revision_id""")
def _(fx):
    return impact.filled_sockets(fx.part, extra(fx, "fx_socket"), fx.revision, fx.part)


_IMPACT = f"""{_REACH}, {_HOLDERS}, reason AS (
  SELECT a.part_id AS source_part, s.team_id, 1 AS route, 'follows ' || p.part_number || ' (' || COALESCE(s.interface_name, 'whole contract') || ')' AS reason,
         CAST(NULL AS VARCHAR) AS part_number
  FROM {_ASK} a JOIN fx_subscription s ON s.part_id = a.part_id JOIN fx_part p ON p.part_id = a.part_id
  WHERE a.interface_name IS NULL OR s.interface_name IS NULL OR a.interface_name = s.interface_name
  UNION SELECT q.part_id, w.team_id, 2, 'is responsible for ' || w.part_number || ', which holds ' || p.part_number, w.part_number
  FROM fx_proposal q JOIN users ON source_part = q.part_id JOIN inside ON rev = users.revision_id JOIN fx_revision r ON r.revision_id = rev
  JOIN fx_part w ON w.part_id = r.part_id JOIN fx_part p ON p.part_id = q.part_id
  UNION SELECT a.part_id, w.team_id, 3, 'meets it in chain ''' || c.name || ''' via ' || w.part_number, w.part_number
  FROM fx_proposal a JOIN fx_dimension d ON d.part_id = a.part_id JOIN fx_chain c ON c.chain_id = d.chain_id JOIN fx_dimension e ON e.chain_id = c.chain_id
  JOIN fx_part w ON w.part_id = e.part_id
  UNION SELECT p.part_id, w.team_id, 4, 'holds it by socket ''' || s.name || ''' of ' || w.part_number, w.part_number
  FROM fx_socket s JOIN fx_part p ON s.fills = p.part_number OR s.fills LIKE '%/' || p.part_number JOIN fx_proposal q ON q.part_id = p.part_id
  JOIN fx_revision r ON r.revision_id = s.revision_id JOIN fx_part w ON w.part_id = r.part_id
), kept AS (SELECT r.* FROM reason r JOIN fx_part p ON p.part_id = r.source_part WHERE r.team_id <> p.team_id)"""


def _reasons(fx):
    return impact.impact_reasons(_asked(fx), fx.part, fx.revision, fx.occurrence, fx.subscription, fx.chain, fx.member,
                                 extra(fx, "fx_socket"), fx.live)


@query("c01_impact", _IMPACT + " SELECT * FROM kept")
def _(fx):
    return _reasons(fx).drop("interface_name")


@query("a16_impact_by_team", _IMPACT + """
SELECT source_part, team_id, substr(MIN(CAST(route AS VARCHAR) || reason), 2) AS first_reason, COUNT(DISTINCT reason) AS reasons,
       COUNT(DISTINCT part_number) AS parts FROM kept GROUP BY source_part, team_id""")
def _(fx):
    return impact.impact_teams(_reasons(fx)).drop("interface_name")


@query("u03_impact_routes", _IMPACT + " SELECT route, COUNT(*) AS rows FROM kept GROUP BY route")
def _(fx):
    return _reasons(fx).groupBy("route").agg(F.count(F.lit(1)).alias("rows"))


_CLOSURE = """
WITH changed AS (SELECT DISTINCT commit_id % 5 AS commit_id, part_id FROM fx_proposal UNION SELECT commit_id % 5, CAST(FLOOR((part_id - 1) / 4) AS BIGINT) FROM fx_proposal),
c1 AS (SELECT g.commit_id, b.part_id, MIN('meets it in chain ''' || c.name || '''') AS why
       FROM changed g JOIN fx_dimension a ON a.part_id = g.part_id JOIN fx_dimension b ON b.chain_id = a.chain_id JOIN fx_chain c ON c.chain_id = a.chain_id
       GROUP BY g.commit_id, b.part_id),
c2 AS (SELECT g.commit_id, cr.part_id, MIN('draws on the budget of socket ''' || s.name || '''') AS why
       FROM changed g JOIN fx_revision r ON r.part_id = g.part_id JOIN fx_socket s ON s.revision_id = r.revision_id JOIN fx_occurrence o ON o.parent_rev = r.revision_id
       JOIN fx_revision cr ON cr.revision_id = o.child_rev WHERE s.mass_budget IS NOT NULL OR s.power_budget IS NOT NULL OR s.thermal_budget IS NOT NULL
       GROUP BY g.commit_id, cr.part_id),
c3 AS (SELECT g.commit_id, g.part_id, MIN('team ' || s.team_id || ' follows it') AS why FROM changed g JOIN fx_subscription s ON s.part_id = g.part_id GROUP BY g.commit_id, g.part_id)"""


def changed_parts(fx):
    a = fx.proposal.selectExpr("commit_id % 5 AS commit_id", "part_id")
    return a.unionByName(fx.proposal.selectExpr("commit_id % 5 AS commit_id", "CAST(FLOOR((part_id - 1) / 4) AS BIGINT) AS part_id")).distinct()


def _closure(fx):
    return impact.dependency_closure(changed_parts(fx), fx.member, fx.chain, extra(fx, "fx_socket"), fx.occurrence, fx.revision, fx.subscription)


@query("c02_dependency_closure", _CLOSURE + """
SELECT g.commit_id, g.part_id, TRUE AS own, c3.why FROM changed g LEFT JOIN c3 ON c3.commit_id = g.commit_id AND c3.part_id = g.part_id
UNION ALL
SELECT k.commit_id, k.part_id, FALSE, COALESCE(c1.why, c2.why)
FROM (SELECT commit_id, part_id FROM c1 UNION SELECT commit_id, part_id FROM c2 EXCEPT SELECT commit_id, part_id FROM changed) k
LEFT JOIN c1 ON c1.commit_id = k.commit_id AND c1.part_id = k.part_id LEFT JOIN c2 ON c2.commit_id = k.commit_id AND c2.part_id = k.part_id""")
def _(fx):
    return _closure(fx)


@query("u04_closure_overlap", _CLOSURE + """
SELECT DISTINCT k.commit_id, k.part_id FROM (SELECT * FROM changed UNION SELECT commit_id, part_id FROM c1 UNION SELECT commit_id, part_id FROM c2) k
JOIN fx_proposal p ON p.part_id = k.part_id AND p.commit_id % 5 <> k.commit_id""")
def _(fx):
    others = fx.proposal.selectExpr("commit_id % 5 AS other", "part_id")
    return _closure(fx).join(others, "part_id").filter("other <> commit_id").select("commit_id", "part_id").distinct()


# -- functions ------------------------------------------------------------------------

@query("p12_static_maps", """
SELECT interface_id, CASE fastener WHEN 'M6' THEN 6.0::DOUBLE END AS diameter FROM fx_interface""")
def _(fx):
    return fx.interface.select("interface_id", fits.diameter(F.lower("fastener")).alias("diameter"))


def _lead_sql(digits: int) -> str:
    y = f"(l_extendedprice * POWER(10, {digits - 1} - FLOOR(LOG10(l_extendedprice))))"
    part = f"({y} - FLOOR({y}))"
    return f"""CASE WHEN l_extendedprice = 0 THEN 0 ELSE CAST(FLOOR({y}) + CASE WHEN {part} > 0.5 THEN 1 WHEN {part} = 0.5 THEN FLOOR({y}) % 2 ELSE 0 END AS BIGINT) END"""


@query("f06_significant_digits", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, {_lead_sql(9)} AS lead, {_lead_sql(3)} AS lead3 FROM lineitem""")
def _(fx):
    x = F.col("l_extendedprice")

    def lead(rounded, digits):
        whole = F.round(rounded * F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(x)))).cast("bigint")
        return F.when(x == 0, F.lit(0).cast("bigint")).otherwise(whole)

    return fx.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", lead(digest.significant(x), 9).alias("lead"),
                                     lead(digest.significant(x, 3), 3).alias("lead3"))


@query("f18_member_terms", f"SELECT chain_id, seq, {grid_sql('(tol_plus + tol_minus) / 2')} AS half, {grid_sql('(tol_plus - tol_minus) / 2')} AS bias, {grid_sql(_SIGMA)} AS sigma FROM fx_dimension")
def _(fx):
    return fx.dimension.select("chain_id", "seq", grid(tolerance.half_band()).alias("half"), grid(tolerance.bias()).alias("bias"), grid(tolerance.sigma()).alias("sigma"))


@query("f19_chain_verdicts", _TOTAL + """
SELECT chain_id, method, CASE WHEN target_low IS NULL AND target_high IS NULL THEN FALSE ELSE TRUE END AS bounded,
       contains(CAST(COALESCE(target_low, -1) AS VARCHAR), '.') AS has_text FROM t""")
def _(fx):
    t = tolerance.evaluate(fx.chain, fx.member)
    return t.select("chain_id", "method", F.col("explanation").contains("; wanted ").alias("bounded"),
                    F.col("explanation").startswith(F.concat(F.lit("chain '"), F.col("name"), F.lit("' ("))).alias("has_text"))


@query("f20_step_text", """
SELECT v.commit_id, v.validation_id, '[' || v.stage || '] ' || CASE WHEN v.passed = 0 THEN 'limit: ' ELSE '' END || 'checked' || ' (other party: ' || p.part_number || ' and ' || p.team_id || ')' AS summary
FROM fx_validation v JOIN fx_part p ON p.part_id = v.part_id""")
def _(fx):
    j = fx.validation.join(fx.part.select("part_id", "part_number", "team_id"), "part_id")
    return j.select("commit_id", "validation_id", text.step_text(F.col("stage"), F.when(F.col("passed") == 0, "limit"), F.lit("checked"),
                                                                 F.col("part_number"), F.col("team_id")).alias("summary"))


@query("f14_axis_geometry", f"""
SELECT l_orderkey, l_linenumber, {grid_sql('l_discount')} AS x, {grid_sql('l_tax')} AS y, {grid_sql('0')} AS z, {grid_sql('0')} AS angle FROM lineitem""")
def _(fx):
    z = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    d = geometry.canonical([F.lit(0.0), F.lit(0.0), -F.col("l_quantity")])
    q = geometry.nearest_on_axis([F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")], d, [F.lit(0.0)] * 3)
    return fx.raw("lineitem").select("l_orderkey", "l_linenumber", *[grid(q[i]).alias("xyz"[i]) for i in range(3)], grid(geometry.axis_angle(d, z)).alias("angle"))


@query("f16_third_moment_along", f"""
SELECT fingerprint, 0 AS along_x, 0 AS along_d FROM fx_shape""")
def _(fx):
    m = shapes.moments(fx.triangle)
    unit = F.lit(3 ** -0.5)
    return m.select("fingerprint", grid(geometry.third_along([F.lit(1.0), F.lit(0.0), F.lit(0.0)]), 1).alias("along_x"),
                    grid(geometry.third_along([unit, unit, unit]), 1).alias("along_d"))


@query("t05_ranked_candidates", f"""
SELECT chain_id, rn AS rank, seq FROM (SELECT chain_id, seq, ROW_NUMBER() OVER (PARTITION BY chain_id ORDER BY ABS(nominal - 25), seq) AS rn FROM fx_dimension) t WHERE rn <= 20""")
def _(fx):
    near = lookup.top_per_group(fx.dimension.withColumn("distance", F.abs(F.col("nominal") - 25)), ["chain_id"], ["distance", "seq"], 20)
    return near.select("chain_id", F.row_number().over(Window.partitionBy("chain_id").orderBy("distance", "seq")).alias("rank"), "seq")
