"""Proposals, conflicts, readiness, quality, landing, documents and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from partloom.api import Queries
from partloom.functions import pose
from partloom.functions import text as texts
from partloom.operators import diff, features, graph, hashing, interference, landing, lookup, quality, rollup
from partloom.plans import conflicts, declared, load, overlay, proposals, readiness
from partloom.plans.base import Product
from partloom.session import cut, shared_folder, union_all
from partloom.sources import catalogue, documents, exports
from partloom.streaming import outbox

from .checks_contracts import _OUT, _WALK, filled, full_sockets, placed, rollups, socket_results
from .checks_graph import _DOWN, _REACH
from .checks_hash import _DENS, _LANE, _dig, _merkle_sql, hashes
from .checks_relational import _TOTAL
from .checks_shapes import bores
from .registry import ORACLES, extra, grid, grid_sql, query, shared, with_views


def product(fx) -> Product:
    return shared(fx, "product", lambda: Product(
        part=fx.part, rev=fx.revision, occ=fx.occurrence, shape=fx.shape, contract=fx.contract.select("*", *[F.lit(None).cast("double").alias(f"envelope_d{a}") for a in "xyz"], F.lit(None).cast("string").alias("cg_window")), interface=fx.full_interface, socket=full_sockets(fx),
        chain=fx.chain, member=fx.dimension, subscription=fx.subscription, root=fx.top_root, live=fx.live))


def heights(fx):
    return shared(fx, "heights", lambda: cut(graph.heights(fx.revision, fx.occurrence)))


def validated(fx) -> dict:
    return shared(fx, "validated", lambda: {k: cut(v) for k, v in proposals.validate(
        fx.proposal, product(fx), hashes(fx), rollups(fx), filled(fx)).items()})


def prepared(fx):
    return shared(fx, "prepared", lambda: cut(proposals.prepare(fx.proposal, product(fx))))


_CUR = "cur AS (SELECT r.*, c.contract_hash, c.mass_max FROM fx_revision r JOIN (SELECT part_id, MAX(revision_index) AS top FROM fx_revision GROUP BY part_id) x ON x.part_id = r.part_id AND x.top = r.revision_index LEFT JOIN fx_contract c ON c.revision_id = r.revision_id)"
_CLASS = """cls AS (SELECT q.commit_id, q.part_id, COALESCE(q.new_contract_hash, c.contract_hash) IS DISTINCT FROM c.contract_hash AS contract_changed, q.new_fingerprint IS DISTINCT FROM c.fingerprint AS body_changed
  FROM fx_proposal q JOIN cur c ON c.part_id = q.part_id)"""


@query("c08_classifications", f"""WITH {_CUR}, {_CLASS}
SELECT commit_id, part_id, contract_changed, body_changed, CASE WHEN contract_changed THEN 'breaking' WHEN body_changed THEN 'internal' ELSE 'no_op' END AS classification FROM cls""")
def _(fx):
    return validated(fx)["classifications"].select("commit_id", "part_id", "contract_changed", "body_changed", "classification")


@query("c08_verdicts")
def _(fx):
    return validated(fx)["verdicts"]


@query("c08_steps")
def _(fx):
    return validated(fx)["steps"]


@query("a17_commit_counts")
def _(fx):
    return proposals.counts(validated(fx))


@query("x05_enqueue", """
SELECT 'validation_trace' AS topic, COUNT(DISTINCT commit_id) AS commits FROM fx_proposal""")
def _(fx):
    return proposals.outbox_rows(validated(fx)).filter("topic = 'validation_trace'").groupBy("topic").agg(F.count_distinct("doc_key").alias("commits"))


_UPWARD = _REACH + """, cur AS (SELECT part_id, MAX(revision_index) AS top FROM fx_revision GROUP BY part_id),
up(commit_id, rev) AS (
  SELECT q.commit_id, q.part_id * 10 + c.top FROM fx_proposal q JOIN cur c ON c.part_id = q.part_id
  UNION SELECT u.commit_id, o.parent_rev FROM up u JOIN fx_occurrence o ON o.child_rev = u.rev JOIN inside d ON d.rev = o.parent_rev)"""


@query("g07_rebuilt_revisions", _UPWARD + """
SELECT u.commit_id, u.rev AS old_rev, r.part_id, c.top + 1 AS revision_index FROM up u JOIN fx_revision r ON r.revision_id = u.rev JOIN cur c ON c.part_id = r.part_id""")
def _(fx):
    return proposals.rebuild_ancestors(prepared(fx), product(fx))[0].drop("new_rev")


@query("g07_rebuilt_edges", _UPWARD + """
SELECT u.commit_id, COUNT(*) AS edges, COUNT(k.rev) AS remapped FROM up u JOIN fx_occurrence o ON o.parent_rev = u.rev LEFT JOIN up k ON k.commit_id = u.commit_id AND k.rev = o.child_rev GROUP BY u.commit_id""")
def _(fx):
    _, occ = proposals.rebuild_ancestors(prepared(fx), product(fx))
    new = F.col("child_rev").startswith(F.concat(F.col("commit_id").cast("string"), F.lit("/")))
    return occ.groupBy("commit_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(new).alias("remapped"))


@query("c08_new_roots")
def _(fx):
    return validated(fx)["new_roots"]



@query("c03_conflicts")
def _(fx):
    # Every part of the live product was edited against revision one of its own assembly.
    h = hashes(fx)
    merkle = hashing.with_hashes(fx.revision, h)
    base = merkle.filter("is_assembly = 1 AND revision_index = 1").select(F.col("part_id").alias("commit_id"), F.col("merkle_hash").alias("base_root"))
    cur = lookup.current_revision(merkle).select(F.col("part_id").alias("commit_id"), F.col("merkle_hash").alias("current_root"), F.col("revision_id").alias("current_rev"))
    touched = fx.edge.select(F.col("parent_part").alias("commit_id"), F.col("child_part").alias("part_id")).distinct()
    return conflicts.analyse(base.join(cur, "commit_id"), touched, product(fx), h, merkle)


_OPEN = _REACH + """, rv AS (SELECT r.*, p.part_number, p.team_id, c.provenance, c.reviewed, c.revision_id IS NULL AS bare
  FROM inside d JOIN fx_revision r ON r.revision_id = d.rev JOIN fx_part p ON p.part_id = r.part_id LEFT JOIN fx_contract c ON c.revision_id = r.revision_id),
st AS (SELECT *, NOT (bare OR COALESCE(provenance = 'auto_drafted' AND reviewed = 0, FALSE) OR (is_assembly = 0 AND fingerprint IS NOT NULL AND density IS NULL) OR status = 'draft') AS done FROM rv),
"""
_TEAMS = _OPEN + _TOTAL.strip()[len("WITH "):] + f""", bad AS (SELECT chain_id FROM t WHERE NOT (
    (target_low IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_low ELSE rss_low END) >= target_low - 1e-12)
    AND (target_high IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_high ELSE rss_high END) <= target_high + 1e-12))),
w AS (SELECT n.team_id FROM fx_notification n JOIN st ON st.part_id = n.part_id WHERE n.acknowledged = 0
  UNION ALL SELECT '(unassigned)' FROM bad WHERE chain_id IN (SELECT d.chain_id FROM fx_dimension d JOIN st ON st.part_id = d.part_id)
  UNION ALL SELECT CASE WHEN s.outcome = 'unfilled' THEN st.team_id ELSE p.team_id END FROM ({_OUT}) s JOIN fx_socket k ON k.socket_id = s.socket_id JOIN st ON st.revision_id = k.revision_id
    JOIN fx_part p ON p.part_id = k.filler_part WHERE s.outcome IN ('unfilled', 'no_interface') OR s.failed_step IS NOT NULL),
a AS (SELECT team_id, COUNT(*) AS parts, COUNT(*) FILTER (WHERE done) AS parts_done FROM st GROUP BY team_id), b AS (SELECT team_id, COUNT(*) AS waiting FROM w GROUP BY team_id)"""


def ready(fx):
    return shared(fx, "ready", lambda: readiness.readiness(fx.top_root, product(fx), fx.notification, socket_results(fx)))


@query("c09_readiness_teams", _TEAMS + """
SELECT COALESCE(a.team_id, b.team_id) AS team_id, COALESCE(a.parts, 0) AS parts, COALESCE(a.parts_done, 0) AS parts_done, COALESCE(b.waiting, 0) AS waiting
FROM a FULL JOIN b ON b.team_id = a.team_id""")
def _(fx):
    return ready(fx)["teams"].select("team_id", "parts", "parts_done", "waiting")


@query("a07_completeness", _TEAMS + f"""
SELECT {grid_sql('AVG(CASE WHEN done THEN 1.0 ELSE 0.0 END)', 10000)} AS complete, (SELECT SUM(waiting)::BIGINT FROM b) AS waiting, FALSE AS ready FROM st""")
def _(fx):
    return ready(fx)["overall"].select(grid("complete", 10000).alias("complete"), "waiting", "ready")


@query("t04_designer_queues", _OPEN.rstrip().rstrip(",") + " SELECT team_id, author AS designer, part_number FROM st WHERE NOT done")
def _(fx):
    return ready(fx)["designers"].select("team_id", "designer", "part_number")


@query("c07_chains_of_changes", _TOTAL + """
SELECT DISTINCT q.commit_id, 'chain.' || 'chain' || CAST(t.chain_id AS VARCHAR) AS constraint_name,
  (target_low IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_low ELSE rss_low END) >= target_low - 1e-12)
  AND (target_high IS NULL OR (CASE WHEN method = 'worst_case' THEN worst_high ELSE rss_high END) <= target_high + 1e-12) AS passed
FROM t JOIN fx_dimension d ON d.chain_id = t.chain_id JOIN fx_proposal q ON q.part_id = d.part_id""")
def _(fx):
    return proposals.chain_steps(prepared(fx), product(fx)).select("commit_id", "constraint_name", "passed")


@query("n12_query_surface", _DOWN + """
SELECT p.part_number, r.revision_id, CAST(SUM(w.qty) AS BIGINT) AS total_qty FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_part p ON p.part_id = r.part_id
WHERE r.is_assembly = 0 GROUP BY p.part_number, r.revision_id""")
def _(fx):
    return Queries(product(fx), extra(fx, "fx_ref")).bill_of_materials("main").select("part_number", "revision_id", "total_qty")


def stored_tables(fx) -> dict:
    """All stored tables with their declared columns, as far as the given data fills them."""
    def build():
        text = lambda c, *names: [F.to_json(n).alias(n) if n in names else F.col(n) for n in c.columns]
        sockets_ = extra(fx, "fx_socket")
        rows = {
            "team": fx.part.select("team_id", F.col("team_id").alias("name")).distinct(),
            "commit_log": fx.commit, "shape": fx.shape, "shape_alias": extra(fx, "fx_alias"),
            "feature": extra(fx, "fx_face").filter("kind = 'plane'").withColumn("feature_id", F.xxhash64("fingerprint", "face_id")),
            "part": fx.part, "revision": fx.revision, "ref": extra(fx, "fx_ref"),
            "occurrence": fx.occurrence.withColumn("occurrence_id", F.xxhash64("occurrence_id")), "contract": fx.contract,
            "interface": fx.full_interface.select(*text(fx.full_interface, "points")).withColumn("source", F.lit("declared")),
            "socket": sockets_, "subscription": fx.subscription.withColumn("subscription_id", F.xxhash64("team_id", "part_id", "interface_name")),
            "dimension": extra(fx, "fx_named_dimension"), "chain": fx.chain, "chain_member": extra(fx, "fx_bound_member"),
            "validation": fx.validation.withColumn("validation_id", F.xxhash64("commit_id", "validation_id")).drop("part_id"),
            "change_classification": fx.proposal.select("commit_id", "part_id", F.lit("breaking").alias("classification"), F.lit(1).alias("contract_changed")),
            "notification": fx.notification,
            "interference": fx.occurrence.filter("instance_name = 'std'").select(
                F.xxhash64("occurrence_id").alias("interference_id"), F.col("parent_rev").alias("root_rev"), F.col("instance_name").alias("path_a"), F.lit("clearance").alias("kind")),
            "outbox": fx.outbox.withColumn("delivered_at", F.when(F.col("outbox_id") % 3 == 0, F.col("created_at"))),
        }
        return {name: rows[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows[name].columns else F.lit(None).cast(f.dataType).alias(f.name)
                                          for f in catalogue.schema(name)]) for name in catalogue.COLUMNS}
    return shared(fx, "stored_tables", build)


# Rows of every stored table in SQL, in the order of the catalogue.
_STORED = {
    "team": "SELECT DISTINCT team_id FROM fx_part", "commit_log": "SELECT o_orderkey AS commit_id FROM orders", "shape": "SELECT fingerprint FROM fx_shape",
    "shape_alias": "SELECT fingerprint FROM fx_shape WHERE chirality > 0", "feature": "SELECT fingerprint FROM fx_face WHERE kind = 'plane'", "part": "SELECT part_id FROM fx_part",
    "revision": "SELECT revision_id FROM fx_revision", "ref": "SELECT ref_name FROM fx_ref", "occurrence": "SELECT instance_name FROM fx_occurrence", "contract": "SELECT revision_id FROM fx_contract",
    "interface": "SELECT interface_id FROM fx_interface", "socket": "SELECT socket_id FROM fx_socket", "subscription": "SELECT team_id FROM fx_subscription",
    "dimension": "SELECT dimension_id FROM fx_named_dimension", "chain": "SELECT chain_id FROM fx_chain", "chain_member": "SELECT chain_id FROM fx_dimension",
    "validation": "SELECT l_orderkey AS commit_id FROM lineitem", "change_classification": "SELECT commit_id FROM fx_proposal", "notification": "SELECT notification_id FROM fx_notification",
    "interference": "SELECT instance_name AS path_a FROM fx_occurrence WHERE instance_name = 'std'", "outbox": "SELECT event_id AS outbox_id FROM events",
}


@query("s01_table_catalogue", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", {catalogue.COLUMNS[name].count(",") + 1} AS columns, COUNT(*) AS rows, COUNT(DISTINCT {sql.split(' FROM ')[0].split()[-1]}) AS keys FROM ({sql})" for name, sql in _STORED.items()))
def _(fx):
    folder = f"{shared_folder(fx.spark)}/tables-{uuid.uuid4().hex}"
    for name, df in stored_tables(fx).items():
        df.write.parquet(f"{folder}/{name}")
    keys = {name: sql.split(" FROM ")[0].split()[-1] for name, sql in _STORED.items()}
    out = [df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(keys[name]).alias("keys")).select(
        F.lit(name).alias("table"), F.lit(len(df.columns)).alias("columns"), "rows", "keys") for name, df in catalogue.load(fx.spark, folder).items()]
    return union_all(out)


# -- quality --------------------------------------------------------------------

_LOST = "(SELECT part_id FROM fx_proposal)"


@query("c10_quality_audit", f"""
SELECT 'revision' AS "table", 'part_id references part' AS rule, COUNT(*) AS broken FROM fx_revision WHERE part_id IN {_LOST} HAVING COUNT(*) > 0
UNION ALL SELECT 'subscription', 'part_id references part', COUNT(*) FROM fx_subscription WHERE part_id IN {_LOST} HAVING COUNT(*) > 0
UNION ALL SELECT 'notification', 'part_id references part', COUNT(*) FROM fx_notification WHERE part_id IN {_LOST} HAVING COUNT(*) > 0
UNION ALL SELECT 'subscription', 'team_id references team', COUNT(*) FROM fx_subscription WHERE team_id NOT IN (SELECT team_id FROM fx_part) HAVING COUNT(*) > 0
UNION ALL SELECT 'notification', 'team_id references team', COUNT(*) FROM fx_notification WHERE team_id NOT IN (SELECT team_id FROM fx_part) HAVING COUNT(*) > 0
UNION ALL SELECT 'contract', 'provenance IN (''declared'', ''auto_drafted'')', COUNT(*) FROM fx_contract WHERE reviewed = 0 HAVING COUNT(*) > 0
UNION ALL SELECT 'occurrence', 'quantity > 0', COUNT(*) FROM fx_occurrence WHERE instance_name = 'std' HAVING COUNT(*) > 0
UNION ALL SELECT 'chain_member', 'direction IN (-1, 1)', COUNT(*) FROM fx_dimension WHERE seq = 7 HAVING COUNT(*) > 0
UNION ALL SELECT 'ref', 'unique ref_name', 1""")
def _(fx):
    # Rows broken on purpose: quantities, provenances, and parts that are gone.
    t = dict(stored_tables(fx))
    gone = fx.proposal.select(F.col("part_id").cast("string").alias("part_id"))
    t["part"] = t["part"].join(gone, "part_id", "left_anti")
    t["occurrence"] = t["occurrence"].withColumn("quantity", F.when(F.col("instance_name") == "std", 0).otherwise(F.col("quantity")))
    t["contract"] = t["contract"].withColumn("provenance", F.when(F.col("reviewed") == 0, "guessed").otherwise(F.col("provenance")))
    t["chain_member"] = t["chain_member"].withColumn("direction", F.when(F.expr("seq = 7"), 0).otherwise(F.col("direction")))
    t["ref"] = t["ref"].unionByName(t["ref"].filter("ref_name = 'main'"))
    t["interference"] = t["interference"].withColumn("kind", F.when(F.expr("interference_id % 2 = 0"), "clearance").otherwise(F.lit("clash")))
    return quality.audit(t).groupBy("table", "rule").agg(F.count(F.lit(1)).alias("broken"))


@query("c10_snapshot_rules", """
SELECT CAST(revision_id AS VARCHAR) AS key, CASE WHEN part_id % 2 = 0 THEN 'changed' ELSE 'deleted' END AS what FROM fx_revision WHERE part_id IN (SELECT part_id FROM fx_proposal)""")
def _(fx):
    hit = fx.proposal.select("part_id", F.lit(True).alias("hit"))
    after = fx.revision.join(hit, "part_id", "left").filter("hit IS NULL OR part_id % 2 = 0").withColumn(
        "material", F.when(F.col("hit"), "edited").otherwise(F.col("material"))).withColumn("status", F.lit("obsolete")).drop("hit")
    return quality.compare_snapshots("revision", fx.revision, after, ["revision_id"])


# -- landing and small writes --------------------------------------------------------

def source_nodes(fx):
    n = fx.source_node
    c = F.when(F.col("quarter_turns") == 0, 1.0).when(F.col("quarter_turns") == 2, -1.0).otherwise(0.0)
    s = F.when(F.col("quarter_turns") == 1, 1.0).when(F.col("quarter_turns") == 3, -1.0).otherwise(0.0)
    value = {"m00": c, "m01": -s, "m10": s, "m11": c, "m22": F.lit(1.0), "m03": F.col("tx")}
    return n.select(*[x for x in n.columns if x not in ("tx", "quarter_turns")], *[value.get(m, F.lit(0.0)).alias(m) for m in pose.COLUMNS],
                    F.format_string("t:%d|0|0;%d", F.col("tx").cast("bigint"), "quarter_turns").alias("transform_key"))


def _landed(fx):
    return shared(fx, "landed", lambda: _land(fx))


def _land(fx, current=None):
    n = source_nodes(fx)
    fp = n.filter("solid_id IS NOT NULL").select("file_id", "solid_id", F.col("solid_id").alias("fingerprint")).distinct()
    attrs = n.select("name").distinct().select("name", F.lit("import").alias("team_id"), F.lit("steel").alias("material"), F.lit(0.0078).alias("density"))
    none = {"part": fx.spark.createDataFrame([], "part_id string, part_number string, description string, team_id string"),
            "revision": fx.spark.createDataFrame([], "revision_id string, part_id string, revision_index int, fingerprint string, material string, density double, is_assembly int"),
            "occurrence": fx.spark.createDataFrame([], "parent_rev string, child_rev string, transform_key string, quantity int")}
    return landing.land(n, fp, attrs, current or none)


_LAND = """d AS (SELECT file_id, definition_key, name, MIN(position) AS first_seen, COUNT(*) AS n FROM fx_source_node GROUP BY file_id, definition_key, name)"""


@query("s02_landed_definitions", f"""WITH {_LAND}
SELECT file_id, definition_key, CASE WHEN rn = 1 THEN name ELSE name || '#' || CAST(rn AS VARCHAR) END AS part_number, starts_with(definition_key, 'part-') AS leaf, FALSE AS reused
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id, name ORDER BY first_seen, definition_key) AS rn FROM d) t""")
def _(fx):
    d = _landed(fx)["definition"]
    return d.select("file_id", "definition_key", "part_number", (F.col("is_assembly") == 0).alias("leaf"), "reused")


@query("a14_ingest_counters", f"""WITH {_LAND}, e AS (SELECT file_id, COUNT(*) FILTER (WHERE parent_id IS NOT NULL) AS occurrences, COUNT(DISTINCT solid_id) AS solids FROM fx_source_node GROUP BY file_id)
SELECT d.file_id, e.solids, COUNT(*) AS parts_created, COUNT(*) AS revisions_created, 0 AS revisions_reused, e.occurrences FROM d JOIN e ON e.file_id = d.file_id GROUP BY d.file_id, e.solids, e.occurrences""")
def _(fx):
    landed = _landed(fx)
    solid = source_nodes(fx).filter("solid_id IS NOT NULL").select("file_id", "solid_id").distinct()
    c = landing.ingest_counters(landed, solid.withColumn("status", F.lit("new")), solid)
    return c.select("file_id", "solids", "parts_created", "revisions_created", "revisions_reused", "occurrences")


@query("s03_pruned_nodes", """
WITH n AS (SELECT *, COALESCE(solid_id IS NOT NULL AND NOT starts_with(solid_id, 'SMALL'), FALSE) AS solid FROM fx_source_node),
p AS (SELECT DISTINCT file_id, parent_id FROM n WHERE solid), f AS (SELECT DISTINCT file_id FROM n WHERE solid)
SELECT n.file_id, n.node_id FROM n LEFT JOIN p ON p.file_id = n.file_id AND p.parent_id = n.node_id LEFT JOIN f ON f.file_id = n.file_id
WHERE n.solid OR p.parent_id IS NOT NULL OR (n.parent_id IS NULL AND f.file_id IS NOT NULL)""")
def _(fx):
    n = source_nodes(fx)
    solid = n.filter("solid_id IS NOT NULL").select("file_id", "solid_id").distinct().withColumn("n_solids", F.lit(1)).withColumn("checks", F.lit(True)).withColumn(
        "volume", F.when(F.col("solid_id").startswith("SMALL"), -1.0).otherwise(1.0))
    return landing.prune(n, landing.validity(solid).filter("valid")).select("file_id", "node_id")


@query("s09_insert_or_ignore", """
SELECT DISTINCT team_id, part_id, interface_name FROM (SELECT part.p_brand AS team_id, p_partkey AS part_id, CAST(NULL AS VARCHAR) AS interface_name FROM part UNION ALL SELECT p_brand, p_partkey, 'foot' FROM part) n
WHERE NOT EXISTS (SELECT 1 FROM fx_subscription s WHERE s.team_id = n.team_id AND s.part_id = n.part_id AND s.interface_name IS NOT DISTINCT FROM n.interface_name)""")
def _(fx):
    new = fx.part.select("team_id", "part_id", F.explode(F.array(F.lit(None), F.lit("foot"))).alias("interface_name"))
    return landing.insert_or_ignore(fx.subscription, new, ["team_id", "part_id", "interface_name"])


@query("s08_latest_refs", """
SELECT l_suppkey AS ref_name, MAX(l_orderkey * 100 + l_linenumber) AS updated_at FROM lineitem GROUP BY l_suppkey""")
def _(fx):
    log = fx.raw("lineitem").select(F.col("l_suppkey").alias("ref_name"), F.col("l_partkey").alias("revision_id"), F.lit("").alias("root_hash"),
                                    (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("updated_at"), F.lit("x").alias("updated_by"))
    return catalogue.latest_refs(log).select("ref_name", "updated_at")


@query("s10_replace_interference", """
WITH again AS (SELECT DISTINCT CAST(FLOOR((part_id - 1) / 4) * 10 + 1 AS BIGINT) AS root_rev FROM fx_proposal)
SELECT parent_rev AS root_rev, COUNT(*) AS rows, CASE WHEN parent_rev IN (SELECT root_rev FROM again) THEN 2 ELSE 1 END AS run
FROM fx_occurrence WHERE NOT (parent_rev IN (SELECT root_rev FROM again) AND instance_name = 'std') GROUP BY parent_rev""")
def _(fx):
    path = f"{shared_folder(fx.spark)}/interference-{uuid.uuid4().hex}"
    rows = fx.occurrence.select(F.col("parent_rev").alias("root_rev"), F.col("instance_name").alias("path_a"))
    interference.store(rows, rows, path, 1)
    again = fx.proposal.selectExpr("CAST(FLOOR((part_id - 1) / 4) * 10 + 1 AS BIGINT) AS root_rev").distinct()
    interference.store(rows.join(again, "root_rev", "left_semi").filter("path_a <> 'std'"), again, path, 2)
    return interference.stored(fx.spark, path).groupBy("root_rev", "run").agg(F.count(F.lit(1)).alias("rows"))


@query("s12_table_counts", " UNION ALL ".join(f"SELECT '{name}' AS \"table\", COUNT(*) AS rows FROM ({sql})" for name, sql in _STORED.items()) + """
UNION ALL SELECT 'outbox pending', COUNT(*) FROM fx_outbox WHERE outbox_id % 3 > 0""")
def _(fx):
    return catalogue.counts(stored_tables(fx))


@query("s05_json_columns", """
SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(fx):
    # The payload of error events is cut off, so it reads as the default.
    text = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    v = catalogue.json_or(text, "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))
    return fx.raw("events").select("event_id", F.coalesce(v["k"], F.lit(-1)).alias("k"))


_DOCS = "(SELECT topic AS collection, doc_key AS key, arg_max(payload, outbox_id) AS payload, MAX(outbox_id) AS seq FROM fx_outbox GROUP BY topic, doc_key)"


@query("s07_documents", f"SELECT collection, key, payload FROM {_DOCS} d")
def _(fx):
    return documents.latest(fx.outbox.select(F.col("topic").alias("collection"), F.col("doc_key").alias("key"), "payload", F.col("outbox_id").alias("seq")))


@query("s07_document_counts", f"SELECT collection, COUNT(*) AS documents FROM {_DOCS} d GROUP BY collection")
def _(fx):
    return documents.count(fx.outbox.select(F.col("topic").alias("collection"), F.col("doc_key").alias("key"), "payload", F.col("outbox_id").alias("seq")))


@query("s06_json_lines", f"SELECT collection, key, CAST(seq AS VARCHAR) AS last FROM {_DOCS} d")
def _(fx):
    path = f"{shared_folder(fx.spark)}/lines-{uuid.uuid4().hex}"
    good = F.to_json(F.struct(F.col("topic").alias("_collection"), F.col("doc_key").alias("_key"), F.col("outbox_id").cast("string").alias("id")))
    # Every line is followed by a cut-off copy of itself, which readers skip.
    rows = fx.outbox.repartitionByRange(4, "outbox_id").sortWithinPartitions("outbox_id").select(F.explode(F.array(good, F.substring(good, 1, 30))).alias("value"))
    rows.write.text(path)
    return documents.latest(documents.read_json_lines(fx.spark, path)).select("collection", "key", F.get_json_object("payload", "$.id").alias("last"))


@query("c11_load", """
SELECT file_id, COUNT(DISTINCT solid_id) AS exact_hits, COUNT(*) FILTER (WHERE parent_id IS NOT NULL) AS occurrences, CAST(file_id AS VARCHAR) AS ref_name FROM fx_source_node GROUP BY file_id""")
def _(fx):
    n = source_nodes(fx)
    inv = extra(fx, "fx_invariant").select("fingerprint", "volume", "char_length", "chirality", "sphericity", "j1", "j2", "j3", *[F.col(f"d{a}").alias(f"bbox_d{a}") for a in "xyz"])
    solid = n.filter("solid_id IS NOT NULL").select("file_id", "solid_id").distinct().join(
        inv.withColumnRenamed("fingerprint", "solid_id"), "solid_id").withColumn("strict", F.col("solid_id")).withColumn("n_solids", F.lit(1)).withColumn("checks", F.lit(True))
    empty = lambda ddl: fx.spark.createDataFrame([], ddl)
    current = {"part": empty("part_id string, part_number string, description string, team_id string"),
               "revision": empty("revision_id string, part_id string, revision_index int, fingerprint string, material string, density double, is_assembly int"),
               "occurrence": empty("parent_rev string, child_rev string, transform_key string, quantity int"),
               "shape": extra(fx, "fx_invariant"), "shape_alias": empty("alias_fingerprint string, fingerprint string"), "chain": empty("name string"),
               "dimension": empty("dimension_id string, revision_id string, name string, nominal double, tol_plus double, tol_minus double, sigma_span double, distribution string")}
    plane = features.mounting_planes(extra(fx, "fx_face"))
    pattern, _ = features.hole_patterns(bores(fx))
    out = load.load(n, solid, current, bores(fx), plane, pattern, [("^FILE", "import"), ("^Brand#1", "first")], "general", [("^Brand", "steel")], [("^Brand", 0.0078)])
    return out["counters"].select("file_id", "exact_hits", "occurrences").join(
        out["ref"].select(F.col("ref_name").cast("bigint").alias("file_id"), "ref_name"), "file_id")


# -- sinks -----------------------------------------------------------------------------

@query("s14_scene_instances", _WALK + """
SELECT w.path, r.fingerprint, CAST(w.x AS BIGINT) AS x, CAST(w.y AS BIGINT) AS y FROM walk w JOIN fx_revision r ON r.revision_id = w.rev WHERE r.is_assembly = 0""")
def _(fx):
    i = exports.scene(placed(fx), fx.triangle)["instances"]
    return i.select(F.expr("substring(path, instr(path, '/') + 1)").alias("path"), "fingerprint", F.col("matrix")[12].cast("bigint").alias("x"), F.col("matrix")[13].cast("bigint").alias("y"))


@query("s14_scene_bounds", _WALK + """
SELECT CAST(MIN(w.x + CASE w.turn WHEN 0 THEN 0 WHEN 1 THEN -s.dy WHEN 2 THEN -s.dx ELSE 0 END) AS BIGINT) AS min_x,
       CAST(MAX(w.y + CASE w.turn WHEN 0 THEN s.dy WHEN 1 THEN s.dx WHEN 2 THEN 0 ELSE 0 END) AS BIGINT) AS max_y, CAST(MAX(s.dz) AS BIGINT) AS max_z
FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_shape s ON s.fingerprint = r.fingerprint WHERE r.is_assembly = 0""")
def _(fx):
    b = exports.scene(placed(fx), fx.triangle)["bounds"]
    return b.select(*[F.round(c).cast("bigint").alias(c) for c in ("min_x", "max_y", "max_z")])


@query("s15_export_structure", _REACH + """, keep(rev) AS (
  SELECT r.revision_id FROM fx_revision r WHERE r.is_assembly = 0 AND r.density IS NOT NULL
  UNION SELECT o.parent_rev FROM keep k JOIN fx_occurrence o ON o.child_rev = k.rev)
SELECT d.rev AS revision_id, p.part_number FROM inside d JOIN keep k ON k.rev = d.rev JOIN fx_revision r ON r.revision_id = d.rev JOIN fx_part p ON p.part_id = r.part_id
WHERE r.is_assembly = 1 OR r.fingerprint IN (SELECT r2.fingerprint FROM fx_revision r2 WHERE r2.density IS NOT NULL)""")
def _(fx):
    # Leaves without a density have no stored geometry here: their shapes get a name nobody stored.
    rev = fx.revision.withColumn("fingerprint", F.when(F.col("density").isNotNull(), F.col("fingerprint")))
    return exports.export_structure(fx.top_root, fx.occurrence, rev, fx.part, fx.shape)["definitions"].select("revision_id", "part_number")


@query("a15_bom_totals", _DOWN + """
SELECT p.part_number, CAST(SUM(w.qty) AS BIGINT) AS total_qty FROM walk w JOIN fx_revision r ON r.revision_id = w.rev JOIN fx_part p ON p.part_id = r.part_id
WHERE r.is_assembly = 0 GROUP BY p.part_number, r.revision_id ORDER BY total_qty DESC, p.part_number, r.revision_id LIMIT 4""")
def _(fx):
    bom = rollup.bill_of_materials(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape)
    return rollup.bom_totals(bom, 4)[1].select("part_number", "total_qty")


@query("u05_missing_leaves", _REACH + """
SELECT p.part_number FROM fx_part p WHERE p.is_assembly = 0 EXCEPT SELECT p.part_number FROM inside d JOIN fx_revision r ON r.revision_id = d.rev JOIN fx_part p ON p.part_id = r.part_id""")
def _(fx):
    bom = rollup.bill_of_materials(fx.top_root, fx.occurrence, fx.revision, fx.part, fx.shape)
    return diff.missing_names(fx.part.filter("is_assembly = 0"), bom, "part_number")


@query("f23_file_names", "SELECT part_id, regexp_replace(part_number || ' ' || description, '[^a-zA-Z0-9_.-]', '_', 'g') AS file_name FROM fx_part")
def _(fx):
    return fx.part.select("part_id", texts.safe_file_name(F.concat_ws(" ", "part_number", "description")).alias("file_name"))


@query("f22_attributes", "SELECT revision_id, CAST(json_extract(attributes, '$.power_w') AS DOUBLE) AS power, 0.0::DOUBLE AS other FROM fx_contract")
def _(fx):
    get = lambda k: F.coalesce(F.get_json_object("attributes", f"$.{k}").cast("double"), F.lit(0.0))
    return fx.contract.select("revision_id", get("power_w").alias("power"), get("none_w").alias("other"))


# -- streaming -----------------------------------------------------------------------

def _stream(fx):
    raw = outbox.events(fx.spark, fx.folder, fx.raw("events").schema, "events.parquet")
    return raw.selectExpr("event_id AS outbox_id", "event_type AS topic", "concat(event_type, '-', user_id) AS doc_key", "props AS payload", "ts AS created_at")


def _drained(fx):
    base = f"{shared_folder(fx.spark)}/drain-{uuid.uuid4().hex}"
    for _ in range(2):  # the second start finds nothing new
        outbox.drain(_stream(fx), f"{base}/documents", f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return fx.spark.read.parquet(f"{base}/documents"), fx.spark.read.parquet(f"{base}/log")


@query("x01_outbox_drain", f"SELECT collection, key, payload FROM {_DOCS} d")
def _(fx):
    return documents.latest(_drained(fx)[0])


@query("x02_pending", "SELECT COUNT(*) - COUNT(*) AS pending, COUNT(*) AS delivered FROM fx_outbox")
def _(fx):
    _, log = _drained(fx)
    return outbox.pending(fx.outbox, log).agg(F.count(F.lit(1)).alias("pending")).withColumn("delivered", log.agg(F.count(F.lit(1))).scalar())


def _state(fx, df, mode):
    base = f"{shared_folder(fx.spark)}/state-{uuid.uuid4().hex}"

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{base}/out")
    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.parquet(f"{base}/out")


@query("x03_redelivery", "SELECT topic, COUNT(*) AS rows FROM fx_outbox GROUP BY topic")
def _(fx):
    twice = _stream(fx).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return _state(fx, outbox.without_repeats(twice, "1 day"), "append").groupBy("topic").agg(F.count(F.lit(1)).alias("rows"))


@query("x04_latest_documents", f"SELECT collection, key, payload FROM {_DOCS} d")
def _(fx):
    out = _state(fx, outbox.latest_documents(_stream(fx)), "update")
    return documents.latest(out)


# -- roots of proposals, recounted commit by commit ----------------------------

_NEWEST = "newest AS (SELECT r.* FROM fx_revision r JOIN (SELECT part_id, MAX(revision_index) AS top FROM fx_revision GROUP BY part_id) x ON x.part_id = r.part_id AND x.top = r.revision_index)"
_AFFECTED = """goal AS (SELECT MAX(revision_id) AS id FROM fx_revision WHERE part_id = 0),
under(rev) AS (SELECT id FROM goal UNION SELECT o.child_rev FROM under JOIN fx_occurrence o ON o.parent_rev = under.rev),
hit(commit_id, rev) AS (SELECT commit_id, rev FROM asked UNION SELECT hit.commit_id, o.parent_rev FROM hit JOIN fx_occurrence o ON o.child_rev = hit.rev JOIN under ON under.rev = o.parent_rev)"""


def _recount(asked: str, edges: str, levels: int = 7) -> str:
    """The product root's hash per commit. ``asked``: CTE bodies of asked(commit_id, rev) and seed(commit_id, rev, attrs,
    hash), hash null for assemblies; ``edges``: proposed(commit_id, parent_rev, child_rev, pose, quantity) of the parents in relisted."""
    base = _merkle_sql(levels).replace(f" SELECT revision_id, node_hash FROM u{levels}", "")
    out = [base, _NEWEST, asked, _AFFECTED, edges,
           f"""link AS (SELECT hit.commit_id, o.parent_rev, o.child_rev, o.pose, o.quantity FROM hit JOIN occ o ON o.parent_rev = hit.rev
                WHERE NOT EXISTS (SELECT 1 FROM relisted x WHERE x.commit_id = hit.commit_id AND x.parent_rev = hit.rev)
              UNION ALL SELECT commit_id, parent_rev, child_rev, pose, quantity FROM proposed)""",
           "w0 AS (SELECT commit_id, rev, hash FROM seed WHERE hash IS NOT NULL)"]
    lane = _LANE.replace("h.node_hash", "COALESCE(c.hash, b.node_hash)")
    for k in range(1, levels + 1):
        lanes = ", ".join(f"SUM({lane.format(s=1 + 15 * i)}) AS x{i}" for i in range(4))
        out.append(f"""m{k} AS (SELECT t.commit_id, t.rev, {_dig("'node'", "t.attrs", "t.n", "t.x0", "t.x1", "t.x2", "t.x3")} AS hash FROM (
            SELECT o.commit_id, o.parent_rev AS rev, COALESCE(s.attrs, a.attrs) AS attrs, COUNT(*) AS n, {lanes}
            FROM link o JOIN hgt ON hgt.rev = o.parent_rev AND hgt.h = {k} JOIN attr a ON a.revision_id = o.parent_rev JOIN u{levels} b ON b.revision_id = o.child_rev
            LEFT JOIN w{k - 1} c ON c.commit_id = o.commit_id AND c.rev = o.child_rev LEFT JOIN seed s ON s.commit_id = o.commit_id AND s.rev = o.parent_rev
            GROUP BY ALL) t)""")
        out.append(f"w{k} AS MATERIALIZED (SELECT * FROM w{k - 1} UNION ALL SELECT * FROM m{k})")
    return ", ".join(out) + f""" SELECT q.commit_id, COALESCE(w.hash, b.node_hash) AS new_root FROM (SELECT DISTINCT commit_id FROM asked) q CROSS JOIN goal
        JOIN u{levels} b ON b.revision_id = goal.id LEFT JOIN w{levels} w ON w.commit_id = q.commit_id AND w.rev = goal.id"""


_NEW_ATTRS = _dig("'attributes'", "q.new_contract_hash", "r.material", f"CASE WHEN r.density IS NOT NULL THEN {_DENS.replace('density', 'r.density')} END")
_BODY_ASKED = f"""asked AS (SELECT q.commit_id, r.revision_id AS rev, r.material, r.density, q.new_fingerprint, {_NEW_ATTRS} AS attrs FROM fx_proposal q JOIN newest r ON r.part_id = q.part_id),
seed AS (SELECT commit_id, rev, attrs, {_dig("'leaf'", "new_fingerprint", "attrs")} AS hash FROM asked)"""
_NO_EDGES = "relisted AS (SELECT 0 AS commit_id, 0 AS parent_rev WHERE FALSE), proposed AS (SELECT 0 AS commit_id, 0 AS parent_rev, 0 AS child_rev, '' AS pose, 0 AS quantity WHERE FALSE)"
ORACLES["c08_new_roots"] = with_views(_recount(_BODY_ASKED, _NO_EDGES))

# Every assembly's own commit drops the children at even places of its list (one child stays as it is) and takes one more of each other.
_LISTED = """relisted AS (SELECT a.commit_id, a.rev AS parent_rev FROM asked a),
proposed AS (SELECT a.commit_id, o.parent_rev, n.revision_id AS child_rev, o.pose, o.quantity + 1 AS quantity FROM asked a JOIN occ o ON o.parent_rev = a.rev
  JOIN fx_revision c ON c.revision_id = o.child_rev JOIN newest n ON n.part_id = c.part_id
  WHERE o.child_rev % 2 = 0 OR o.child_rev = (SELECT MIN(child_rev) FROM fx_occurrence x WHERE x.parent_rev = a.rev))"""
_LIST_ASKED = "asked AS (SELECT part_id AS commit_id, revision_id AS rev FROM newest WHERE is_assembly = 1), seed AS (SELECT a.commit_id, a.rev, x.attrs, CAST(NULL AS VARCHAR) AS hash FROM asked a JOIN attr x ON x.revision_id = a.rev)"


@query("g07_structure_roots", _recount(_LIST_ASKED, _LISTED))
def _(fx):
    p = product(fx)
    newest = lookup.current_revision(p.rev).filter("is_assembly = 1").select(F.col("part_id").alias("commit_id"), "part_id", F.col("revision_id").alias("parent_rev"))
    least = p.occ.groupBy("parent_rev").agg(F.min("child_rev").alias("_least"))
    kept = p.occ.join(newest, "parent_rev").join(least, "parent_rev").filter("child_rev % 2 = 0 OR child_rev = _least")
    part = p.rev.select(F.col("revision_id").alias("child_rev"), F.col("part_id").alias("child_part_id"))
    children = kept.join(part, "child_rev").withColumn("quantity", F.col("quantity") + 1).select("commit_id", "part_id", "child_part_id", "instance_name", *overlay.EDGE)
    prepared = cut(overlay.with_own_state(proposals.prepare(newest.select("commit_id", "part_id", F.lit("ann").alias("author")), p), p))
    edges, _ = overlay.proposed_edges(prepared, children, p)
    edges = cut(edges)
    found = cut(overlay.totals(prepared, edges, p, hashes(fx), rollups(fx)))
    return proposals.new_roots(prepared, found, p, hashes(fx))


# -- what proposals publish: holes of proposed bodies, moved apart by a tenth ----------------

_READ_OFF = _REACH + """, cur AS (SELECT part_id, MAX(revision_index) AS top FROM fx_revision GROUP BY part_id),
seen AS (
  SELECT q.commit_id, s.socket_id, s.revision_id, i.w * 1.1 AS w, i.h AS h, o.tx, o.ty, o.quarter_turns
  FROM fx_proposal q JOIN cur c ON c.part_id = q.part_id JOIN fx_interface i ON i.revision_id = q.part_id * 10 + c.top
  JOIN fx_occurrence o ON o.child_rev = i.revision_id JOIN inside d ON d.rev = o.parent_rev JOIN fx_socket s ON s.revision_id = o.parent_rev AND s.name = 's-' || o.instance_name)"""


def offered(fx):
    """Interfaces, sockets and contract hashes that the proposals bring; every socket is read off what its name says."""
    def build():
        p = product(fx)
        p = Product(**{**p.__dict__, "socket": p.socket.withColumn("from_instance", F.substring("name", 3, 100)).withColumn("from_interface", F.lit("foot"))})
        wide = F.transform("points", lambda q: F.struct((q["x"] * 1.1).alias("x"), q["y"].alias("y"), q["z"].alias("z")))
        interfaces = cut(prepared(fx).select("commit_id", "part_id", F.col("old_rev").alias("revision_id")).join(p.interface, "revision_id").withColumn("points", wide).drop("revision_id"))
        derived, _ = declared.proposed_sockets(prepared(fx), p, interfaces)
        return derived, declared.proposed_hashes(prepared(fx), p, interfaces, derived)
    return shared(fx, "offered", build)


@query("g07_sockets_read_off", _READ_OFF + f"""
SELECT commit_id, socket_id, 4 AS hole_count, {grid_sql("tx + CASE quarter_turns WHEN 0 THEN w / 2 WHEN 1 THEN -h / 2 WHEN 2 THEN -w / 2 ELSE h / 2 END", 1000)} AS ox,
       {grid_sql("ty + CASE quarter_turns WHEN 0 THEN h / 2 WHEN 1 THEN w / 2 WHEN 2 THEN -h / 2 ELSE -w / 2 END", 1000)} AS oy FROM seen""")
def _(fx):
    return offered(fx)[0].select("commit_id", "socket_id", "hole_count", grid("ox", 1000).alias("ox"), grid("oy", 1000).alias("oy"))


@query("g07_changed_faces", _READ_OFF + """
SELECT commit_id, CAST(rev AS VARCHAR) AS node FROM (SELECT commit_id, revision_id AS rev FROM seen UNION SELECT q.commit_id, q.part_id * 10 + c.top FROM fx_proposal q JOIN cur c ON c.part_id = q.part_id) t
WHERE rev IN (SELECT revision_id FROM fx_contract)""")
def _(fx):
    return offered(fx)[1].select("commit_id", "node")
