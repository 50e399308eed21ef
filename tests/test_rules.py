import uuid

from pyspark.sql import functions as F

from partloom.functions import digest, text
from partloom.functions.ranking import rank_within
from partloom.operators import landing, lookup, tolerance
from partloom.session import shared_folder
from partloom.sources import catalogue, documents
from partloom.streaming import outbox

CHAIN = "chain_id string, name string, target_low double, target_high double, method string"
MEMBER = "chain_id string, seq int, part_id string, nominal double, tol_plus double, tol_minus double, direction int, sigma_span double, distribution string"


def grip(spark, span=3.0, method="worst_case"):
    dims = [(32.20, 0.10, 1), (6.00, 0.10, -1), (20.00, 0.20, -1), (6.00, 0.10, -1)]
    return (spark.createDataFrame([("c", "bolt-grip", 0.0, None, method)], CHAIN),
            spark.createDataFrame([("c", i + 1, f"p{i}", n, t, t, d, span, "normal") for i, (n, t, d) in enumerate(dims)], MEMBER))


def test_bolt_grip_chain(spark):
    r = tolerance.with_verdict(tolerance.totals(*grip(spark))).first()
    near = lambda a, b: abs(a - b) < 1e-4
    assert near(r.nominal, 0.2) and near(r.worst_low, -0.3) and near(r.worst_high, 0.7) and near(r.rss_half_band, 0.2646) and not r.passes
    mc = tolerance.monte_carlo(*grip(spark)).first()
    assert near(round(mc.mc_mean, 2), 0.2) and 0.005 < mc.mc_failure_rate < 0.03
    loose = tolerance.monte_carlo(*grip(spark, 1.0)).first()
    same = tolerance.totals(*grip(spark, 1.0)).first()
    assert near(same.rss_half_band, r.rss_half_band) and loose.mc_failure_rate > 0.15
    assert "0.300 mm too low" in tolerance.evaluate(*grip(spark)).first().explanation


def test_centreline_chain_passes_statistically_only(spark):
    chain = lambda m: spark.createDataFrame([("c", "centreline", 37.88, 38.12, m)], CHAIN)
    member = spark.createDataFrame([("c", 1, "a", 8.0, 0.1, 0.1, 1, 3.0, "normal"), ("c", 2, "b", 30.0, 0.05, 0.05, 1, 3.0, "normal")], MEMBER)
    ok = lambda m: tolerance.with_verdict(tolerance.totals(chain(m), member)).first().passes
    assert ok("rss") and not ok("worst_case")


def test_sampled_totals_do_not_depend_on_partitions_or_pieces(spark):
    chain, member = grip(spark)
    a = tolerance.monte_carlo(chain, member, 500).first()
    b = tolerance.monte_carlo(chain, member.repartition(3, "seq"), 500).first()
    assert abs(a.mc_low - b.mc_low) < 1e-12 and a.mc_failure_rate == b.mc_failure_rate
    dealt = tolerance.monte_carlo(chain, member, 500, piece=2).first()
    assert abs(a.mc_low - dealt.mc_low) < 1e-12 and abs(a.mc_mean - dealt.mc_mean) < 1e-12 and a.mc_failure_rate == dealt.mc_failure_rate
    hot = tolerance.sampled_totals(member, 500, spread=True).groupBy().agg(F.sum("total")).first()[0]
    assert abs(hot - tolerance.sampled_totals(member, 500).groupBy().agg(F.sum("total")).first()[0]) < 1e-6


def test_sampled_bands_agree_with_closed_forms(spark):
    """One member each: the mean, the two outer percentiles and the failure rate of 20,000 draws against the distribution itself."""
    rows = [("n", "normal", 3.0), ("u", "uniform", 3.0), ("t", "triangular", 3.0)]
    chain = spark.createDataFrame([(c, c, None, 10.2, "monte_carlo") for c, _, _ in rows] + [("free", "free", None, None, "rss"), ("none", "none", 0.0, 1.0, "rss")], CHAIN)
    member = spark.createDataFrame([(c, 1, "p", 10.0, 0.5, 0.1, 1, s, d) for c, d, s in rows] + [("free", 1, "p", 10.0, 0.5, 0.1, -1, 3.0, "normal"),
                                   ("free", 2, "q", 1.0, None, 0.1, 1, 3.0, "normal")], MEMBER)
    got = {r.chain_id: r for r in tolerance.monte_carlo(chain, member).collect()}
    assert set(got) == {"n", "u", "t", "free"} and got["n"].mc_samples == 20_000
    assert got["free"].mc_mean is None and got["free"].mc_failure_rate is None  # a member without its tolerance
    tail = 0.00135
    low = {"n": 10.2 - 0.3, "u": 9.9 + 0.6 * tail, "t": 9.9 + 0.3 * (2 * tail) ** 0.5}
    slack = {"n": 0.02, "u": 0.001, "t": 0.006}
    for c, r in ((k, got[k]) for k in "nut"):
        assert abs(r.mc_mean - 10.2) < 0.004 and abs(r.mc_failure_rate - 0.5) < 0.015
        assert abs(r.mc_low - low[c]) < slack[c] and abs(r.mc_high - (20.4 - low[c])) < slack[c]


def test_sums_of_draws_have_the_variance_of_their_members(spark):
    chain = spark.createDataFrame([("c", "c", None, None, "rss")], CHAIN)
    member = spark.createDataFrame([("c", i, "p", 1.0, 0.3, 0.3, 1 if i % 2 else -1, 3.0, d) for i, d in enumerate(["normal", "uniform", "triangular"] * 20)], MEMBER)
    want = (20 * (0.01 + 0.03 + 0.015)) ** 0.5  # squared: 0.3/3, 0.3/sqrt 3, 0.3/sqrt 6
    r = tolerance.monte_carlo(chain, member).first()
    assert abs(r.mc_mean) < 4 * want / 20_000 ** 0.5 and abs((r.mc_high - r.mc_low) / 2 - 3 * want) < 0.3 * want


def test_an_empty_chain_says_so(spark):
    chain = spark.createDataFrame([("e", "empty", None, None, "rss")], CHAIN)
    r = tolerance.totals(chain, grip(spark)[1]).first()
    assert r.nominal == 0 and "is empty" in r.warnings


def test_gaps_are_named_one_by_one(spark):
    cols = "contract_id string, provenance string, reviewed int, is_assembly int, fingerprint string, density double, status string"
    rows = [(None, None, None, 0, "f", 1.0, "released"), ("c", "auto_drafted", 0, 0, "f", 1.0, "released"), ("c", "declared", 1, 0, "f", None, "released"),
            ("c", "declared", 1, 0, "f", 1.0, "draft"), ("c", "declared", 1, 1, None, None, "released")]
    got = [r.g for r in spark.createDataFrame(rows, cols).select(lookup.gaps().alias("g")).collect()]
    assert [len(g) for g in got] == [1, 1, 1, 1, 0]
    assert [k in g[0] for k, g in zip(("lacks a contract", "awaits review", "density", "draft"), got)] == [True] * 4


def test_rules_take_the_first_match(spark):
    df = spark.createDataFrame([("BOLT-M6X20",), ("PLATE",)], "name string")
    n = F.col("name")
    got = df.select(text.first_rule(n, [("BOLT", "fasteners"), ("M6", "other")], "chassis"), text.first_rule(n, [("BOLT", ""), (".", "steel")])).collect()
    assert [tuple(r) for r in got] == [("fasteners", None), ("chassis", "steel")]


def test_step_sentences(spark):
    c = lambda v: F.lit(v).cast("string")
    one = lambda *a: spark.range(1).select(text.step_text(*[c(x) for x in a])).first()[0]
    assert one("socket", None, "no hole", None, None) == "[socket] no hole"
    assert one("socket", "s1", "no hole", "LID", "blue") == "[socket] s1: no hole (other party: LID and blue)"


def test_broken_json_reads_as_the_default(spark):
    df = spark.createDataFrame([('[[1,2,3]]',), ('[[1,2',), (None,)], "p string")
    assert [len(r.p) for r in df.select(catalogue.points("p").alias("p")).collect()] == [1, 0, 0]


def test_json_lines_skip_bad_lines_and_keep_the_last(spark):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines = ['{"_collection":"a","_key":"1","v":1}', '{"_collection":"a","_key":', '', '{"_collection":"a","_key":"2","v":2}', '{"_collection":"a","_key":"1","v":3}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    d = documents.read_json_lines(spark, path)
    assert documents.count(d).first().documents == 2
    assert documents.find(d, "a", v=3).count() == 1 and documents.find(d, "a", v=1).count() == 0


def test_draining_twice_delivers_once_and_keeps_refused_rows(spark):
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    rows = spark.createDataFrame([(1, "t", "k", '{"v":1}'), (2, "t", "k", '{"v":2}'), (3, "t", None, "{}"), (4, "t", "x", "[1]"), (5, "t", "y", "{bad")],
                                 "outbox_id bigint, topic string, doc_key string, payload string").withColumn("created_at", F.current_timestamp())
    rows.write.parquet(f"{base}/in")
    for _ in range(2):
        s = outbox.events(spark, f"{base}/in", rows.schema)
        outbox.drain(s, f"{base}/docs", f"{base}/log", f"{base}/check").awaitTermination()
    docs, log = spark.read.parquet(f"{base}/docs"), spark.read.parquet(f"{base}/log")
    assert sorted((r.key, r.payload) for r in documents.latest(docs).collect()) == [("k", '{"v":2}'), ("outbox_3", "{}"), ("y", "{}")]
    assert [r.outbox_id for r in outbox.pending(rows, log).collect()] == [4] and log.count() == 5


NODE = "file_id string, node_id string, parent_id string, definition_key string, name string, instance_name string, solid_id string, quantity int, position int, " + \
       ", ".join(f"m{r}{c} double" for r in range(3) for c in range(4))


def forty_bolts(spark, file="f", jitter=0.0, order=1):
    eye = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [(file, "r", None, "asm", "PLATE-ASM", "", None, 1, 0, *eye(0.0))]
    rows += [(file, f"n{i}", "r", "bolt", "BOLT", "b", "s", 1, i + 1, *eye(5.0 * i + jitter)) for i in range(40)][::order]
    return spark.createDataFrame(rows, NODE)


def land(spark, node, current):
    fp = node.filter("solid_id IS NOT NULL").select("file_id", "solid_id", F.lit("fp").alias("fingerprint")).distinct()
    attrs = spark.createDataFrame([("PLATE-ASM", "t", None, None), ("BOLT", "t", "steel", 0.0078)], "name string, team_id string, material string, density double")
    return landing.land(node, fp, attrs, current)


def test_forty_bolts_land_once_and_a_second_import_reuses_them(spark):
    none = {"part": spark.createDataFrame([], "part_id string, part_number string"),
            "revision": spark.createDataFrame([], "revision_id string, part_id string, revision_index int, fingerprint string, material string, density double, is_assembly int"),
            "occurrence": spark.createDataFrame([], "parent_rev string, child_rev string, transform_key string, quantity int")}
    one = land(spark, forty_bolts(spark), none)
    assert (one["part"].count(), one["revision"].count(), one["occurrence"].count()) == (2, 2, 40)
    for again in (forty_bolts(spark, "g", order=-1), forty_bolts(spark, "h", jitter=1e-8)):
        two = land(spark, again, one)
        assert two["revision"].isEmpty() and two["part"].isEmpty() and two["definition"].filter("NOT reused").isEmpty()
    moved = land(spark, forty_bolts(spark, "i").withColumn("m03", F.when(F.col("node_id") == "n39", 500.0).otherwise(F.col("m03"))), one)
    assert [(r.part_id, r.revision_index) for r in moved["revision"].collect()] == [("part/PLATE-ASM", 2)]


def test_containers_are_unwrapped_and_empty_branches_pruned(spark):
    rows = [("f", "top", None, "", "x", None), ("f", "asm", "top", "a", "ASM", None), ("f", "good", "asm", "g", "GOOD", "s1"), ("f", "bad", "asm", "b", "BAD", "s2"), ("f", "hollow", "asm", "h", "HOLLOW", None)]
    n = spark.createDataFrame(rows, "file_id string, node_id string, parent_id string, definition_key string, name string, solid_id string")
    kept = landing.prune(n, spark.createDataFrame([("f", "s1")], "file_id string, solid_id string")).collect()
    assert {(r.node_id, r.parent_id) for r in kept} == {("asm", None), ("good", "asm")}


def test_digest_pieces_do_not_run_together(spark):
    a = spark.range(1).select(digest.digest(F.lit("ab"), F.lit("c")), digest.digest(F.lit("a"), F.lit("bc"))).first()
    assert a[0] != a[1] and len(a[0]) == 16


def test_catalogue_schemas_parse(spark):
    assert len(catalogue.COLUMNS) == 21 and all(len(catalogue.schema(t)) > 2 for t in catalogue.COLUMNS)


def test_next_index_counts_within_a_batch(spark):
    rev = spark.createDataFrame([("r", "p", 3)], "revision_id string, part_id string, revision_index int")
    new = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "part_id string, at int")
    got = lookup.next_revision_index(new, rev, ["at"]).collect()
    assert sorted((r.part_id, r.revision_index) for r in got) == [("p", 4), ("p", 5), ("q", 1)]
    assert rank_within(new, ["part_id"], ["at"]).count() == 3


def test_a_revision_behind_a_gap_is_compared_with_the_newest_earlier_one(spark):
    rev = spark.createDataFrame([("r1", "p", 1, "f"), ("r4", "p", 4, "f"), ("r5", "p", 5, "g"), ("q3", "q", 3, "f")], "revision_id string, part_id string, revision_index int, fingerprint string")
    contract = spark.createDataFrame([("r1", "h"), ("r4", "h"), ("r5", "h")], "revision_id string, contract_hash string")
    got = {r.revision_id: r.classification for r in lookup.classify_changes(rev, contract).collect()}
    assert got == {"r1": "breaking", "r4": "no_op", "r5": "internal", "q3": "breaking"}
