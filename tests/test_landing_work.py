"""Landing of new and known definitions, and names numbered over the borders of pieces."""

from pyspark.sql import functions as F

from partloom.functions.ranking import numbered
from partloom.operators import landing, lookup

from .test_rules import NODE, forty_bolts, land


def empty(spark):
    return {"part": spark.createDataFrame([], "part_id string, part_number string"),
            "revision": spark.createDataFrame([], "revision_id string, part_id string, revision_index int, fingerprint string, material string, density double, is_assembly int"),
            "occurrence": spark.createDataFrame([], "parent_rev string, child_rev string, transform_key string, quantity int")}


def test_groups_are_numbered_over_the_borders_of_pieces(spark):
    rows = [(k, n, v) for k, size in (("a", 1), (None, 300), ("b", 500), ("c", 3)) for v in range(size) for n in (None, "x")]
    df = spark.createDataFrame(rows, "k string, n string, v int").repartition(5)
    got = numbered(df, ["k", "n"], ["v"])
    assert got.columns == ["k", "n", "v", "rn"]
    assert all(r.rn == r.v + 1 for r in got.collect()) and got.count() == len(rows)
    assert numbered(df.filter("v < 0"), ["k", "n"], ["v"]).count() == 0


def test_new_definitions_land_without_a_pass_per_level_and_alike(spark):
    one = land(spark, forty_bolts(spark), empty(spark))
    assert {(r.definition_key, r.part_number, r.revision_id, r.created_part, r.reused, r.is_assembly) for r in one["definition"].collect()} == {
        ("asm", "PLATE-ASM", "f/asm", True, False, 1), ("bolt", "BOLT", "f/bolt", True, False, 0)}
    assert {(r.parent_rev, r.child_rev) for r in one["occurrence"].collect()} == {("f/asm", "f/bolt")}
    assert [(r.file_id, r.occurrences) for r in one["edges"].collect()] == [("f", 40)]
    assert {(r.revision_id, r.fingerprint, r.material) for r in one["revision"].collect()} == {("f/asm", None, None), ("f/bolt", "fp", "steel")}


def test_an_assembly_with_one_new_child_among_known_ones_is_revised(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    tree = lambda f, inner: spark.createDataFrame([(f, "r", None, "asm", "PLATE-ASM", "", None, 1, 0, *eye), (f, "s", "r", "sub", "SUB", "", None, 1, 1, *eye),
                                                   (f, "b", "s", "bolt", "BOLT", "", "s", 1, 2, *eye), (f, "c", "s", inner, inner, "", "s", 1, 3, *eye)], NODE)
    one = land(spark, tree("f", "NUT"), empty(spark))
    two = land(spark, tree("g", "NUT"), one)
    assert two["revision"].isEmpty()
    three = land(spark, tree("h", "PIN"), one)
    assert {r.definition_key: (r.reused, r.created_part, r.revision_id) for r in three["definition"].collect()} == {
        "asm": (False, False, "h/asm"), "sub": (False, False, "h/sub"), "bolt": (True, False, "f/bolt"), "PIN": (False, True, "h/PIN")}
    assert {(r.parent_rev, r.child_rev) for r in three["occurrence"].collect()} == {("h/asm", "h/sub"), ("h/sub", "f/bolt"), ("h/sub", "h/PIN")}


def test_part_numbers_keep_the_other_columns(spark):
    d = spark.createDataFrame([("f", "k1", "N", 2, "x"), ("f", "k2", "N", 1, "y"), ("g", "k1", "N", 1, "z")], "file_id string, definition_key string, name string, first_seen int, other string")
    assert {(r.file_id, r.definition_key, r.part_number, r.other) for r in lookup.with_part_numbers(d).collect()} == {("f", "k2", "N", "y"), ("f", "k1", "N#2", "x"), ("g", "k1", "N", "z")}
    assert lookup.number_colliding_names(d.union(d)).filter(F.col("part_number") == "N#2").count() == 1


def trees(spark):
    """Nodes of three files: repeated definitions, rows that come twice, nameless, keyless and nodeless ones."""
    rows = [(None, "x", None, "k", 0, "N", None)]
    for f, size in (("short", 3), ("long", 40), ("other", 1)):
        rows += [(f, "r", None, "root", 0, "ROOT", None), (f, None, "r", None, 1, "lost", "s"), (f, None, "r", "dim", 5, None, "s")]
        for i in range(size):
            rows += [(f, f"a{i}", "r", f"asm{i % 20}", 9 - i, "ASM" if i % 3 else None, None), (f, f"b{i}", f"a{i}", f"bolt{i % 7}", i, "B", "s"), (f, f"b{i}", f"a{i}", f"bolt{i % 7}", i, "B", "s")]
    return spark.createDataFrame(rows, "file_id string, node_id string, parent_id string, definition_key string, position int, name string, solid_id string")


def test_definitions_of_short_and_long_files_are_found_alike(spark, monkeypatch):
    n = trees(spark)
    short = {tuple(r) for r in landing._definitions(n).select("file_id", "definition_key", "first_seen", "node_id", "name", "solid_id", "kids", "part_number", "is_assembly").collect()}
    assert ("short", "root", 0, "r", "ROOT", None, 5, "ROOT", 1) in short and ("short", "asm1", 8, "a1", "ASM", None, 2, "ASM#2", 1) in short
    assert ("long", "asm0", -11, "a20", "ASM", None, 2) in {r[:7] for r in short} and ("short", "dim", 5, None, "unnamed", "s", 0, "unnamed", 0) in short
    assert len(short) == len({r[:2] for r in short}) and None not in {r[0] for r in short}
    for most in (0, 30):
        monkeypatch.setattr(landing, "SHORT", most)
        found = landing._definitions(n).select("file_id", "definition_key", "first_seen", "node_id", "name", "solid_id", "kids", "part_number", "is_assembly").collect()
        assert {tuple(r) for r in found} == short and len(found) == len(short)


def test_nodes_of_short_files_move_once(spark):
    plan = landing._of_short_files(trees(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
