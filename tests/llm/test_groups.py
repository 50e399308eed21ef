"""Near duplicates, mixing, and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from partloom.llm import common, embeddings, mixing, simhash


def closure(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_equal_their_definition(prose):
    for text in ["", " \n", "One", "one TWO three", "a b c d", "a b c d e", "ÀB é x y z w", "\x1c a b \x0b c\x85d e f", prose(500, 1), prose(70, 2) * 3]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_hash_is_the_engines(spark):
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first()["h"] % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("width, radius", [(8, 0), (8, 1), (12, 2), (16, 1)])
def test_tree_visits_every_value_in_reach(width, radius):
    plan = simhash.tree(width, radius, leaf=8)
    draw = np.random.default_rng(1)
    every = np.arange(1 << width, dtype=np.uint32)
    for v in draw.integers(0, 1 << width, 50):
        near = {int(plan.home[x]) for x in every[np.bitwise_count(every ^ np.uint32(v)) <= radius]}
        assert {x for x in near if x > plan.home[v]} == set(plan.visits[plan.first[v]:plan.first[v + 1]].tolist())


@pytest.mark.parametrize("blocks, shard", [(4, 4000), (4, 7), (8, 4000), (5, 50)])
def test_links_equal_all_pairs(spark, monkeypatch, blocks, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)  # small pieces: groups are dealt out to many tasks
    draw = random.Random(8)
    values = [draw.getrandbits(64) for _ in range(60)]
    for center in values[:12]:
        for _ in range(25):
            x = center
            for bit in draw.sample(range(64), draw.randint(1, 6)):
                x ^= 1 << bit
            values.append(x)
    values = sorted(set(values))
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(signed)] + [(5000, signed[3])], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.grouped(rows, 4, blocks).collect()}
    assert [got[s] for s in signed] == closure(len(values), pairs)


def test_near_duplicates_of_documents(documents, odd, prose):
    base = prose(400, 31)
    docs = documents([(50, base), (51, base), (52, base.replace("river", "stream", 1)), (53, prose(400, 32)), (54, base.upper())]).unionByName(odd)
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit(1)).withColumn("component", F.lit(2)))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == docs.count()
    of = {r["doc_id"]: r for r in got.collect()}
    assert of[50]["component_id"] == of[51]["component_id"] == of[54]["component_id"] == 50 and of[53]["component_id"] == 53
    assert of[50]["fingerprint"] == f"{plain_fingerprint(base):016x}"
    assert {of[k]["fingerprint"] for k in (1, 2, 3)} == {"0" * 16} and {of[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(documents, odd, prose):
    base = prose(300, 41)
    docs = documents([(60, base), (60, base), (61, base), (60, prose(300, 42)), (62, prose(300, 42)), (None, prose(50, 43)), (None, prose(50, 44))]).unionByName(odd)
    docs = docs.withColumn("_keep", F.lit(0)).withColumn("fp", F.lit("x"))
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    marked = simhash.near_duplicates(docs)
    groups = {r["fingerprint"] for r in marked.collect()}
    # groups of one text each here, except those linked; none vanishes and none stays twice
    kept = [plain_fingerprint(r["text"]) for r in got.collect()]
    assert len(kept) == len(set(kept)) and {f"{x:016x}" for x in kept} <= groups
    components = closure(len(groups), [(i, j) for i, a in enumerate(sorted(groups)) for j, b in enumerate(sorted(groups)) if i < j and (int(a, 16) ^ int(b, 16)).bit_count() <= 4])
    assert len(kept) == len(set(components))
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5000, 5000)]
    for _ in range(300):
        edges.append((3000 + draw.randrange(300), 3000 + draw.randrange(300)))
    draw.shuffle(edges)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure(6000, edges)
    assert all(want[k] == c for k, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_embeddings(rows):
    valid = [(k, lab, np.array(v, float)) for k, (_, lab, v) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(a[0], b[0]) for i, a in enumerate(valid) for b in valid[:i]
             if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98]
    return pairs


@pytest.mark.parametrize("chunk", [1500, 9])
def test_embeddings_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    draw = np.random.default_rng(5)
    rows = []
    for k in range(40):
        center = draw.normal(size=32)
        for _ in range(1 + k % 12):
            rows.append((len(rows), k % 3, (center + draw.normal(size=32) * 0.03 * (k % 4)).astype(np.float32).tolist()))
    nan, inf = float("nan"), float("inf")
    rows += [(len(rows) + k, lab, v) for k, (lab, v) in enumerate([(None, rows[0][2]), (0, None), (0, []), (0, [0.0] * 32), (0, [nan] * 32), (0, [inf] + [1.0] * 31),
                                                                  (0, [None] + [1.0] * 31), (0, [1.0, 2.0]), (0, [2.0, 4.0]), (0, [1.0]), (0, [3.0])])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4).withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table).collect()}
    pairs = expected_embeddings(rows)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert len(pairs) > 100 and len(got) == len(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.93 * 2 * len(pairs)  # many of them lie at the threshold itself
    assert all(r["n_links"] <= links[k] for k, r in got.items())
    root = closure(len(rows), pairs)
    assert sum(root[k] == r["component_id"] for k, r in got.items()) >= 0.93 * len(rows)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_embeddings_repeated_and_empty(spark):
    v = [1.0, 0.5, -2.0, 0.25]
    rows = [(4, 1, v), (4, 1, v), (2, 1, v), (None, 1, v), (9, 2, v), (None, None, None)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table).collect()), key=str)
    assert got == sorted([(4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (None, 3, 2, False), (9, 0, 9, True), (None, 0, None, True)], key=str)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix_meets_its_targets(documents, prose):
    draw = random.Random(1)
    docs, n = [], 0
    for source, count in (("a", 40), ("b", 3), ("ä", 25), ("c", 1), (None, 10), ("d", 60), ("e", 2)):
        for _ in range(count):
            docs.append((n, prose(draw.randint(0, 60), n), "en", source))
            n += 1
    docs += [(500, None, "en", "a"), (501, "", "en", "z"), (7, docs[7][1], "en", "a"), (None, "q w", "en", "a"), (None, "q w", "en", "a")]
    table = documents(docs).withColumn("rank", F.lit(1))
    got = mixing.mix_sizes(table).join(table.select("doc_id", "source").distinct(), "doc_id")
    rows = [r for r in mixing.mix(table.withColumn("target", F.lit("old"))).collect()]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = expected_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2, s
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in rows if r["source"] == s)
    assert got.count() >= len(docs) - 2
    again = sorted((str(r["doc_id"]), r["text"] or "", r["taken"]) for r in mixing.mix(table.repartition(7)).collect())
    assert again == sorted((str(r["doc_id"]), r["text"] or "", r["taken"]) for r in rows)


def test_mix_of_odd_and_empty_tables(odd):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix_sizes(odd.limit(0)).count() == 0
    blank = mixing.mix(odd.filter("doc_id IN (1, 2, 3)"))
    assert {(r["size"], r["target"], r["taken"]) for r in blank.collect()} == {(0, 0.0, 0)}


@pytest.fixture()
def folder(spark, documents, odd, prose, tmp_path):
    base, item = prose(200, 71), prose(25, 72)
    docs = [(k, prose(60, 200 + k) + (" vexwort snarlfang" if k % 5 == 0 else ""), "en", f"src{k % 3}") for k in range(10, 210)]
    docs += [(300, base), (301, base), (302, f"{prose(80, 73)} {item} {prose(80, 74)}"), (303, prose(50, 75) + " token=abcdef123456"), (304, prose(50, 76))]
    documents(docs).unionByName(odd).withColumn("score", F.lit("extra")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(10, 210)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, texts = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        ids[name], texts[name] = {r["doc_id"] for r in rows}, {r["doc_id"]: r["text"] for r in rows}
        assert docs.columns[:len(columns)] == columns
    assert not any("vexwort" in (t or "") for t in texts["toxicity"].values()) and {300, 301, 302, 303, 304} <= ids["toxicity"]
    assert ids["toxicity"] - ids["near_duplicates"] == {301, 2, 3}
    assert ids["near_duplicates"] - ids["benchmark"] == {302}
    assert ids["benchmark"] == ids["secrets"] and texts["secrets"][303].endswith(" [SECRET]") and texts["secrets"][304] == texts["benchmark"][304]
    assert ids["mixing"] <= ids["secrets"] and docs.columns[-4:] == mixing.OUT and docs.filter("taken <= 0").count() == 0
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
