"""Near copies of the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from partloom.llm import copies
from tests.llm.test_groups import closure


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("shard, piece", [(16_000, 1000), (9, 1000), (16_000, 4), (9, 3)])
def test_near_copies_equal_brute_force(spark, documents, prose, monkeypatch, shard, piece):
    monkeypatch.setattr(copies, "SHARD", shard)
    monkeypatch.setattr(copies, "PIECE", piece)
    draw, texts = random.Random(17), []
    for k in range(40):
        base = prose(120 + 10 * k, 900 + k).split()
        texts.append(" ".join(base))
        for _ in range(5):  # changed words at distances of all kinds around the threshold
            copy = list(base)
            for at in draw.sample(range(len(copy)), draw.randint(1, max(len(copy) // 40, 2))):
                copy[at] = f"changed{draw.randrange(10 ** 6)}"
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    want = sorted(set(closure(len(sets), links)))
    assert len(want) < len(texts) - 60  # there are copies
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(list(enumerate(texts))), "").collect())
    assert got == want


def test_odd_rows_keep_one_of_a_group(spark, documents, odd):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    docs = documents([(70, " ".join(base)), (71, " ".join(base).upper()), (72, " ".join([*base, "more"])), (73, " ".join(base[:13]))]).unionByName(odd)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 4, 5, 6, 7, 8, 70, 73]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_shared_counts_equal_brute_force():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 40_000, draw.integers(0, 30_000))).astype(np.uint64) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    assert copies.shared(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert copies.unpacked(copies.packed(sets[3])).tolist() == sets[3].tolist()


def test_dense_family_below_the_threshold_stays_and_no_pair_row_is_made(spark, documents, prose):
    draw, base = random.Random(2), prose(300, 77).split()
    texts = []
    for k in range(150):
        copy = list(base)
        for at in draw.sample(range(300), 6):  # any two differ in some 12 places: a similarity of about 0.65
            copy[at] = f"own{k}x{at}"
        texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    some = [similarity(sets[i], sets[j]) for i in range(0, 150, 7) for j in range(i)]
    assert 0.55 < sum(some) / len(some) < 0.75 and max(some) < 0.8
    docs = documents(list(enumerate(texts)))
    mark = copies.signature_column(spark)
    rows = docs.select("doc_id", mark("text").alias("_m")).select("doc_id", "_m.*").withColumnRenamed("doc_id", "low")
    met = copies._shards(copies.marks(rows)).mapInArrow(copies._members, copies._MEMBER).count()
    plan = copies.simhash.tree(copies.WIDTH, 1, copies.LEAF)
    assert 150 < met <= 150 * copies.BLOCKS * (1 + int(np.diff(plan.first).max()))  # grows with the texts, not with their pairs
    assert copies.links(docs, rows).count() == 0
    assert copies.deduplicated(docs).count() == 150


def test_small_sets_are_found_exactly(spark, documents):
    draw, texts = random.Random(8), []
    for k in range(60):
        words = [f"w{draw.randrange(10 ** 6)}" for _ in range(draw.randint(8, 44))]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "two", "more"]), " ".join(words[1:]), " ".join([*words[:-1], "other"])]
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and similarity(sets[i], sets[j]) >= 0.8]
    got = sorted(r["doc_id"] for r in copies.deduplicated(documents(list(enumerate(texts)))).collect())
    assert got == sorted(set(closure(len(sets), links)))


def a_shard(n, shard, apart):
    """Random marks, one in six a resident, and some that are nearly the same."""
    draw = np.random.default_rng(n)
    f0, f1 = (draw.integers(0, 2 ** 63, n).astype(np.int64) for _ in range(2))
    for a, b in draw.integers(0, n, (40, 2)):
        f0[b], f1[b] = f0[a] ^ (1 << int(draw.integers(60))), f1[a] ^ (1 << int(draw.integers(60)))
    return {"shard": np.full(n, shard), "f0": f0, "f1": f1, "resident": draw.choice([0, 0, 0, 0, 1, 2], n).astype(np.int8),
            "c0": np.zeros(n, np.int64), "c1": np.full(n, int(apart)), "cside": draw.integers(0, 2, n), "b0": np.zeros(n, np.int64), "b1": np.ones(n, np.int64), "side": draw.integers(0, 2, n)}


@pytest.mark.parametrize("block, apart, dealt", [(0, False, False), (3, False, False), (3, True, False), (3, False, True), (3, True, True)])
def test_candidates_of_a_shard_equal_all_pairs(monkeypatch, block, apart, dealt):
    monkeypatch.setattr(copies, "PAIRS", 1000)
    leaves = copies.simhash.tree(copies.WIDTH, 1, copies.LEAF).leaves
    g = a_shard(300, block * leaves + 5, apart)
    bits = [int(np.uint64(a)) | int(np.uint64(b)) << 64 for a, b in zip(g["f0"], g["f1"])]
    part = lambda x, k: (x >> ((0 if k < 5 else 64) + k % 5 * 12)) & 4095
    want = set()
    for i in range(300):
        for j in range(i):
            near = [k for k in range(10) if (part(bits[i], k) ^ part(bits[j], k)).bit_count() <= 1]
            met = (not apart or g["cside"][i] != g["cside"][j]) and (not dealt or g["side"][i] != g["side"][j])
            if met and (g["resident"][i] or g["resident"][j]) and (bits[i] ^ bits[j]).bit_count() <= copies.MOST and near[:1] == [block]:
                want.add((j, i))
    sides = ("side", "b0", "b1") if dealt else ("cside", "c0", "c0")
    got = [(min(a, b), max(a, b)) for i, j in copies._candidates(g, leaves, *sides) for a, b in zip(i.tolist(), j.tolist())]
    assert set(got) == want and len(got) == len(want) and (want or block)


def test_marks_that_are_not_alike_are_never_listed_as_pairs(monkeypatch):
    listed, plain = [], np.nonzero
    monkeypatch.setattr(copies.np, "nonzero", lambda x: listed.append(len((out := plain(x))[0])) or out)
    for _ in copies._candidates(a_shard(2000, 5, False), copies.simhash.tree(copies.WIDTH, 1, copies.LEAF).leaves, "cside", "c0", "c1"):
        pass
    assert sum(listed) < 3 * 2000  # of four million pairs; random marks are apart
