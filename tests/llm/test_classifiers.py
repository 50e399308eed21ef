"""Toxicity, quality and language: held-out accuracy, folds, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import language, quality, toxicity

BAD = ["grumble", "snarlfang", "vexwort"]
LABELS = "doc_id long, quality int, toxic int"


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


@pytest.fixture()
def toxic(documents, spark, prose):
    docs, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = prose(40, k)
        docs.append((k, text.replace(" ", f" {BAD[k % 3]}ish ", 2) if bad else text))
        labels.append((k, 1, int(bad)))
    return documents(docs), spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (10_000, 0, 1)], LABELS)


def test_toxicity_learns_word_parts(toxic, documents, prose):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    new = documents([(k, f"{prose(30, 900 + k)} {BAD[k % 3]}ly {prose(30, 950 + k)}" if k % 2 else prose(60, 900 + k)) for k in range(40)])
    got = {r["doc_id"]: r for r in toxicity.classify(new, model).collect()}
    assert all((got[k]["score"] >= 0.5) == k % 2 for k in range(40)), sorted((k % 2, k, round(got[k]["score"], 2)) for k in range(40))
    assert all(got[k]["held_out"] == (fold(k, 3) == 1) and got[k]["predicted"] == (got[k]["score"] >= 0.7) for k in range(40))


def test_toxicity_ignores_held_out_labels(toxic, spark):
    docs, labels = toxic
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.feature, b.feature) and np.allclose(a.weight, b.weight) and a.intercept == b.intercept


def test_scores_do_not_depend_on_neighbours(toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in docs.collect()][:50] + ["", "z" * 2_000_000]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def test_toxicity_of_odd_rows(toxic, odd):
    docs, labels = toxic
    got = toxicity.classify(odd.withColumn("score", F.lit("mine")), toxicity.fit(docs.unionByName(odd), labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd.count()
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.classify(odd.limit(0), toxicity.fit(odd, labels.limit(0))).count() == 0


@pytest.mark.parametrize("only, score", [(0, 0.0), (1, 1.0)])
def test_one_class_gives_its_score(toxic, only, score):
    docs, labels = toxic
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, labels.withColumn(label, F.lit(only)))
        assert all(abs(r["score"] - score) < 1e-9 for r in module.classify(docs, model).collect())


def test_quality_tells_junk(documents, spark, prose):
    docs, labels = [], []
    for k in range(400):
        text = prose(60, k)
        junk = k % 3 == 0
        docs.append((k, [" ".join(w for w in text.split()[:12] for _ in range(9)), text.upper().replace(" ", "!! "), text.replace(" ", "### ")][k // 3 % 3] if junk else text))
        labels.append((k, int(not junk), 0))
    table, known = documents(docs), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], LABELS)
    model = quality.fit(table, known)
    got = quality.classify(table, model).filter("held_out").collect()
    assert len(got) > 60 and np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in got]) > 0.95
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in quality.classify(table, model).collect())


def test_quality_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)], LABELS)
    got = quality.classify(odd.withColumn("label", F.lit(1)), quality.fit(odd, labels))
    assert got.count() == odd.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.classify(odd.limit(0), quality.fit(odd.limit(0), labels)).count() == 0


def test_pooling_equals_one_text_at_a_time(prose):
    vectors = np.random.default_rng(1).normal(size=(quality.UNITS, quality.DIM)).astype(np.float32)
    texts = [prose(n, n) for n in (0, 1, 2, 50, 400)] + ["", " \n", "A a A a"]
    whole = quality.pooled(texts, vectors)
    assert np.allclose(whole, np.vstack([quality.pooled([t], vectors) for t in texts]), atol=1e-5)


def test_word_vectors_equal_plain_counting(documents):
    text = "one two three one"
    got = quality.units([text])[0]
    total = np.zeros((quality.UNITS, quality.DIM))
    word, shape, _ = quality.units([text])
    for i in range(4):
        for j in range(max(i - 2, 0), min(i + 3, 4)):
            if i != j:
                for here, there in ((word[i], word[j]), (shape[i], word[j]), (shape[i], shape[j])):
                    for k in (0, 1):
                        total[here, quality._PLACE[there, k]] += quality._SIGN[there, k]
    seen = next(iter(quality._contexts(iter([__import__("pandas").DataFrame({"text": [text, None, ""]})]))))
    assert len(got) == 4
    grid = np.zeros_like(total)
    grid[seen["unit"]] = seen[[f"v{i}" for i in range(quality.DIM)]].to_numpy()
    assert np.array_equal(grid, total)


SAMPLES = {"en": "the thing that they think with this other whether", "de": "schön über straße müssen nicht auch noch durch", "fr": "être où français très déjà leçon même ça", "ru": "это просто русский текст который читают"}


def test_language_by_cosine(documents, prose):
    import random
    docs = []
    for k in range(200):
        lang = sorted(SAMPLES)[k % 4]
        words = SAMPLES[lang].split()
        docs.append((k, " ".join(random.Random(k).choice(words) for _ in range(30)), lang))
    docs += [(1000, "123 ... !!", "en"), (1001, None, "en"), (1002, "", None), (1003, "the other", None)]
    table = documents([d + ("src0",) for d in docs])
    got = {r["doc_id"]: r for r in language.identify(table.withColumn("score", F.lit(1)), language.fit(table)).collect()}
    assert all(got[k]["lang_pred"] == sorted(SAMPLES)[k % 4] for k in range(200))
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(k, 4) == 2) for k, r in got.items())


def test_bundle_is_the_sum_of_bound_letters():
    grams, counts, any_letter = language.trigrams("Abcab")
    want = np.zeros(language.DIM)
    padded = " abcab "
    for i in range(1, len(padded) - 1):
        a, b, c = (language.letter(ord(x)).astype(int) for x in padded[i - 1:i + 2])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert any_letter and np.array_equal(language.bundle(grams, counts), want)


def test_language_of_odd_rows(odd):
    model = language.fit(odd)
    assert model.languages == ("en",)
    got = language.identify(odd, model)
    assert got.count() == odd.count()
    none = language.fit(odd.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(odd.limit(0), none).count() == 0
