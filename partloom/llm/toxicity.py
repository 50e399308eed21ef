"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Every n-gram of 3 to 5 characters (letters lower-cased, all else a blank) is hashed to one
of 2^18 features and counts once a document. The features' log-count ratios come from the
labelled sample; all that tell the classes apart enter a logistic regression whose inputs are
the ratios themselves. Its slopes are summed where the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.session import written as cut

from .common import by_bytes, label_sample, remainder, small_batches, text_column

BITS = 18
ORDERS = (3, 4, 5)
GAP = "\n" * max(ORDERS)
TASKS = 16  # sums of slopes that the driver adds up a round, of at most 2 MB each
GRAIN = 2.0**-30


def _folded() -> np.ndarray:
    """Code point below 2^16 -> lower-cased letter, or blank."""
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[10] = 10
    return out


_FOLD = _folded()


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, feature) arrays, n-gram by n-gram order and repeats included, for
    groups of neighbouring texts of about a million characters; longer texts alone."""
    for a, b in by_bytes(texts):
        part = [t.replace("\n", " ") for t in texts[a:b]]
        codes = np.frombuffer((GAP.join(part) + GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 1 << 16, _FOLD[np.minimum(codes, 0xFFFF)], codes)
        owner = np.repeat(np.arange(a, b, dtype=np.int32), [len(t) + len(GAP) for t in part])
        h = codes.copy()
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + codes[n - 1:]
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)
                yield owner[:len(h)], (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def once(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature) of the wanted features, each once a document."""
    pairs = [np.unique((o[hit].astype(np.int64) << BITS) | f[hit]) for o, f in features(texts) for hit in [np.flatnonzero(wanted[f])]]
    flat = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return flat >> BITS, flat & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Effective weights by feature (0: not used) and the intercept."""
    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        weights = np.zeros(1 << BITS)
        weights[self.feature] = self.weight
        doc, f = once(texts, weights != 0)
        return 1 / (1 + np.exp(-np.clip(self.intercept + np.bincount(doc, weights[f], minlength=len(texts)), -50, 50)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that hold a feature; one row per feature seen in the task."""
    n = np.zeros((2, 1 << BITS), np.int64)
    every = np.ones(1 << BITS, bool)
    for b in batches:
        label = b["label"].to_numpy()
        doc, f = once(b["text"].tolist(), every)
        for k in (0, 1):
            n[k] += np.bincount(f[label[doc] == k], minlength=1 << BITS)
    seen = np.flatnonzero(n.sum(0))
    yield pd.DataFrame({"feature": seen, "neg": n[0, seen], "pos": n[1, seen]})


class Slope:
    """Slope of the mean logistic loss with an L2 penalty over a written table of rows (label, cols)
    at given weights, the intercept last.

    Rows stay in their tasks: a task sends one sum. Every document's share is rounded to ``GRAIN``,
    so sums are exact in double precision whatever the split or the order.
    """

    def __init__(self, rows: DataFrame, value: np.ndarray, n: int, penalty: float):
        self.rows, self.value, self.n, self.penalty = rows, value, n, penalty

    def __call__(self, w: np.ndarray) -> np.ndarray:
        value, width = self.value, len(self.value)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slope = np.zeros(width + 1)
            for b in batches:
                cols = [np.frombuffer(x, np.int32) for x in b["cols"]]
                doc = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
                col = np.concatenate([np.zeros(0, np.int32), *cols])
                margin = np.bincount(doc, w[col] * value[col], minlength=len(cols)) + w[-1]
                miss = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - b["label"].to_numpy()
                slope[:-1] += np.bincount(col, np.rint(miss[doc] * value[col] / GRAIN), minlength=width)
                slope[-1] += np.rint(miss / GRAIN).sum()
            yield pd.DataFrame({"slope": [slope.tobytes()]})

        parts = self.rows.mapInPandas(sums, "slope binary").collect()  # a row a task, at most ``TASKS``
        slope = sum(np.frombuffer(r["slope"]) for r in parts) * GRAIN / self.n
        slope[:-1] += self.penalty * w[:-1]
        return slope


def descend(loss, width: int, rounds: int = 100, rate: float = 0.1) -> np.ndarray:
    """Weights after ``rounds`` steps of Adam over all rows. Steps are alike in all weights, so a
    word that is known by many features isn't outweighed by the intercept."""
    w, m, v = (np.zeros(width) for _ in range(3))
    for t in range(1, rounds + 1):
        g = loss(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000, sure: float = 4.0, mod: int = 3, held_out: int = 1,
        penalty: float = 1e-4, rounds: int = 100) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fold.

    All features are kept that the classes hold unequally by a likelihood-ratio test of at least
    ``sure`` standard deviations. Without two classes the score is the share of label 1, or 0 if
    there is no label at all; without such a feature it is the share of label 1 in the sample.
    """
    small_batches(documents.sparkSession)
    rows = label_sample(documents, labels.filter("toxic IN (0, 1)"), "toxic", mod, held_out, sample)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 50.0 if n1 else -50.0)
    counts = rows.select("text", "label").mapInPandas(_counts, "feature int, neg long, pos long").groupBy("feature").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 1.0) / (n1 + 2.0)) - F.log((F.col("neg") + 1.0) / (n0 + 2.0))

    def part(seen, rows: int):
        """One cell of the test: observed against expected under equal shares."""
        return F.when(seen > 0, seen * F.log(seen * (n0 + n1) / rows)).otherwise(0.0)

    p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
    both, none = p + q, F.lit(n0 + n1) - p - q
    test = (part(p, n1) + part(q, n0) + part(F.lit(n1) - p, n1) + part(F.lit(n0) - q, n0)
            - both * F.log(both) - F.when(none > 0, none * F.log(none)).otherwise(0.0))
    best = counts.filter("neg + pos >= 3").select("feature", ratio.alias("r"), F.sqrt(F.greatest(2 * test, F.lit(0.0))).alias("z")).filter(
        F.col("z") >= sure).orderBy("feature").toPandas()  # at most 2^18 rows, the number of features
    feature, r = best["feature"].to_numpy(np.int64), best["r"].to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[feature] = np.arange(len(feature))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, f = once(b["text"].tolist(), place >= 0)
            ends = np.cumsum(np.bincount(doc, minlength=len(b)))[:-1]
            yield pd.DataFrame({"label": b["label"], "cols": [x.astype(np.int32).tobytes() for x in np.split(place[f], ends)]})

    held = cut(rows.select("text", "label").mapInPandas(kept, "label int, cols binary").repartition(TASKS))
    w = descend(Slope(held.coalesce(TASKS), r, n0 + n1, penalty), len(feature) + 1, rounds)
    return Model(feature, w[:-1] * r, float(w[-1]))


def score_column(spark, model: Model):
    """text -> struct<score>."""
    return text_column(lambda texts: {"score": model.scores(texts)}, [("score", pa.float64())], spark, "score double")


def classify(documents: DataFrame, model: Model, threshold: float = 0.7, mod: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null and empty texts have no feature: their score is the intercept's. A null id
    counts as empty text for the fold. Repeated rows get equal scores.
    """
    out = documents.select("doc_id", (remainder(mod) == held_out).alias("held_out"), score_column(documents.sparkSession, model)("text").alias("_r"))
    return out.select("doc_id", "held_out", F.col("_r.score").alias("score"), (F.col("_r.score") >= threshold).cast("int").alias("predicted"))
