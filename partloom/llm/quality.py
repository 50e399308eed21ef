"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

A word's unit is a hash bucket, and besides it a bucket of its shape (case, digits, what it
ends with, whether it repeats the word before). Every unit has a sparse random index vector;
its word vector is the sum of the index vectors of its neighbours over the whole corpus.
A document's vector is the mean and spread of its units' vectors. The network's
probabilities are calibrated with a temperature on labelled rows it did not learn from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, label_sample, remainder, small_batches, text_column

WORDS = 1 << 13
SHAPES = 256
UNITS = WORDS + SHAPES
DIM = 32
WINDOW = 2
KNOWN = 300_000


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Two places of each unit's index vector, and their signs."""
    draw = np.random.Generator(np.random.PCG64(7))
    return draw.integers(0, DIM, (UNITS, 2)), draw.choice(np.array([-1.0, 1.0]), (UNITS, 2))


_PLACE, _SIGN = _index()


def _unit(word: str) -> int:
    """The word's bucket and, above it, its shape."""
    core = word.strip(".,;:!?\"'()").lower()
    last = word[-1]
    end = 0 if last.isalnum() else 1 if last in ".,;:" else 2 if last in "!?" else 3
    case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
    size = min(len(core) // 4, 3)
    shape = end | case << 2 | size << 4 | any(c.isdigit() for c in word) << 6
    return zlib.crc32((core or word).encode("utf-8", "surrogatepass")) % WORDS | shape << 16


class _Known(dict):
    """Units of the words seen by this worker; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        self[word] = unit = _unit(word)
        return unit


_KNOWN = _Known()


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word units, shape units and the number of words of each text."""
    if len(_KNOWN) > KNOWN:
        _KNOWN.clear()
    sizes, flat = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = t.split()
        sizes[i] = len(words)
        flat.append(np.fromiter(map(_KNOWN.__getitem__, words), np.int64, len(words)))
    packed = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    word, shape = packed & 0xFFFF, packed >> 16
    same = np.zeros(len(word), np.int64)
    same[1:] = word[1:] == word[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    same[starts[sizes > 0]] = 0
    return word, WORDS + (shape | same << 7), sizes


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The task's sum of neighbours' index vectors, by unit."""
    total = np.zeros(UNITS * DIM)
    for b in batches:
        texts = [t or "" for t in b["text"]]
        for lo, hi in by_bytes(texts):
            word, shape, sizes = units(texts[lo:hi])
            doc = np.repeat(np.arange(hi - lo), sizes)
            for gap in range(1, WINDOW + 1):
                inside = doc[gap:] == doc[:-gap]
                left, right = word[:-gap][inside], word[gap:][inside]
                for here, there in ((left, right), (right, left), (shape[:-gap][inside], right), (shape[gap:][inside], left),
                                    (shape[:-gap][inside], shape[gap:][inside]), (shape[gap:][inside], shape[:-gap][inside])):
                    for k in (0, 1):
                        total += np.bincount(here * DIM + _PLACE[there, k], _SIGN[there, k], minlength=UNITS * DIM)
    grid = total.reshape(UNITS, DIM).astype(np.int64)
    seen = np.flatnonzero(np.abs(grid).sum(1))
    yield pd.DataFrame({"unit": seen, **{f"v{i}": grid[seen, i] for i in range(DIM)}})


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Vectors of all units from the whole corpus: UNITS x DIM numbers, whatever its size."""
    small_batches(documents.sparkSession)
    cols = [f"v{i}" for i in range(DIM)]
    part = documents.select("text").mapInPandas(_contexts, "unit int, " + ", ".join(f"{c} long" for c in cols))
    got = part.groupBy("unit").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most UNITS rows
    out = np.zeros((UNITS, DIM))
    out[got["unit"].to_numpy(np.int64)] = got[cols].to_numpy(float)
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
    mean = out[np.abs(out).sum(1) > 0].mean(0) if len(got) else 0
    return np.where(np.abs(out).sum(1, keepdims=True) > 0, out - mean, 0).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of word vectors, mean of shape vectors, and log length, per text."""
    out = np.zeros((len(texts), 3 * DIM + 1), np.float32)
    for lo, hi in by_bytes(texts):
        word, shape, sizes = units(texts[lo:hi])
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            n = sizes[full][:, None]
            rows = vectors[word]
            mean = np.add.reduceat(rows, starts) / n
            out[lo + full, :DIM] = mean
            out[lo + full, DIM:2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(rows * rows, starts) / n - mean * mean, 0))
            out[lo + full, 2 * DIM:3 * DIM] = np.add.reduceat(vectors[shape], starts) / n
            out[lo + full, -1] = np.log1p(sizes[full]) / 10
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.center) / self.scale) @ a + b) @ c + d

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(pooled(texts, self.vectors)) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, rate: float = 0.02, penalty: float = 1e-4) -> tuple[np.ndarray, ...]:
    """Two layers by full-batch Adam on the cross-entropy."""
    draw = np.random.Generator(np.random.PCG64(11))
    p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        miss = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y) / len(y)
        back = np.outer(miss, p[2]) * (1 - h * h)
        for k, g in enumerate((x.T @ back + penalty * p[0], back.sum(0), h.T @ miss + penalty * p[2], miss.sum())):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return tuple(p)


def temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least cross-entropy."""
    loss = [np.logaddexp(0, -np.where(y == 1, 1, -1) * margin / t).mean() for t in _GRID]
    return float(_GRID[int(np.argmin(loss))])


_GRID = np.geomspace(0.25, 8, 41)


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000, mod: int = 4, held_out: int = 2) -> Model:
    """Word vectors from all texts; the network from at most ``sample`` labelled documents
    outside the held-out fold, a fifth of them kept for the temperature. Without two
    classes the score is 1 if only label 1 occurs, else 0."""
    vectors = word_vectors(documents)
    rows = label_sample(documents, labels.filter("quality IN (0, 1)"), "quality", mod, held_out, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [r.tobytes() for r in pooled(b["text"].tolist(), vectors)]})

    got = rows.mapInPandas(run, "doc_id long, label int, x binary").toPandas().sort_values("doc_id")  # ``sample`` rows of 3 * DIM + 1 numbers
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]], float).reshape(-1, 3 * DIM + 1)
    y = got["label"].to_numpy(float)
    width = x.shape[1]
    if len(set(y)) < 2:
        flat = (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(50.0 if len(y) and y[0] else -50.0))
        return Model(vectors, np.zeros(width), np.ones(width), flat, 1.0)
    center, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - center) / scale
    check = np.arange(len(x)) % 5 == 4
    if len(set(y[~check])) < 2 or len(set(y[check])) < 2:
        check = np.zeros(len(x), bool)
    layers = train(x[~check], y[~check])
    model = Model(vectors, center, scale, layers, 1.0)
    seen = check if check.any() else ~check
    margin = np.tanh(x[seen] @ layers[0] + layers[1]) @ layers[2] + layers[3]
    return Model(model.vectors, center, scale, layers, temperature(margin, y[seen]))


def classify(documents: DataFrame, model: Model, threshold: float = 0.7, mod: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null, empty and blank texts pool to zero and get that vector's score. A null id
    counts as empty text for the fold. Repeated rows get equal scores.
    """
    run = text_column(lambda texts: {"score": model.scores(texts)}, [("score", pa.float64())], documents.sparkSession, "score double")
    out = documents.select("doc_id", (remainder(mod) == held_out).alias("held_out"), run("text").alias("_r"))
    return out.select("doc_id", "held_out", F.col("_r.score").alias("score"), (F.col("_r.score") >= threshold).cast("int").alias("predicted"))
