"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. Three letters in a row are bound: the
first's vector turned by two places, the second's by one and the third's are multiplied.
A text's profile is the bundle (sum) of its bound vectors, a language's prototype the
bundle of its texts; they are compared by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, remainder, small_batches, text_column

DIM = 1024
PIECE = 2048  # bound vectors made at once
_LETTERS: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    """The random vector of a code point, the same in every process."""
    if code not in _LETTERS:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        draw = np.random.Generator(np.random.Philox(key=[2024, code]))
        _LETTERS[code] = (draw.integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _LETTERS[code]


def _table() -> np.ndarray:
    out = np.full(1 << 16, 32, np.int64)
    for i in range(1 << 16):
        if chr(i).isalpha():
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD = _table()


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Packed trigrams around a letter and their counts; whether there is a letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _FOLD[np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        high = raw > 0xFFFF
        c = np.where(high, [ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in raw] if high.any() else 0, c)
    any_letter = bool((c != 32).any())
    c = np.concatenate([[32], c, [32]])
    packed = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 32]
    g, n = np.unique(packed, return_counts=True)
    return g, n, any_letter


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the bound vectors of packed trigrams, times their counts."""
    total = np.zeros(DIM, np.float64)
    for at in range(0, len(grams), PIECE):
        g, n = grams[at:at + PIECE], counts[at:at + PIECE]
        parts = [g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF]
        alphabet, where = np.unique(np.concatenate(parts), return_inverse=True)
        base = np.array([letter(int(x)) for x in alphabet])
        a, b, c = where.reshape(3, -1)
        bound = np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]
        total += n.astype(np.float32) @ bound.astype(np.float32)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # unit rows

    def predict(self, texts: list[str]) -> dict[str, list]:
        names, scores = [], []
        for t in texts:
            g, n, any_letter = trigrams(t)
            if not any_letter or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            v = bundle(g, n)
            cosine = self.prototypes @ v / (np.linalg.norm(v) or 1.0)
            best = int(np.argmax(cosine))
            names.append(self.languages[best])
            scores.append(float(min(max(cosine[best], 0.0), 1.0)))
        return {"lang_pred": names, "score": scores}


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The task's bundle of each language's texts."""
    totals: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, own in b.groupby("lang", sort=True):
            texts = [t or "" for t in own["text"]]
            for lo, hi in by_bytes(texts):
                g, n, any_letter = trigrams("\n\n".join(texts[lo:hi]))
                if any_letter:
                    totals[lang] = totals.get(lang, 0) + bundle(g, n)
    # whole numbers, in any order the same sum
    yield pd.DataFrame([(k, *map(int, v)) for k, v in totals.items()], columns=["lang", *[f"v{i}" for i in range(DIM)]])


def fit(documents: DataFrame, mod: int = 4, held_out: int = 2) -> Model:
    """Prototypes from the texts of all rows with a language outside the held-out fold.
    What reaches the driver is one vector per language."""
    small_batches(documents.sparkSession)
    cols = [f"v{i}" for i in range(DIM)]
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(mod) != held_out)).select("lang", "text")
    part = rows.mapInPandas(_bundles, "lang string, " + ", ".join(f"{c} long" for c in cols))
    long = part.select("lang", F.posexplode(F.array(*cols)).alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    got = long.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).orderBy("lang").collect()
    rows_ = np.array([[x["v"] for x in r["v"]] for r in got], float).reshape(-1, DIM)
    return Model(tuple(r["lang"] for r in got), rows_ / np.maximum(np.linalg.norm(rows_, axis=1, keepdims=True), 1e-9))


def identify(documents: DataFrame, model: Model, mod: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) for every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is every row if
    no language was learnt. Equal cosines go to the language that comes first. A null id
    counts as empty text for the fold.
    """
    run = text_column(model.predict, [("lang_pred", pa.string()), ("score", pa.float64())], documents.sparkSession, "lang_pred string, score double")
    out = documents.select("doc_id", (remainder(mod) == held_out).alias("held_out"), run("text").alias("_r"))
    return out.select("doc_id", "held_out", F.col("_r.lang_pred").alias("lang_pred"), F.col("_r.score").alias("score"))
