"""Embedding near duplicates with spherical-cap filters.

A filter is a direction on the sphere; a vector passes it when their inner product is at
least a threshold. Directions are a random product code: the (rotated) space is cut into two parts,
each with its own random codewords, and every pair of codewords is a direction. A vector is
list-decoded to all directions it exceeds: only codewords of the first part that can reach the
threshold with the best one of the second are looked at further. Vectors with equal labels
that share a filter are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.session import written as cut

from .common import blocks as dealt, components, groups, roots, small_batches, spread_join

CODE = 64  # codewords of a part: CODE^2 filters
CAP = 2.55  # threshold in standard deviations of a random direction's inner product
CHUNK = 1500  # vectors of a filter that one task compares at once


@lru_cache(maxsize=8)
def code(dim: int, words: int = CODE, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the codewords of both parts, for vectors of ``dim`` numbers."""
    draw = np.random.Generator(np.random.PCG64([seed, dim]))
    turn = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
    parts = []
    for width in ((dim + 1) // 2, dim // 2):
        c = draw.normal(size=(words, width))
        parts.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) / np.sqrt(2))
    return turn, parts[0], parts[1]


def decode(unit: np.ndarray, cap: float = CAP) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of all filters that the unit vectors exceed, and of each vector's best
    filter, so that none is without; sorted by vector and filter."""
    dim = unit.shape[1]
    turn, one, two = code(dim)
    x = unit @ turn
    a, b = x[:, :one.shape[1]] @ one.T, x[:, one.shape[1]:] @ two.T
    least = np.minimum(cap / np.sqrt(dim), a.max(1) + b.max(1))
    row, i = np.nonzero(a + b.max(1)[:, None] >= least[:, None])
    k, j = np.nonzero(a[row, i][:, None] + b[row] >= least[row][:, None])
    return row[k], i[k] * CODE + j


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each vector and filter, with the vector as it is stored and the list of its filters."""
    for b in batches:
        dims = b["vector"].map(len).to_numpy()
        for dim in np.unique(dims):
            own = b[dims == dim]
            x = np.stack(own["vector"].to_numpy())
            row, filter_ = decode(units(x))
            lists = [f.astype("<u2").tobytes() for f in np.split(filter_, np.cumsum(np.bincount(row, minlength=len(x)))[:-1])]
            data = [v.tobytes() for v in x]
            take = own.iloc[row]
            yield pd.DataFrame({"label": take["label"].to_numpy(), "dim": np.int32(dim), "filter": filter_.astype(np.int32), "key": take["key"].to_numpy(),
                                "n": take["n"].to_numpy(), "vector": [data[r] for r in row], "filters": [lists[r] for r in row]})


def _first_shared(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the least filter that the two vectors of a pair share."""
    early = [f[f < here] for f in lists]
    width = max((len(f) for f in early), default=0)
    if not width:
        return np.ones(len(a), bool)
    grid = np.full((len(lists), width), -1, np.int32)
    for k, f in enumerate(early):
        grid[k, :len(f)] = f
    first = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = grid[a[at:at + (1 << 14)]], grid[b[at:at + (1 << 14)]]
        first[at:at + (1 << 14)] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any((1, 2))
    return first


def _compare(least: float, stored: str):
    """Per vector with a link: how many rows it links to (each pair counted in one filter
    only), and the first member of its group in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["label", "dim", "filter", "b0", "b1"]):
            size = len(g["key"])
            if size < 2:
                continue
            unit = units(np.frombuffer(b"".join(g["vector"]), stored).reshape(size, -1))
            same = g["b0"][0] == g["b1"][0]
            left = np.arange(size) if same else np.flatnonzero(g["side"] == 0)
            right = left if same else np.flatnonzero(g["side"] == 1)
            i, j = np.nonzero(unit[left] @ unit[right].T >= least)
            i, j = left[i], right[j]
            i, j = (i[i < j], j[i < j]) if same else (i, j)
            if not len(i):
                continue
            root = roots(size, i, j)
            lists = [np.frombuffer(f, "<u2").astype(np.int32) for f in g["filters"]]
            new = _first_shared(lists, i, j, int(g["filter"][0]))
            i, j, n = i[new], j[new], g["n"]
            links = np.bincount(i, n[j], minlength=size) + np.bincount(j, n[i], minlength=size)
            out = np.flatnonzero((root != np.arange(size)) | (links > 0))
            yield pa.RecordBatch.from_arrays([pa.array(g["key"][out], pa.string()), pa.array(g["key"][root[out]], pa.string()),
                                              pa.array(links[out].astype(np.int64))], ["key", "root", "links"])

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows with equal label and equal vector are one class: they link to each other, are compared
    once and count as many. Null labels, vectors that are null, empty or zero, and vectors that hold a
    null or a number that isn't finite link with nothing; neither do vectors of different
    lengths. A component_id is the least id that isn't null, a row's own where nothing links; repeated ids
    are separate rows. Other columns are not read. No rows: no rows.
    """
    small_batches(embeddings.sparkSession)
    v = F.col("embedding")
    stored = {"float": "f4", "double": "f8"}[embeddings.schema["embedding"].dataType.elementType.simpleString()]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    # 128 bits of label and vector name a class
    key = F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "embedding", "label")))
    rows = cut(embeddings.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), key).alias("key"), "label", v.alias("vector")))
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("label", F.col("label").cast("long")))
    entries = classes.select("key", "n", "label", "vector").mapInPandas(
        _entries, "label long, dim int, filter int, key string, n long, vector binary, filters binary")
    keys = ["label", "dim", "filter"]
    met = dealt(entries, keys, F.xxhash64("key"), CHUNK)
    keys += ["b0", "b1"]
    found = cut(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(least, stored), "key string, root string, links long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = cut(classes.select("key", "low", "n").join(links, "key", "left").join(comps.withColumnRenamed("node", "key"), "key", "left"))
    several = named.filter("component IS NOT NULL")
    lowest = several.groupBy("component").agg(F.min("low").alias("component_id"))
    done = named.filter("component IS NULL").withColumn("component_id", F.col("low")).unionByName(
        spread_join(several, lowest, "component"), allowMissingColumns=True)
    done = done.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(done, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
