"""Near copies: five-word shingle sets with a Jaccard similarity of ``LEAST`` or more.

A set's SimHash has 128 bits: at similarity 0.8 two of them differ in about 15 of 100 bits, so
some of ten 12-bit blocks differs in at most one bit for 99.7 % of such pairs, and for more of
closer ones. The blocks are searched by the vantage-point trees of ``simhash``. What meets there, differs in at
most ``MOST`` bits and is similar in size is a candidate. Sets of up to ``FEW`` shingles are found exactly: of
two similar ones some shingle is among the first fifth of both, in the order of their hashes.

Candidates are never listed as pairs. Bits go to the shards, once for all sets that have the same; a shard names
its members that have any candidate, their sets travel to it, and there all its candidates are
counted out at once, each pair in one shard only.
What leaves a shard are links, one a member, of sets that are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from partloom.session import written as cut

from . import simhash
from .common import blocks as dealt, components, groups, roots, small_batches, text_column

WORDS = 5
LEAST = (4, 5)  # the similarity as a fraction, so that it is compared in whole numbers
BLOCKS, WIDTH, LEAF = 10, 12, 2
MOST = 36  # of 128 bits
FEW = 32
SHARD = 16_000  # marks of a shard that one task compares at once
PIECE = 1000  # sets of a shard that one task counts out at once
PAIRS = 1 << 16  # that are compared at once, so that they stay in the processor's cache
BYTES = 6  # of a shingle's hash that travel
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]
_SALT = [np.uint64(x) for x in (0, 0xD1B54A32D192ED03)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 48-bit values of the five-word shingles, A-Z lower-cased; fewer words are one
    shingle, no words none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64)
    n, size = max(len(h) - WORDS + 1, 1), min(len(h), WORDS)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += _mixed(h[k:k + n]) * _P[k]
    return np.unique(_mixed(total) >> np.uint64(64 - 8 * BYTES))


def packed(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // BYTES, 8), np.uint8)
    wide[:, :BYTES] = np.frombuffer(b, np.uint8).reshape(-1, BYTES)
    return wide.reshape(-1).view("<u8")


def name_of(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 42)


def signature(h: np.ndarray) -> np.ndarray:
    """A set's 128 bits as two words."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(h), 1 << 13):
        part = h[at:at + (1 << 13)]
        words = np.stack([_mixed(_mixed(part + s)) for s in _SALT], axis=1)
        counts += np.unpackbits(words.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)


def first_fifth(h: np.ndarray) -> np.ndarray:
    """Shingles of which any similar set of at most a quarter more has one among its own."""
    return h[:len(h) - -(-len(h) * LEAST[0] // LEAST[1]) + 1] if 0 < len(h) <= FEW * LEAST[1] // LEAST[0] else h[:0]


_MARK = "fp long, f0 long, f1 long, n int, few binary"


def signature_column(spark):
    """text -> struct<fp, f0, f1, n, few>: name, bits and size of the text's shingle set, and its ``first_fifth``."""
    def run(texts: list[str]) -> dict[str, list]:
        sets = [shingles(t) for t in texts]
        bits = np.stack([signature(h) for h in sets]).view(np.int64) if sets else np.zeros((0, 2), np.int64)
        return {"fp": np.array([name_of(h) for h in sets], np.uint64).view(np.int64), "f0": bits[:, 0], "f1": bits[:, 1],
                "n": [len(h) for h in sets], "few": [packed(first_fifth(h)) for h in sets]}

    return text_column(run, [("fp", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("n", pa.int32()), ("few", pa.binary())], spark, _MARK)


def set_column(spark):
    """text -> struct<fp, h>: name and shingles of the text's set."""
    def run(texts: list[str]) -> dict[str, list]:
        sets = [shingles(t) for t in texts]
        return {"fp": np.array([name_of(h) for h in sets], np.uint64).view(np.int64), "h": [packed(h) for h in sets]}

    return text_column(run, [("fp", pa.int64()), ("h", pa.binary())], spark, "fp long, h binary")


_ROW = "shard long, resident byte, f0 long, f1 long"
_DEALT = ["shard", "c0", "c1"]
_MEMBER = "shard long, c0 int, c1 int, cside int, resident byte, f0 long, f1 long"
_TASK = [*_DEALT, "b0", "b1"]


def _shards(marks: DataFrame) -> DataFrame:
    """Each of ``marks`` (f0, f1, large, several, few; distinct f0, f1) once in its own leaf of every block and once in every
    later leaf within reach, if it stands for a large set; for small sets in the shards of their first shingles, whose numbers
    are negative. ``resident`` is 0 for a visitor, 2 for what stands for several sets."""
    plan = simhash.tree(WIDTH, 1, LEAF)

    def rows(own: dict, shard, of, resident) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard, "resident": resident.astype(np.int8), **{c: x[of] for c, x in own.items()}})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = {c: b[c].to_numpy() for c in ("f0", "f1")}
            weight = 1 + b["several"].to_numpy().astype(np.int8)
            large = np.flatnonzero(b["large"].to_numpy())
            for k in range(BLOCKS):
                value = _block(own["f0"][large].view(np.uint64), own["f1"][large].view(np.uint64), k).astype(np.int64)
                n = plan.first[value + 1] - plan.first[value]
                places = np.repeat(plan.first[value] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield rows(own, np.concatenate([plan.home[value], plan.visits[places]]).astype(np.int64) + k * plan.leaves,
                           np.concatenate([large, np.repeat(large, n)]), np.concatenate([weight[large], np.zeros(n.sum(), np.int8)]))
            few = [np.unique(np.concatenate([unpacked(x) for x in sets])) if len(sets) else np.zeros(0, np.uint64) for sets in b["few"]]
            if any(map(len, few)):
                of = np.repeat(np.arange(len(few)), [len(x) for x in few])
                yield rows(own, np.concatenate(few).view(np.int64) | np.int64(-1 << 63), of, weight[of])

    placed = dealt(marks.mapInPandas(run, _ROW), ["shard"], F.xxhash64("f0", "f1"), SHARD)
    placed = placed.withColumnsRenamed({"b0": "c0", "b1": "c1", "side": "cside"})
    return placed.repartition(*_DEALT).sortWithinPartitions(*_DEALT)


def _block(f0: np.ndarray, f1: np.ndarray, k: int) -> np.ndarray:
    word, at = (f0, k) if k < BLOCKS // 2 else (f1, k - BLOCKS // 2)
    return (word >> np.uint64(at * WIDTH)) & np.uint64((1 << WIDTH) - 1)


def _pieces(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``left`` in pieces that make some ``PAIRS`` pairs with ``right``."""
    step = max(PAIRS // max(len(right), 1), 1)
    for at in range(0, len(left), step):
        yield left[at:at + step], right


def _candidates(g: dict, leaves: int, sides: str, b0: str, b1: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a group whose marks may belong to similar sets and meet here for the first time."""
    f0, f1, resident = g["f0"].view(np.uint64), g["f1"].view(np.uint64), g["resident"] > 0
    shard = int(g["shard"][0])
    apart = g["cside"] if g["c0"][0] != g["c1"][0] else None
    same = g[b0][0] == g[b1][0]
    left = np.arange(len(f0)) if same else np.flatnonzero(g[sides] == 0)
    right = left if same else np.flatnonzero(g[sides] == 1)
    spans = [(left, right)]
    if shard >= 0:  # nothing is asked of two visitors, and most marks are: residents meet all, once
        spans = [(left[resident[left]], right)] + ([] if same else [(left[~resident[left]], right[resident[right]])])
    for own, others in (piece for span in spans for piece in _pieces(*span)):
        if shard < 0:
            i, j = (x.ravel() for x in np.broadcast_arrays(own[:, None], others[None, :]))
            once = i < j
        else:
            # half of the bits say little: nearly all pairs of marks are within MOST there
            far = np.bitwise_count(f0[own][:, None] ^ f0[others][None, :])
            far += np.bitwise_count(f1[own][:, None] ^ f1[others][None, :])
            i, j = np.nonzero(far <= MOST)
            i, j = own[i], others[j]
            once = (i < j) | ~resident[j]
        if same:
            i, j = i[once], j[once]
        if apart is not None:
            i, j = i[apart[i] != apart[j]], j[apart[i] != apart[j]]
        if shard >= 0:
            # in this block they are in reach, in none before it
            for k in range(shard // leaves + 1):
                near = np.bitwise_count(_block(f0[i], f1[i], k) ^ _block(f0[j], f1[j], k)) <= 1
                i, j = (i[near], j[near]) if k == shard // leaves else (i[~near], j[~near])
        yield i, j


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of a group that have any candidate there, or stand for several sets and have met nowhere else."""
    leaves = simhash.tree(WIDTH, 1, LEAF).leaves
    columns = [*_DEALT, "cside", "resident", "f0", "f1"]
    for g in groups(batches, _DEALT):
        shard = int(g["shard"][0])
        met = (g["resident"] == 2) & (shard < leaves) & (g["c0"][0] == g["c1"][0])
        if len(met) > 1:
            for i, j in _candidates(g, leaves, "cside", "c0", "c1"):
                met[i] = met[j] = True
        of = np.flatnonzero(met)
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(g[c][of]) for c in columns], columns)


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the sets of each pair share: one sort of all values, then bits of those that several have."""
    out = np.zeros(len(i), np.int64)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    several = np.bincount(column, minlength=1) > 1
    keep = several[column]
    column, owner = (np.cumsum(several) - 1)[column[keep]], owner[keep]
    total = int(column[-1]) + 1 if len(column) else 0
    wide = 1 << 13
    for at in range(0, total, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        bits = np.zeros((len(sets), min(wide, total - at)), bool)
        bits[owner[lo:hi], column[lo:hi] - at] = True
        words = np.packbits(bits, axis=1)
        words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).view(np.uint64)
        step = max((1 << 21) // words.shape[1], 1)
        for p in range(0, len(i), step):
            out[p:p + step] += np.bitwise_count(words[i[p:p + step]] & words[j[p:p + step]]).sum(1, dtype=np.int64)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) whose closure is that of all pairs of a group that are similar enough."""
    leaves = simhash.tree(WIDTH, 1, LEAF).leaves
    for g in groups(batches, _TASK):
        n = g["n"].astype(np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        for i, j in _candidates(g, leaves, "side", "b0", "b1"):
            fit = (np.minimum(n[i], n[j]) * LEAST[1] >= np.maximum(n[i], n[j]) * LEAST[0]) & (g["fp"][i] != g["fp"][j])
            pairs.append(np.stack([i[fit], j[fit]]))
        i, j = np.concatenate(pairs, axis=1)
        if not len(i):
            continue
        both = shared([unpacked(h) for h in g["h"]], i, j)
        near = both * LEAST[1] >= (n[i] + n[j] - both) * LEAST[0]
        root = roots(len(n), i[near], j[near])
        out = np.flatnonzero(root != np.arange(len(n)))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(g["fp"][out]), pa.array(g["fp"][root[out]])], ["a", "b"])


def marks(classes: DataFrame) -> DataFrame:
    """(f0, f1, large, several, few): the distinct bits of sets that have any shingles."""
    few = F.col("few")
    return classes.filter("n > 0").groupBy("f0", "f1").agg(F.max(F.col("n") > FEW).alias("large"), (F.count("*") > 1).alias("several"),
                                                           F.collect_set(F.when(F.octet_length(few) > 0, few)).alias("few"))


def links(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links of the distinct sets ``classes`` (fp, low, f0, f1, n, few), found in shards."""
    found = cut(_shards(cut(marks(classes))).mapInArrow(_members, _MEMBER))
    # a mark's sets; dealt again, as sets are large
    members = cut(found.join(classes.select("fp", "n", "f0", "f1"), ["f0", "f1"]))
    names = cut(members.select("fp").distinct())
    ids = classes.join(names, "fp", "left_semi").select(F.col("low").alias("_low")).distinct()
    texts = documents.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_low")), "left_semi").select("text")
    made = set_column(documents.sparkSession)
    # the texts are joined before Python reads any
    sets = cut(cut(texts).select(made("text").alias("_m")).select("_m.*").join(names, "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h")))
    met = dealt(members, _DEALT, F.xxhash64("fp"), PIECE)
    return met.join(sets, "fp").repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(_links, "a long, b long")


def grouped(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(fp, component, component_id) for each distinct set of ``rows`` (doc_id, fp, f0, f1, n, few), as in
    ``simhash.grouped``."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), *[F.min(c).alias(c) for c in ("f0", "f1", "n", "few")]))
    found = components(links(documents, classes))
    return simhash.named_components(cut(classes.select("fp", "low").join(found.withColumnRenamed("node", "fp"), "fp", "left")))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: of each group of near copies one, that with the least id,
    as in ``simhash.deduplicated``. Texts without words are copies of each other."""
    small_batches(documents.sparkSession)
    mark = signature_column(documents.sparkSession)
    rows = cut(documents.select("doc_id", mark("text").alias("_m")).select("doc_id", "_m.*"))
    return simhash.kept(documents, rows.select("doc_id", "fp"), grouped(documents, rows), mark)
