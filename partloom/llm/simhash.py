"""SimHash near duplicates with vantage-point trees.

Fingerprints of 64 bits link at ``most`` or fewer differing bits. The bits are cut into
blocks; of two linked fingerprints some block differs in at most ``most // blocks`` bits, so
a search of that radius in every block misses no link. A block's values are partitioned by a
vantage-point tree: each node splits its values by Hamming distance from a vantage value.
A fingerprint lives in one leaf (shard) of every block and visits those other leaves that
the triangle bound can't rule out; in a shard, residents meet residents and visitors, and whole
fingerprints are compared. The trees cover all possible values, so they don't depend on data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from partloom.session import written as cut

from .common import blocks as dealt, components, groups, roots, small_batches, spread_join, text_column

BITS = 64
WORDS = 4
SHARD = 4000  # rows of a shard that one task compares at once


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits: bit k is set if it is in over half of the XXH64 values (seed 42) of the
    ``words``-word shingles, A-Z lower-cased; fewer words are one shingle, no words give 0."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and the six ASCII blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(parts) - words + 1, 1)
    last = ends[words - 1:] if len(parts) >= words else ends[-1:]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at:min(at + (1 << 15), n)].tolist(), last[at:at + (1 << 15)].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(spark, words: int = WORDS):
    """text -> struct<fp>, the fingerprint as a signed long."""
    def run(texts: list[str]) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return text_column(run, [("fp", pa.int64())], spark, "fp long")


@dataclass(frozen=True)
class Tree:
    """``home[value]`` is a value's leaf; ``visits[first[value]:first[value + 1]]`` are the
    later leaves within the radius. Of two values a link's lower one visits the other's leaf."""
    home: np.ndarray
    first: np.ndarray
    visits: np.ndarray
    leaves: int


@lru_cache(maxsize=8)
def tree(width: int, radius: int, leaf: int = 16, seed: int = 5) -> Tree:
    """The vantage-point tree of all values of ``width`` bits, 20 at most."""
    if width > 20:
        raise ValueError("blocks of over 20 bits have too many values: use more blocks")
    draw = np.random.Generator(np.random.PCG64(seed))
    every = np.arange(1 << width, dtype=np.uint32)
    home = np.zeros(1 << width, np.int32)
    found: list[tuple[np.ndarray, int]] = []
    todo, leaves = [(every, every)], 0
    while todo:
        members, seekers = todo.pop()
        if len(members) <= leaf:
            home[members] = leaves
            if radius:
                near = np.zeros(len(seekers), bool)
                for m in members:
                    near |= np.bitwise_count(seekers ^ m) <= radius
                found.append((seekers[near], leaves))
            leaves += 1
            continue
        vantage = members[draw.integers(len(members))]
        far = np.bitwise_count(members ^ vantage).astype(np.int32)
        middle = int(np.median(far))
        middle -= middle == far.max()
        away = np.bitwise_count(seekers ^ vantage).astype(np.int32)
        # a seeker within the radius of a member is at most the radius nearer or farther than it
        todo.append((members[far <= middle], seekers[away <= middle + radius]))
        todo.append((members[far > middle], seekers[away > middle - radius]))
    value = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.uint32)
    shard = np.concatenate([np.full(len(s), k, np.int32) for s, k in found]) if found else np.zeros(0, np.int32)
    later = shard > home[value]
    value, shard = value[later], shard[later]
    order = np.argsort(value, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))])
    return Tree(home, first, shard[order], leaves)


def _compare(most: int):
    """Local groups of linked fingerprints: (a, b) with b the least of a's group in the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b, n = [], [], 0
        for g in groups(batches, ["shard", "b0", "b1"]):
            fp = g["fp"].view(np.uint64)
            same = g["b0"][0] == g["b1"][0]
            left = np.flatnonzero(g["resident"] == 1) if same else np.flatnonzero(g["side"] == 0)
            right = np.arange(len(fp)) if same else np.flatnonzero(g["side"] == 1)
            a, b = [], []
            for at in range(0, len(left), 256):
                own = left[at:at + 256]
                i, j = np.nonzero(np.bitwise_count(fp[own][:, None] ^ fp[right][None, :]) <= most)
                a.append(own[i])
                b.append(right[j])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            a, b = a[a != b], b[a != b]
            if len(a):
                members, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = roots(len(members), flat[:len(a)], flat[len(a):])
                out = root != np.arange(len(members))
                found_a.append(fp[members[out]].view(np.int64))
                found_b.append(fp[members[root[out]]].view(np.int64))
                n += len(found_a[-1])
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])
                found_a, found_b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

    return run


def linked(fingerprints: DataFrame, most: int = 4, blocks: int = 4, leaf: int = 16) -> DataFrame:
    """(a, b): pairs of distinct values of ``fp`` whose transitive closure is that of all
    links. Dense groups give one pair a member and shard, not all pairs."""
    width, radius = BITS // blocks, most // blocks
    plan = tree(width, radius, leaf)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for k in range(blocks):
                value = ((fp >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                n = plan.first[value + 1] - plan.first[value]
                places = np.repeat(plan.first[value] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shard = np.concatenate([plan.home[value], plan.visits[places]]) + k * plan.leaves
                yield pd.DataFrame({"shard": shard.astype(np.int32), "resident": np.repeat([1, 0], [len(fp), n.sum()]).astype(np.int8),
                                    "fp": np.concatenate([fp, np.repeat(fp, n)]).view(np.int64)})

    rows = fingerprints.select("fp").distinct().mapInPandas(shards, "shard int, resident byte, fp long")
    met = dealt(rows, ["shard"], F.xxhash64("fp"), SHARD)
    keys = ["shard", "b0", "b1"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(most), "a long, b long")


def grouped(rows: DataFrame, most: int = 4, blocks: int = 4) -> DataFrame:
    """(fp, component, component_id) for each distinct ``fp`` of (doc_id, fp): the least
    fingerprint and the least doc_id that are reachable by links. A component without any id
    has none; where ids are repeated, several components may have the same."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(linked(classes, most, blocks))
    return named_components(cut(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")))


def named_components(named: DataFrame) -> DataFrame:
    """(fp, component, component_id) of (fp, low, component); without component a fingerprint is alone."""
    alone, several = named.filter("component IS NULL"), named.filter("component IS NOT NULL")
    least = several.groupBy("component").agg(F.min("low").alias("component_id"))
    return alone.select("fp", F.col("fp").alias("component"), F.col("low").alias("component_id")).unionByName(
        spread_join(several, least, "component").select("fp", "component", "component_id"))


def near_duplicates(documents: DataFrame, words: int = WORDS, most: int = 4, blocks: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id for every row.

    Null, empty and blank texts have fingerprint zero, linked like any other. Repeated
    rows and null ids give one row each; a component_id is the least id that isn't null.
    Other columns are not read. No rows: no rows.
    """
    small_batches(documents.sparkSession)
    rows = cut(documents.select("doc_id", fingerprint_column(documents.sparkSession, words)("text")["fp"].alias("fp")))
    return rows.join(grouped(rows, most, blocks), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, words: int = WORDS, most: int = 4, blocks: int = 4) -> DataFrame:
    """The rows of ``documents`` that stay: of each component one, that with the least id.

    Rows that are equal in id and component leave one, the least of those with the least
    fingerprint. Columns of any name are kept as they are.
    """
    spark = documents.sparkSession
    small_batches(spark)
    mark = fingerprint_column(spark, words)
    rows = cut(documents.select("doc_id", mark("text")["fp"].alias("fp")))
    return kept(documents, rows, grouped(rows, most, blocks), mark)


def kept(documents: DataFrame, rows: DataFrame, found: DataFrame, mark) -> DataFrame:
    """The rows of ``documents`` that stay by the components ``found`` of ``rows`` (doc_id, fp)."""
    of = rows.join(found, "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = of.groupBy("component", "doc_id").agg(F.min("fp").alias("_first"))
    # an id that only one row has names the row; other rows are named by id and fingerprint
    times = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    named = cut(keep.join(times, F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.col("doc_id").alias("_keep"), "_first", "_n"))
    held = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    same = F.col("_id").eqNullSafe(F.col("_keep"))
    # what stays grows with the corpus: always a merge join, one shuffle of the texts
    stay = held.join(named.filter("_n = 1").hint("merge"), same).select("_row.*")
    several = named.filter("_n > 1")
    if several.isEmpty():
        return stay
    marked = cut(held.join(several.select("_keep").distinct(), same, "left_semi")).withColumn("_fp", mark("_row.text")["fp"])
    again = marked.join(several, same & (F.col("_fp") == F.col("_first"))).groupBy("_keep", "_first").agg(F.min("_row").alias("_row"))
    return stay.unionByName(again.select("_row.*"))
