"""What the operators share: tables, batches of texts, label samples, linked groups, hot groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partloom.session import written as cut

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_BATCH = 256  # rows handed to Python at once, so that long texts stay within a worker's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``ROWS_A_BATCH``; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ROWS_A_BATCH:
        spark.conf.set(key, str(ROWS_A_BATCH))


def remainder(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod


def text_column(batches: Callable[[list[str]], dict[str, list]], fields: list[tuple[str, pa.DataType]], spark: SparkSession,
                schema: str):
    """A column function text -> struct. ``batches`` gets the whole texts of one Arrow
    batch (null as empty) and returns one list per field."""
    small_batches(spark)
    kind = pa.struct(fields)

    def run(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in chunks:
            out = batches([t or "" for t in chunk.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(out[n], t) for n, t in fields], fields=list(kind))

    run.__annotations__ = {"chunks": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, schema)


def by_bytes(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` characters; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def label_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out
    fold, the first by a hash of the id; written, as several passes read it.

    Rows without id or label teach nothing. Of repeated ids the largest label and the
    least text count, so that a rerun agrees.
    """
    named = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("_id").isNotNull() & F.col("label").isNotNull() & (remainder(mod, "_id") != held_out))
    some = named.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    # at most ``most`` pairs of numbers: a proven bound for the broadcast
    joined = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    return cut(joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))


def spread_join(rows: DataFrame, single: DataFrame, key: str, pieces: int = 16) -> DataFrame:
    """``rows`` joined with a table that has one row per ``key``. A hot key's rows are dealt to
    ``pieces`` tasks by a hash of the whole row, and the table's row goes to each of them."""
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(*rows.columns), F.lit(pieces)).cast("int"))
    return dealt.join(single.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))), [key, "_piece"]).drop("_piece")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected ``edges``: the least node that is
    reachable. Large-star and small-star rounds; each round is written, so a lost executor
    costs one round, and no neighbourhood is ever gathered: a node's edges meet only in a
    minimum, which is combined before the shuffle and dealt back to pieces of them."""
    links = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    while True:
        # large star: every larger neighbour of a node points at the least of its neighbourhood
        both = links.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(links.select(F.col("u").alias("n"), F.col("v").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = cut(spread_join(both.filter("m > n"), least, "n").select(F.col("m").alias("v"), F.col("low").alias("u")).distinct())
        # small star: a node and its smaller neighbours point at the least of them
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v")
        after = cut(small.filter("u != low").select(F.col("u").alias("v"), F.col("low").alias("u"))
                    .unionByName(low.select("v", F.col("low").alias("u"))).filter("v != u").distinct())
        # settled when every node has one edge and no centre is a leaf
        state = after.groupBy("v").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (state or 0) <= 1 and after.join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        links = after
    return after.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        after.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def blocks(rows: DataFrame, keys: list[str], spread: Column, most: int) -> DataFrame:
    """Deal each group of ``rows`` out to tasks of bounded size that together see all its pairs.

    A group of n rows is cut by ``spread`` (a hash) into s = ceil(n / most) pieces; a row of piece i
    goes to the tasks (i, j) and (j, i) with every j, as member of side 0 or 1. In a
    task (i, j), i < j, side 0 meets side 1; in (i, i) all rows meet. Adds ``b0``,
    ``b1`` and ``side``.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_n") / most).cast("int").alias("_s"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_k_{k}")
        cond = c if cond is None else cond & c
    wide = rows.join(sizes, cond, "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    wide = wide.withColumn("_i", F.pmod(spread, F.col("_s")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return (wide.withColumn("b0", F.least("_i", "_j")).withColumn("b1", F.greatest("_i", "_j"))
            .withColumn("side", (F.col("_i") > F.col("_j")).cast("int")).select(*rows.columns, "b0", "b1", "side"))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups, as columns, out of a partition that is sorted by ``keys``. A group may lie
    in several batches; only the last one is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != piece.column(k)[0] for k in keys):
                yield _columns(held)
                held = []
            held.append(piece)
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    whole = pa.Table.from_batches(parts)
    return {n: whole.column(n).to_numpy() for n in whole.column_names}


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` members' group, linked by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root
