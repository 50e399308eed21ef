"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. Graph and search compare unit vectors: each vector divided by the largest
norm gets one more component that makes its length 1, so the largest inner product with a query is the
nearest unit vector. For both, vectors travel with 8 bits a component; reported scores are exact.

The graph starts with neighbours in the order of random sign bits. Each round a node gathers its
neighbours and some of the nodes it is a neighbour of, and compares them with each other: neighbours of neighbours
that are nearer than a node's farthest one replace it. A pair is compared only if one of the two is new there.
The search keeps a beam of the nearest nodes found, and opens the nearest unopened ones until all of its best are open.
All of it is joins of (node, node) rows; no node's lists or beams grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.session import written as cut

from .common import spread_join

K = 56  # neighbours of a node
REVERSE = 40  # of the nodes that it is a neighbour of, so many are drawn each round
TABLES, BLOCK, FIRST = 16, 512, 10  # orders of random bits, nodes compared in one, neighbours taken of each
SETTLED = 0.02  # a round that changes a smaller share of the neighbours is the last
BEAM, KEPT, OPEN = 64, 256, 32  # nodes that must be opened, nodes kept, nodes opened at once


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=64)
def _planes(dim: int, table: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([11, dim, table])).normal(size=(dim, 62)).astype(np.float32)


def _rows(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Lists or binaries of one length as a matrix."""
    if kind == "code":
        return np.stack([np.frombuffer(x, np.int8) for x in column.to_pylist()])
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _units(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes: 4 bytes scale, 4 bytes last component, a byte for each other one."""
    head = np.ascontiguousarray(codes[:, :8]).view(np.float32)
    return np.concatenate([codes[:, 8:].astype(np.float32) * head[:, :1], head[:, 1:]], axis=1)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = b.filter(pa.array(dims == dim))
            x = _rows(own.column("vector"), "vector")
            top = np.abs(x).max(1, keepdims=True)
            norm = top * np.linalg.norm(x / top, axis=1, keepdims=True)
            largest = own.column("largest").to_numpy()[:, None]
            x = x / largest
            scale = np.abs(x).max(1, keepdims=True) / 127
            last = np.sqrt(np.maximum(1 - (norm / largest) ** 2, 0))
            step = np.where(scale > 0, scale, 1)
            whole = np.concatenate([np.concatenate([scale, last], axis=1).astype(np.float32).view(np.int8), np.rint(x / step).astype(np.int8)], axis=1)
            yield pa.RecordBatch.from_arrays([own.column("node"), own.column("dim"), pa.array([r.tobytes() for r in whole], pa.binary())], ["node", "dim", "code"])


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, most: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The ``most`` nearest distinct b of each a, and whether they are new: not ``fresh`` where a pair is both."""
    fresh = np.ones(len(a), bool) if fresh is None else fresh
    order = np.lexsort((fresh, b, a))
    a, b, s, fresh = a[order], b[order], s[order], fresh[order]
    one = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    a, b, s, fresh = a[one], b[one], s[one], fresh[one]
    order = np.lexsort((b, -s, a))
    a, b, s, fresh = a[order], b[order], s[order], fresh[order]
    begin = np.searchsorted(a, a)
    top = np.arange(len(a)) - begin < most
    return a[top], b[top], s[top], fresh[top]


def _pairs(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], ["a", "b", "s"])


def _start(first: int):
    """The nearest nodes among ``BLOCK`` to 2 ``BLOCK`` that follow each other in an order."""
    def block(nodes, codes):
        x = _units(np.stack([np.frombuffer(c, np.int8) for c in codes]))
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        n = min(first, len(x) - 1)
        take = np.argpartition(-near, n - 1, axis=1)[:, :n] if n else np.zeros((len(x), 0), int)
        nodes = np.array(nodes)
        return _pairs(np.repeat(nodes, n), nodes[take].ravel(), np.take_along_axis(near, take, 1).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, codes = None, [], []
        for batch in batches:
            for t, dim, node, code in zip(*(batch.column(c).to_pylist() for c in ("table", "dim", "node", "code"))):
                if (t, dim) != key or len(nodes) >= 2 * BLOCK:
                    stop = len(nodes) if (t, dim) != key else BLOCK
                    if nodes:
                        yield block(nodes[:stop], codes[:stop])
                    key, nodes, codes = (t, dim), nodes[stop:], codes[stop:]
                nodes.append(node)
                codes.append(code)
        if nodes:
            yield block(nodes, codes)

    return run


def _keep(most: int):
    """(a, b, s, new): the nearest of the rows (a, b, s, new) of a partition sorted by a."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(table: pa.Table) -> pa.RecordBatch:
            a, b, s, new = _best(*(table.column(c).to_numpy() for c in ("a", "b", "s")), most, table.column("new").to_numpy())
            return pa.RecordBatch.from_arrays([*_pairs(a, b, s).columns, pa.array(new, pa.bool_())], ["a", "b", "s", "new"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) > 200_000:
                whole = pa.Table.from_batches(held)
                a = whole.column("a").to_numpy()
                last = int(np.searchsorted(a, a[-1]))  # sorted: the last node may go on
                if last:
                    yield close(whole.slice(0, last))
                held = whole.slice(last).combine_chunks().to_batches()
        if held:
            yield close(pa.Table.from_batches(held))

    return run


def _join_locally(most: int):
    """Nearer neighbours among the members (m, new, least, code) that each node v has gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def group(m, new, least, codes):
            m, at = np.unique(m, return_index=True)
            new, least = new[at], least[at]
            if len(m) < 2 or not new.any():
                return
            x = _units(np.stack([np.frombuffer(codes[k], np.int8) for k in at]))
            fresh = np.flatnonzero(new)
            s = x[fresh] @ x.T
            i, j = np.nonzero((s > least[fresh][:, None]) | (s > least[None, :]))
            s, i = s[i, j], fresh[i]
            a, b, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
            better = (a != b) & (s > least[a])
            out.append((m[a[better]], m[b[better]], s[better]))

        def best():
            a, b, s, _ = _best(*(np.concatenate(c) for c in zip(*out)), most)
            out[:] = [(a, b, s)]
            return len(a)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) > 20_000:
                whole = pa.Table.from_batches(held)
                v = whole.column("v").to_numpy()
                last = int(np.searchsorted(v, v[-1]))
                _each(whole.slice(0, last), group)
                held = whole.slice(last).combine_chunks().to_batches()
                if sum(len(o[0]) for o in out) > 2_000_000 and best() > 1_000_000:
                    yield _pairs(*out.pop())
        if held:
            _each(pa.Table.from_batches(held), group)
        if out:
            best()
            yield _pairs(*out.pop())

    return run


def _each(table: pa.Table, group) -> None:
    if not table.num_rows:
        return
    v, m, new, least = (table.column(c).to_numpy() for c in ("v", "m", "new", "least"))
    codes = table.column("code").to_pylist()
    cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
    for a, b in zip(cuts, cuts[1:]):
        group(m[a:b], new[a:b], least[a:b], codes[a:b])


def _drawn(graph: DataFrame, times: int, seed: int) -> DataFrame:
    """(v, m, new): of the nodes m that have v as a neighbour ``times`` at most, one for each
    of as many draws; a minimum, so that it is combined before the shuffle."""
    slot = F.pmod(F.xxhash64("b", "a", F.lit(seed)), F.lit(times))
    return graph.groupBy(F.col("b").alias("v"), slot.alias("_slot")).agg(
        F.min(F.struct(F.xxhash64("a", F.lit(seed)).alias("_h"), F.col("a").alias("m"), "new"))["m"].alias("m"),
        F.min(F.struct(F.xxhash64("a", F.lit(seed)).alias("_h"), F.col("a").alias("m"), "new"))["new"].alias("new")).drop("_slot")


def graph(codes: DataFrame, k: int = K, reverse: int = REVERSE, tables: int = TABLES, rounds: int = 8) -> DataFrame:
    """(a, b, s, new): the ``k`` nearest nodes b found for each node a of ``codes`` (node, dim, code), with their cosine.

    ``codes`` is read in every round: it should be written. At most ``rounds`` rounds are made, fewer where one
    changes less than ``SETTLED`` of the neighbours.
    """
    spark = codes.sparkSession

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = _units(_rows(own.column("code"), "code"))
                for t in range(tables):
                    signs = (x @ _planes(x.shape[1], t) > 0) @ (1 << np.arange(62))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), own.column("dim"), pa.array(signs), own.column("node"), own.column("code")],
                                                     ["table", "dim", "bits", "node", "code"])

    n = codes.count()
    pieces = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // (16 * BLOCK)))
    order = ["table", "dim", "bits", "node"]
    placed = codes.mapInArrow(bits, "table int, dim int, bits long, node long, code binary").repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    found = placed.select("table", "dim", "node", "code").mapInArrow(_start(FIRST), "a long, b long, s float").withColumn("new", F.lit(True))
    shape = "a long, b long, s float, new boolean"

    def nearest(rows: DataFrame) -> DataFrame:
        return cut(rows.repartition("a").sortWithinPartitions("a").mapInArrow(_keep(k), shape))

    known = nearest(found)
    for turn in range(rounds):
        farthest = known.groupBy("a").agg(F.when(F.count("*") == k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
        shipped = codes.select("node", "code").join(farthest, F.col("node") == F.col("a")).select(F.col("node").alias("m"), "least", "code")
        members = known.select(F.col("a").alias("v"), F.col("b").alias("m"), "new").unionByName(_drawn(known, reverse, turn))
        gathered = members.join(shipped, "m").select("v", "m", "new", "least", "code").repartition("v").sortWithinPartitions("v")
        nearer = gathered.mapInArrow(_join_locally(k), "a long, b long, s float").withColumn("new", F.lit(True))
        known = nearest(known.withColumn("new", F.lit(False)).unionByName(nearer))
        total, new = known.agg(F.count("*"), F.count_if("new")).first()
        if new <= SETTLED * total:
            break
    return known


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One step of each query: score what was found, keep the nearest, name what to open next."""
    for batch in batches:
        rows = []
        for q, code, beam, score, opened, front, found, codes in zip(*(batch.column(c).to_pylist() for c in (
                "q", "code", "beam", "score", "opened", "front", "found", "codes"))):
            ids, s = np.array(beam, np.int64), np.array(score, np.float32)
            was = np.array(opened, bool) | np.isin(ids, front)
            if found:
                mine = _units(np.frombuffer(code, np.int8)[None])[0]
                mine[-1] = 0  # of a query only the direction counts
                near = _units(np.stack([np.frombuffer(c, np.int8) for c in codes])) @ mine
                ids, s, was = np.concatenate([ids, found]), np.concatenate([s, near]), np.concatenate([was, np.zeros(len(near), bool)])
            order = np.lexsort((ids, -s))[:KEPT]
            ids, s, was = ids[order], s[order], was[order]
            closed = np.flatnonzero(~was[:BEAM])[:OPEN]
            rows.append((q, code, ids.tolist(), s.tolist(), was.tolist(), ids[closed].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())))],
                ["q", "code", "beam", "score", "opened", "front"])


def search(codes: DataFrame, neighbours: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, c): for each of the ``queries`` (q, a node) the ``BEAM`` nearest nodes that a greedy search of ``neighbours`` (a, b) finds.

    The search starts at the query's own node. Each round opens up to ``OPEN`` of a query's nearest unopened nodes.
    """
    spark = codes.sparkSession
    # rows of this step are wide: a query's found codes
    width = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = cut(neighbours.select("a", "b").unionByName(_drawn(neighbours, REVERSE, 0).select(F.col("v").alias("a"), F.col("m").alias("b")))
                .groupBy("a").agg(F.collect_set("b").alias("near")))
    shape = "q long, code binary, beam array<long>, score array<float>, opened array<boolean>, front array<long>"
    own = queries.join(codes.select(F.col("node").alias("q"), "code"), "q")
    state = cut(own.select("q", "code", F.array("q").alias("beam"), F.array(F.lit(2.0).cast("float")).alias("score"), F.array(F.lit(False)).alias("opened"), F.array("q").alias("front")))
    done = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        while not state.isEmpty():
            opened = state.select("q", F.explode("front").alias("a")).join(lists, "a").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
            new = opened.join(state.select("q", "beam"), "q").select("q", F.explode(F.array_except("near", "beam")).alias("node"))
            scored = new.join(codes.select("node", "code"), "node").groupBy("q").agg(F.collect_list(F.struct("node", "code")).alias("_f"))
            wide = state.join(scored, "q", "left").select("*", F.col("_f.node").alias("found"), F.col("_f.code").alias("codes")).drop("_f")
            after = cut(wide.mapInArrow(_advance, shape))
            done.append(after.filter(F.size("front") == 0).select("q", F.explode(F.slice("beam", 1, BEAM)).alias("c")))
            state = after.filter(F.size("front") > 0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", width)
    if not done:
        return state.select("q", F.explode("beam").alias("c"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest(embeddings: DataFrame, every: int = 20, count: int = 20, k: int = K, rounds: int = 8) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by ``every`` the ``count`` rows
    with the largest inner product that the search finds, nearest first, ties to the smaller vec_id.

    Rows without vec_id and vectors that are null, empty or zero, or that hold a null or a number that isn't finite, take no
    part, as query or as candidate. A repeated vec_id counts once, with the least of its vectors; vectors of
    different lengths are never compared. Other columns are not read. No rows: no rows.
    """
    v = F.col("embedding")
    ids = embeddings.filter(F.col("vec_id").isNotNull() & usable(v)).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("vector"))
    rows = cut(ids.select("vec_id", F.xxhash64("vector").alias("h0"), F.xxhash64(F.lit(1), "vector").alias("h1"), "vector"))
    classes = cut(rows.groupBy("h0", "h1").agg(F.min("vec_id").alias("node"), F.first("vector").alias("vector")).withColumn("dim", F.size("vector")))
    x = F.transform("vector", lambda c: c.cast("double"))
    norm = F.array_max(F.transform(x, F.abs))
    norm = norm * F.sqrt(F.aggregate(F.transform(x, lambda c: F.pow(c / norm, 2)), F.lit(0.0), lambda a, b: a + b))
    largest = cut(classes.groupBy("dim").agg(F.max(norm).alias("largest")))
    codes = cut(classes.select("node", "dim", "vector").join(largest, "dim").mapInArrow(_encode, "node long, dim int, code binary"))
    # equal vectors: a query needs no more than the first count + 1 of them, itself among them
    first = Window.partitionBy("h0", "h1").orderBy("vec_id")
    names = classes.select("h0", "h1", "node")
    members = cut(rows.select("vec_id", "h0", "h1").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= count + 1).join(names, ["h0", "h1"]).select("node", "vec_id"))
    asked = cut(spread_join(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.struct("h0", "h1").alias("_k")),
                            names.select(F.struct("h0", "h1").alias("_k"), F.col("node").alias("q")), "_k").select("query_id", "q"))
    queries = cut(asked.select("q").distinct())
    found = search(codes, graph(codes, k, rounds=rounds), queries)
    vectors = classes.select("node", x.alias("x"))
    pairs = found.join(vectors.select(F.col("node").alias("q"), F.col("x").alias("_q")), "q").join(vectors.select(F.col("node").alias("c"), F.col("x").alias("_c")), "c")
    score = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    order = [F.col("score").desc(), F.col("vec_id")]
    exact = pairs.select("q", F.col("c").alias("node"), score.alias("score")).join(members, "node")
    top = exact.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("_n") <= count + 1).drop("_n", "node")
    each = spread_join(asked, top, "q").filter("query_id <> vec_id")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= count).select(
        "query_id", "rank", "vec_id", "score")
