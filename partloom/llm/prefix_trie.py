"""Conversation prefix trie with totals of subtrees by depth bands.

A node is a distinct sequence of first turns. It is named by its depth and a 128-bit
running sum of position-salted turn hashes, so that all prefixes of a conversation come from
running sums, and a conversation of any length is summed in pieces.

Totals go up by depth bands of ``band`` levels: a node explodes only to its ancestors in its own
band, ``band`` rows at most. Above the bands lies the tree of band roots, which has bands of its own,
and so on; once the band roots' totals are complete, each is handed to the band above it and explodes
there. The rounds grow with the logarithm of the depth, the rows with the nodes times ``band``.

A node's ancestors are looked up on the path of its smallest member, so no path is ever carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions.ranking import rank_within
from partloom.session import written as cut

from .common import remainder, spread_join
from .mixing import n_words

PIECE = 1024  # turns of a conversation that are summed in one window
CHUNK = 4096  # ids of a node that are joined to one text before they are hashed
KEY = ["depth", "k0", "k1"]
_LIMBS = [f"_l{i}" for i in range(4)]  # 32 bits each, so that sums of a conversation's turns fit a long


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): the turns of each conversation numbered from 1, with a hash
    in place of role and text, and the words of the text.

    Turns are ordered by ``turn``, null first, ties by the hash, so that a rerun agrees. A null
    role or text counts as empty. Rows without conv_id take no part. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        n_words(text).alias("words"))
    return rank_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "pos").drop("turn")


def rebuilt(numbered: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, pos, a, b, words, n_turns): each conversation c with the first h turns of c - c % ``every`` in
    place of its own first h, where h = crc32(c) % ``heads``; ``pos`` 0 stands for the textless root.

    % is SQL's remainder, with the sign of c. ``numbered`` is read several times: it should be written.
    """
    h = remainder(heads, "conv_id").cast("long")
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("_own"))
    # every conversation asks one of ``every`` for its size: bounded fan-out
    asked = sizes.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).join(
        sizes.select(F.col("conv_id").alias("_base"), F.col("_own").alias("_there")), "_base", "left")
    convs = cut(asked.withColumn("_h", h).withColumn("_got", F.least("_h", F.coalesce("_there", F.lit(0)))).withColumn(
        "n_turns", F.col("_got") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))))
    own = spread_join(numbered.filter(F.col("pos") > h), convs.select("conv_id", "_h", "_got", "n_turns"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("_h") + F.col("_got")).alias("pos"), "a", "b", "words", "n_turns")
    first = numbered.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "_base")
    taken = first.join(convs.select("_base", "conv_id", "_h", "n_turns"), "_base").filter("pos <= _h").select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "a", "b", "words", "n_turns")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("pos"), zero.alias("a"), zero.alias("b"), zero.alias("words"), "n_turns")
    return own.unionByName(taken).unionByName(root)


def _key(sums: list[Column]) -> list[Column]:
    low = [s % (1 << 32) for s in sums]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def steps(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, words, last) for each prefix of each of the ``sequences`` (conv_id, pos,
    a, b, words, n_turns): its key, the key of the prefix one turn shorter, whether it is the whole."""
    x, y = F.xxhash64("pos", "a", "b"), F.xxhash64("b", "pos", "a")
    mask = (1 << 32) - 1
    limbs = [x.bitwiseAND(mask), F.shiftrightunsigned(x, 32), y.bitwiseAND(mask), F.shiftrightunsigned(y, 32)]
    salted = sequences.select("*", *[F.when(F.col("pos") > 0, v).otherwise(0).alias(c) for v, c in zip(limbs, _LIMBS)],
                              F.floor(F.col("pos") / PIECE).alias("_piece"))
    # what the pieces before a piece add up to; most conversations have one piece only
    whole = salted.groupBy("conv_id", "_piece").agg(*[F.sum(c).alias(c) for c in _LIMBS])
    before = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = whole.select("conv_id", "_piece", *[F.sum(c).over(before).alias(f"{c}_before") for c in _LIMBS]).filter("_piece > 0")
    within = Window.partitionBy("conv_id", "_piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = salted.select("*", *[F.sum(c).over(within).alias(f"{c}_sum") for c in _LIMBS]).join(shifts, ["conv_id", "_piece"], "left")
    total = [F.col(f"{c}_sum") + F.coalesce(f"{c}_before", F.lit(0)) for c in _LIMBS]
    k, p = _key(total), _key([t - F.col(c) for t, c in zip(total, _LIMBS)])
    return summed.select("conv_id", F.col("pos").alias("depth"), k[0].alias("k0"), k[1].alias("k1"), p[0].alias("p0"), p[1].alias("p1"),
                         "words", (F.col("pos") == F.col("n_turns")).alias("last"))


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], band: int = 16) -> DataFrame:
    """(depth, k0, k1, values ...): for each node the sums of ``values`` over its subtree, itself included.

    ``nodes``: depth, k0, k1, conv_id (the smallest member) and values. ``paths``: conv_id, depth, k0, k1, all
    prefixes of all members. Both are read several times: they should be written.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    levels = [nodes.select(*KEY, "conv_id", *values)]
    while band ** len(levels) <= deepest:
        # the sums of whole bands stand at their roots, the nodes of the tree above
        wide = band ** len(levels)
        at = levels[-1].withColumn("depth", F.col("depth") - F.col("depth") % wide).drop("k0", "k1")
        roots = paths.filter(F.col("depth") % wide == 0)
        levels.append(cut(at.join(roots, ["conv_id", "depth"]).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values])))
    done = None
    for level in range(len(levels) - 1, -1, -1):
        step = band ** level
        rows = levels[level].select("conv_id", F.col("depth").alias("_at"), *values)
        if done is not None:  # completed totals of the bands below join at the node above their root
            rows = rows.unionByName(done.filter("depth > 0").select("conv_id", (F.col("depth") - step).alias("_at"), *values))
        above = paths.filter(F.col("depth") % step == 0).withColumn("_band", F.floor(F.col("depth") / (step * band)))
        exploded = rows.withColumn("_band", F.floor(F.col("_at") / (step * band))).join(above, ["conv_id", "_band"]).filter("depth <= _at")
        done = cut(exploded.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(v) for v in values]))
    return done.drop("conv_id")


def ends(paths: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256): for nodes at which conversations end, the digest of their ids.

    Ids are sorted over range pieces and joined to texts of ``CHUNK`` ids there. A digest is
    taken in order by its nature, so the texts of a node stream through one task; none is kept.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        rows: list[tuple] = []

        def close():
            if ids:
                rows.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
                if node != key or len(ids) >= CHUNK:
                    close()
                    key = node
                ids.append(conv)
            if len(rows) > 1000:
                yield _batch(rows, [*KEY, "first", "ids"])
                rows = []
        close()
        if rows:
            yield _batch(rows, [*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if node != key:
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(rows) > 1000:
                yield _batch(rows, [*KEY, "ends_sha256"])
                rows = []
        if key:
            rows.append((*key, state.hexdigest()))
        if rows:
            yield _batch(rows, [*KEY, "ends_sha256"])

    key = "depth long, k0 long, k1 long"
    pieces = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*KEY, "conv_id"]
    chunks = paths.filter("last").select(*order).repartitionByRange(pieces, *order).sortWithinPartitions(*order).mapInArrow(joined, f"{key}, first long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(hashed, f"{key}, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def trie(sequences: DataFrame, band: int = 16) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, pos, a, b, words, n_turns), one row each.

    conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. A sequence without turns is a member of the
    root alone. No sequences: no rows.
    """
    paths = cut(steps(sequences))
    found = cut(paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p0").alias("p0"),
                                        F.first("p1").alias("p1"), F.max("words").alias("words")))
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count("*").alias("n_children"))
    nodes = cut(found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(cut(own), paths.select("conv_id", *KEY), ["n_leaves", "saved_tokens"], band)
    # many nodes share a parent: its row goes to pieces of them
    name = F.concat_ws(":", *KEY)
    child = nodes.filter("depth > 0").withColumn("_parent", F.concat_ws(":", F.col("depth") - 1, "p0", "p1"))
    parents = nodes.filter("n_children > 0").select(name.alias("_parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = spread_join(child, parents, "_parent").drop("_parent").unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    whole = placed.join(sums, KEY).join(ends(paths), KEY, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame, band: int = 16) -> DataFrame:
    """The trie of the rebuilt ``conversations``: see ``turns``, ``rebuilt`` and ``trie``."""
    return trie(rebuilt(cut(turns(conversations))), band)


ORACLE = r"""
WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS own FROM r GROUP BY c),
h AS (SELECT c, own, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 4 AS h FROM n, crc),
g AS (SELECT h.*, least(h.h, coalesce(n.own, 0)) AS got FROM h LEFT JOIN n ON n.c = h.base),
s AS (SELECT g.c, r.p - g.h + g.got AS p, role, text FROM g JOIN r ON r.c = g.c AND r.p > g.h UNION ALL SELECT g.c, r.p, role, text FROM g JOIN r ON r.c = g.base AND r.p <= g.h),
w AS (SELECT c, p AS d, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY p ROWS UNBOUNDED PRECEDING) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM s
  UNION ALL SELECT c, 0, [], 0 FROM n),
u AS (SELECT c, d, md5(path::JSON::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(path[:d - 1]::JSON::VARCHAR) END AS parent, words, d = max(d) OVER (PARTITION BY c) AS ends FROM w),
v AS (SELECT d, k, min(c) AS c, any_value(parent) AS parent, count(*) AS n, any_value(words) AS words, string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c) AS ids FROM u GROUP BY d, k),
f AS (SELECT parent AS k, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN f USING (k, d)),
q AS (SELECT u.k, u.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n - 1) * x.words) AS saved FROM x JOIN u ON u.c = x.c AND u.d <= x.d GROUP BY u.k, u.d)
SELECT x.c AS conv_id, x.d::BIGINT AS depth, y.c AS parent_conv_id, x.n AS n_convs, x.n_children::BIGINT AS n_children, q.n_leaves::BIGINT AS n_leaves, q.saved::BIGINT AS saved_tokens,
  sha256(coalesce(x.ids, '')) AS ends_sha256
FROM x JOIN q USING (k, d) LEFT JOIN x y ON y.k = x.parent AND y.d = x.d - 1"""
