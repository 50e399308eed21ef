"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's share of all words; a source that would need more
than ``most`` passes over its words is clamped there, and what it can't take goes to the
others in proportion to their weights, until none is above. A source's target is then
``whole`` repetitions of all its documents and a fractional one: documents in the order
of a seeded hash are taken once more until the rest is used up, the last one in part.

That order is never sorted: histograms over the hash's leading bits narrow the place
where the rest is used up down to a few documents, whatever the size of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions.ranking import rank_within
from partloom.session import written as cut

from .common import WORD

OUT = ["size", "source_size", "target", "taken"]
LEVEL = 4096  # histogram buckets of a level: 12 of the key's 60 bits


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(seed: int) -> Column:
    """60 bits of a digest of seed, id and text: the same on every run and engine."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, most: int) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): min(cap, level * weight), where the
    level rises until the targets add up. Each round reads three sums of the table."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, level, clamped = F.col("source_size") * F.lit(float(most)), 0.0, None
    while True:
        over = cap < F.lit(level) * F.col("weight")
        n, held, free = sources.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("source_size") * most).otherwise(0)),
                                    F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == clamped or not free:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        clamped, level = n, (total - held) / free


def _where(df: DataFrame, rest: DataFrame, bucket: Column, name: str) -> DataFrame:
    """The bucket of each source in which the cumulated words pass what is left."""
    sums = df.groupBy("source", bucket.alias(name)).agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return run.join(rest, run["source"].eqNullSafe(rest["_source"])).filter("_b <= _left AND _left < _b + _n").select(
        "_source", name, (F.col("_left") - F.col("_b")).alias("_left"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """All rows and columns of ``documents`` with ``size``, ``source_size``, ``target`` and ``taken``.

    Sources in code point order, null last, weigh ``weights`` in turn. Null and empty
    texts have size 0 and are never taken. Rows that are equal in id and text share a
    place in the order and, where the rest ends among them, share what is left. Columns
    of the input with the names of the four new ones are replaced. No rows: no rows.
    """
    rows = documents.drop(*OUT).withColumn("size", n_words(F.col("text"))).withColumn("_key", seeded_key(seed))
    return _mixed(rows, weights, most).drop("_key")


def mix_sizes(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """The same, with doc_id and the four new columns alone."""
    rows = cut(documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded_key(seed).alias("_key")))
    return _mixed(rows, weights, most).select("doc_id", *OUT)


def _mixed(rows: DataFrame, weights, most: int) -> DataFrame:
    small = cut(rows.select("source", "size", "_key")) if len(rows.columns) > 4 else rows
    sizes = cut(small.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = rank_within(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = cut(water_fill(cut(ranked.select("source", "source_size", weight.cast("long").alias("weight"))), most).withColumn(
        "_want", F.floor(F.col("target") + 0.5)).withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_want") / F.col("source_size"))).otherwise(0)).withColumn(
        "_left", F.col("_want") - F.col("_whole") * F.col("source_size")))
    # narrow the place: 12 bits, 12 more, then the keys themselves
    one, two = F.floor(F.col("_key") / LEVEL**4), F.floor(F.col("_key") / LEVEL**3)
    first = cut(_where(small, filled.select(F.col("source").alias("_source"), "_left"), one, "_one"))
    among = small.join(first.select("_source", "_one"), small["source"].eqNullSafe(F.col("_source")) & (one == F.col("_one")), "left_semi")
    second = cut(_where(among, first.drop("_one"), two, "_two"))
    last = small.join(second.select("_source", "_two"), small["source"].eqNullSafe(F.col("_source")) & (two == F.col("_two")), "left_semi")
    ties = last.groupBy("source", "_key").agg(F.sum("size").alias("_tied"))
    third = _where(ties.withColumnRenamed("_tied", "size"), second.drop("_two"), F.col("_key"), "_end").join(
        ties, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_end") == F.col("_key"))).select(
        "_source", "_end", F.col("_left").alias("_part"), "_tied")
    plan = cut(filled.withColumnRenamed("source", "_s").drop("weight", "_want", "_left").join(third, F.col("_s").eqNullSafe(F.col("_source")), "left").drop("_source"))
    more = (F.when(F.col("_end").isNull(), 0).when(F.col("_key") < F.col("_end"), F.col("size"))
            .when(F.col("_key") == F.col("_end"), F.floor(F.col("_part") * F.col("size") / F.col("_tied"))).otherwise(0))
    mixed = rows.join(plan, rows["source"].eqNullSafe(F.col("_s")))
    return mixed.withColumn("taken", (F.col("_whole") * F.col("size") + more).cast("long")).select(
        *rows.columns, "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0 * source_size / w AS ratio FROM s),
p AS (SELECT ratio, row_number() OVER o AS place, sum(source_size) OVER () AS total, sum(3 * source_size) OVER o - 3 * source_size AS held, sum(w) OVER () - (sum(w) OVER o - w) AS free
  FROM r WINDOW o AS (ORDER BY ratio, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(CAST(total - held AS DOUBLE) / CAST(free AS DOUBLE), place) AS level FROM p WHERE CAST(total - held AS DOUBLE) / CAST(free AS DOUBLE) <= ratio),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM l) * w) AS target FROM s),
f AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM t),
g AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS whole FROM f),
k AS (SELECT source, key, sum(size) AS tied FROM d GROUP BY source, key),
c AS (SELECT *, sum(tied) OVER (PARTITION BY source ORDER BY key) - tied AS before FROM k)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(g.whole * d.size + CASE WHEN before + tied <= want - whole * source_size THEN d.size
  WHEN before < want - whole * source_size THEN ((want - whole * source_size - before) * d.size) // tied ELSE 0 END AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.key = d.key"""
