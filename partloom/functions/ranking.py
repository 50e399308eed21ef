"""Numbering rows inside a group without sorting a hot group in one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..session import cut


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rn", split: bool = True) -> DataFrame:
    """``row_number`` per key. ``order`` must be total inside a key.

    Rows are range-partitioned by (key, order), so a hot key spreads over many pieces;
    they are numbered inside a piece and shifted by the sizes of the pieces before it. The
    pieces are written first: a lost executor must not re-draw the range bounds. A
    caller whose groups are short by their nature (the lines of an order) passes
    ``split=False`` for a plain window.
    """
    if not split:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(df.repartitionByRange(n, *keys, *order).withColumn("_piece", F.spark_partition_id()))
    local = pieces.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"),
                         F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return (local.join(shift, same & (F.col("_piece") == F.col("_p")))
            .withColumn(out, (F.col("_local") + F.col("_shift")).cast("int"))
            .select(*df.columns, out))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "rn") -> DataFrame:
    """``rank_within`` for wide tables: rows travel once, with all their columns, and none is joined back.

    Rows are range-partitioned and sorted by (key, order) and counted as they pass. Only the first
    group of a piece can have begun in pieces before it, so a piece is shifted by one number.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_piece", F.spark_partition_id())
    schema = StructType([*sorted_.schema.fields, StructField("_at", LongType()), StructField("_local", LongType()), StructField("_first", BooleanType())])
    pieces = cut(sorted_.mapInArrow(_counted(keys), schema))
    lasts = pieces.groupBy("_piece").agg(F.max("_at").alias("_at"))  # one row a piece, as all tables below: a proven bound for the broadcasts
    tail = pieces.join(F.broadcast(lasts), ["_piece", "_at"]).select(F.col("_piece").alias("_before"), F.col("_local").alias("_size"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    shift = cut(pieces.filter("_at = 0").select("_piece", *keys).join(F.broadcast(tail), same & (F.col("_before") < F.col("_piece")))
                .groupBy("_piece").agg(F.sum("_size").alias("_shift")))
    return (pieces.join(F.broadcast(shift), "_piece", "left")
            .withColumn(out, (F.col("_local") + F.when(F.col("_first"), F.coalesce("_shift", F.lit(0))).otherwise(0)).cast("int"))
            .select(*df.columns, out))


def _counted(keys: list[str]):
    """Adds to a sorted partition each row's place in it and in its group, and whether the group is the partition's first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, at, groups = None, 0, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                c, before = b.column(k).slice(1), b.column(k).slice(0, n - 1)
                differ = pc.fill_null(pc.not_equal(c, before), False).to_numpy(zero_copy_only=False)
                new[1:] |= differ | (c.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
            new[0] = [b.column(k)[0].as_py() for k in keys] != last
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, place, -1 - seen))
            group = groups + np.cumsum(new)
            local = place - np.where(begin < 0, -seen, begin) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + place), pa.array(local), pa.array(group == 1)], [*b.schema.names, "_at", "_local", "_first"])
            last, seen, at, groups = [b.column(k)[n - 1].as_py() for k in keys], int(local[-1]), at + n, int(group[-1])

    return run
