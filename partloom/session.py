"""Lineage cutting for the level-by-level loops.

Every loop writes each level as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and reads it back. Three things follow: a lost executor
costs one level and not the whole walk, the plan of level *n* does not contain
level *n-1*, and Catalyst sees the size of a level (file statistics), so a
small frontier is broadcast by Spark's own size check and a large one is not.

Files are many times smaller than their rows: keys are packed to some bits and words
that repeat to less. Spark takes bytes of files for bytes of rows unless told otherwise,
and would send hundreds of megabytes through the driver as a "small" table, so
:func:`sizes_of_rows` tells it.

A question takes up to some hundred joins, and the driver collects and builds every broadcast,
each in a memory page of its own at least. At Spark's limit of 10 MB they add up to more than a
driver holds, so the limit is lowered: tables of teams or names, which hot keys meet, are still
broadcast, frontiers and levels are not. Their joins stay with the executors, which shuffle both sides anyway.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}

PACKED = "spark.sql.sources.fileCompressionFactor"
ROWS_PER_FILE_BYTE = 32.0  # bytes of rows for a byte of file: the most that was seen, so that no large table counts as small

SMALL = "spark.sql.autoBroadcastJoinThreshold"  # also for sides that are shuffled already, unless SMALL_SHUFFLED is set
SMALL_SHUFFLED = "spark.sql.adaptive.autoBroadcastJoinThreshold"
MOST_SENT = 1 << 18  # bytes of rows of one broadcast


def sizes_of_rows(spark: SparkSession) -> None:
    """Let Catalyst estimate tables by their rows and broadcast little, unless the session's owner set how."""
    if spark.conf.get(PACKED, "1.0") == "1.0":
        spark.conf.set(PACKED, str(ROWS_PER_FILE_BYTE))
    if spark.conf.get(SMALL) == "10485760b" and spark.conf.get(SMALL_SHUFFLED, None) is None:
        spark.conf.set(SMALL, str(MOST_SENT))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as named by the session."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="partloom-")
    return _LOCAL_ROOT[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, sized by its rows."""
    sizes_of_rows(df.sparkSession)
    return written(df)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. For texts, vectors and hashes, which pack little."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys`` and read it back: joins on the keys find its rows in place."""
    spark = df.sparkSession
    sizes_of_rows(spark)
    name = uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(f"bucketed_{name}", format="parquet")
    return spark.table(f"bucketed_{name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
