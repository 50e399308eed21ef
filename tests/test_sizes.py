"""Tables that a loop writes are estimated by their rows, not by their packed files."""

from pyspark.sql import functions as F

from partloom.session import PACKED, cut


def test_a_packed_table_is_not_taken_for_a_small_one(spark):
    rows = 500_000
    words = [F.concat(F.lit("word-"), (F.col("id") % 5).cast("string")).alias(f"w{i}") for i in range(6)]
    stored = cut(spark.range(rows).select("id", (F.col("id") % 7).alias("k"), *words))
    size = stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) >= rows * 8 * len(stored.columns)
    keys = stored.select("id", "k")
    other = spark.range(3 * rows).withColumn("v", F.col("id") * 2)
    joined = other.join(keys, "id")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert joined.count() == rows


def test_a_small_table_is_still_broadcast(spark):
    few = cut(spark.range(100).withColumn("k", F.col("id") % 7))
    plan = spark.range(1_000_000).join(few, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_the_owner_of_the_session_decides(spark):
    before = spark.conf.get(PACKED)
    try:
        spark.conf.set(PACKED, "3.0")
        cut(spark.range(3))
        assert spark.conf.get(PACKED) == "3.0"
    finally:
        spark.conf.set(PACKED, before)


def test_a_level_of_some_megabytes_stays_with_the_executors(spark):
    level = cut(spark.range(100_000).withColumn("v", F.col("id") * 3))
    other = cut(spark.range(120_000).withColumn("w", F.col("id") * 5))
    joined = level.join(other, "id").groupBy((F.col("id") % 10).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    assert sum(r.n for r in joined.collect()) == 100_000
    joined.collect()
    ran = joined._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" not in ran.toString()
