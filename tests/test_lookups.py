from collections import Counter

import pytest
from pyspark.sql import functions as F

from errorloom.config import shared_folder
from errorloom.operators.lookups import join_lookup, measured_bytes


def test_size_counts_nested_text_and_grows_with_rows(spark):
    flat = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    nested = flat.select("id", F.struct("t").alias("s"))
    assert 100_000 < measured_bytes(flat) < 120_000
    assert 100_000 < measured_bytes(nested) < 120_000
    assert measured_bytes(flat.where("false")) == 0
    assert measured_bytes(flat.select("id", F.lit(None).cast("string").alias("t"))) >= 6_400


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
@pytest.mark.parametrize("costly", [False, True])
def test_both_ways_give_the_same_rows(spark, how, costly):
    facts = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("key"))
    table = spark.range(10, 40).select(F.col("id").alias("key"), F.repeat(F.lit("x"), 100).alias("t"))
    small = join_lookup(facts, table, ["key"], how, 1_000_000, costly)
    large = join_lookup(facts, table, ["key"], how, 0, costly)
    assert "strategy=broadcast" in small._jdf.queryExecution().logical().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().logical().toString()
    assert small.columns == large.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_a_hot_key_is_spread_over_tasks(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
        # A hot key of 30,000 rows is small for adaptive execution.
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"), "id")
    table = spark.range(90_000).select(F.col("id").alias("key"), F.col("id").alias("value"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = join_lookup(rows, table, ["key"], "left", max_bytes=0)
        got = joined.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert len(got) == 90_000 and all(row.key == row.value for row in got)
    hot = Counter(row.task for row in got if row.key == 1)
    assert sum(hot.values()) >= 30_000 and max(hot.values()) < 30_000 / 4
    # Other tasks read their keys once: the table is not copied for rows that are not hot.
    assert len({row.task for row in got}) <= 64 + len(hot)


def test_the_cluster_names_the_checkpoint_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir() is not None
