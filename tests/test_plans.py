"""What the plans must and must not contain, and hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from builders import browsers, reports
from errorloom import fixtures as fx
from errorloom.operators import agents, beacons, feed, manage, summaries
from errorloom.operators.tallies import tally
from errorloom.schemas import REPORTS

SF_DIR = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "reports")
    fx.reports(fx.events(spark, SF_DIR)).write.parquet(path)
    return spark.read.schema(REPORTS).parquet(path)


def read_columns(text):
    return {column.split(":")[0] for column in re.search(r"ReadSchema: struct<([^>]*)>", text)[1].split(",")}


def test_scans_read_what_they_need_and_filter_early(spark, stored):
    text = plan(summaries.script_summary(tally(stored, "file")))
    assert read_columns(text) == {"id", "file", "status", "date"}
    assert "EqualTo(status,0)" in text
    text = plan(summaries.script_details(stored, fx.browsers(spark), "x"))
    assert "EqualTo(file,x)" in text


def test_row_level_work_does_not_shuffle(spark, stored):
    raw = fx.raw_beacons(fx.events(spark, SF_DIR))
    for df in (
        beacons.triage(beacons.decode_requests(raw)),
        agents.apply_rules(raw),
        beacons.rejects(beacons.triage(raw)),
    ):
        assert "Exchange" not in plan(df)
    text = plan(feed.open_reports(stored, fx.browsers(spark)))
    assert text.count("BroadcastHashJoin") == 1
    # The one shuffle is of the dimension, below the broadcast.
    assert text.index("BroadcastExchange") < text.index("Exchange hashpartitioning")


def test_summaries_combine_before_they_shuffle(spark, stored):
    text = plan(summaries.script_summary(tally(stored, "file")))
    assert text.count("Exchange hashpartitioning") == 1
    # From the scan up: a hash aggregate in every task, then the shuffle.
    assert text.rindex("Exchange") < text.rindex("HashAggregate")
    assert "SortAggregate" not in text
    # Messages: nothing but fixed-width hash aggregation below the first shuffle.
    below = plan(tally(stored)).split("Exchange", 1)[1]
    assert "HashAggregate" in below and "SortAggregate" not in below


def test_no_query_forms_pairs(spark, stored):
    known = fx.browsers(spark)
    for df in (
        feed.open_reports(stored, known),
        summaries.message_summary(tally(stored), known),
        manage.resolve(stored, fx.fixed_hashes(stored)),
        manage.affected(stored, known, browser="Chrome"),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_lookup_without_broadcast_gives_the_same_feed(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with_broadcast = feed.open_reports(stored, fx.browsers(spark))
    count = with_broadcast.select(F.bit_xor(F.xxhash64("id", "hash", "browser"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = feed.open_reports(stored, fx.browsers(spark), max_lookup_bytes=0)
        assert "SortMergeJoin" in plan(merged)
        assert merged.select(F.bit_xor(F.xxhash64("id", "hash", "browser"))).first()[0] == count
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_error_storm_leaves_one_row_per_task(spark):
    storm = (
        spark.range(0, 300_000, numPartitions=6)
        .withColumn("hot", F.col("id") % 3 != 0)
        .select(
            F.col("id"),
            F.lit("a.js").alias("file"),
            F.when(F.col("hot"), 1).otherwise((F.col("id") % 500).cast("int")).alias("line"),
            F.when(F.col("hot"), "storm").otherwise("other").alias("message"),
            F.lit(1).cast("bigint").alias("browser"),
            F.lit(0).alias("status"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("date"),
            F.lit(1).cast("bigint").alias("ip"),
            F.lit("Linux").alias("platform"),
        )
    )
    summary = summaries.message_summary(tally(storm), browsers(spark, (1, "Chrome", "26")))
    top = summary.orderBy(F.desc("times")).first()
    assert (top.message, top.times, top.first_id) == ("storm", 200_000, 1)
    assert summary.agg(F.sum("times")).first()[0] == 300_000


def test_hot_browser_and_hot_address_survive_sort_merge_joins(spark):
    rows = reports(spark, *[{"browser": 1 if n % 3 else n, "ip": 5 if n % 3 else n} for n in range(600)])
    known = browsers(spark, *[(n, "Chrome" if n % 2 else "Opera", str(n)) for n in range(0, 600, 2)], (1, "Hot", "1"))
    small = summaries.browser_summary_since_newest_version(rows, known)
    merged = summaries.browser_summary_since_newest_version(rows, known, max_lookup_bytes=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, merged.collect()))

