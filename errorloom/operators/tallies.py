"""Tallies: partial counts of open reports, which every summary is derived from.

A tally row stands for all open reports that agree on its key columns. Its buffers are a count and
four minima and maxima, all of fixed width, so Spark hash-aggregates them in every task before
anything is shuffled: an error storm of any size leaves one row per task. Summaries then regroup
tallies, not reports, and the same tallies, written once, serve all summaries.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.operators.feed import only_open

KEYS = ("message", "line", "file", "browser", "platform")


def tally(reports: DataFrame, *keys: str) -> DataFrame:
    """Open reports counted by the keys, by default all of ``KEYS``."""
    return only_open(reports).groupBy(*(keys or KEYS)).agg(
        F.count(F.lit(1)).alias("times"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.min("date").alias("first_report"),
        F.max("date").alias("last_report"),
    )


def regroup(tallies: DataFrame, *keys, **more) -> DataFrame:
    """Tallies merged on fewer keys. ``more`` names further aggregates."""
    return tallies.groupBy(*keys).agg(
        F.sum("times").alias("times"),
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        F.min("first_report").alias("first_report"),
        F.max("last_report").alias("last_report"),
        *[aggregate.alias(name) for name, aggregate in more.items()],
    )
