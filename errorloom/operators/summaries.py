"""The three reports and their drill-downs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.functions import text, times
from errorloom.operators.browsers import name_browser, name_browser_ids
from errorloom.operators.feed import only_open
from errorloom.operators.lookups import BROADCAST_BYTES, join_lookup
from errorloom.operators.tallies import regroup, tally


def _with_hours(summary):
    return summary.withColumns(
        {
            "first_hour": times.start_of_hour(F.col("first_report")),
            "last_hour": times.start_of_hour(F.col("last_report")),
        }
    )


def message_groups(tallies: DataFrame) -> DataFrame:
    """Tallies merged by fingerprint; ``last`` is the report with the greatest id."""
    marked = tallies.withColumn("hash", text.fingerprint(F.col("message"), F.col("line")))
    return regroup(
        marked,
        "hash",
        last=F.max_by(F.struct("message", "file", "line", "browser", "platform"), "last_id"),
    )


def message_summary(
    tallies: DataFrame,
    browsers: DataFrame,
    danger_at: int = 3,
    max_lookup_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per fingerprint: its latest report, how often, how bad, since when.

    Takes tallies by all keys. The browser is looked up for the groups, not for the reports.
    """
    groups = message_groups(tallies).select("*", "last.*").drop("last", "last_id")
    return _with_hours(name_browser(groups, browsers, max_lookup_bytes)).select(
        "hash",
        "message",
        "file",
        "line",
        "type",
        "version",
        "platform",
        "times",
        text.severity(F.col("times"), danger_at).alias("severity"),
        "first_id",
        "first_report",
        "last_report",
        "first_hour",
        "last_hour",
    )


def with_age(summary: DataFrame, as_of) -> DataFrame:
    """Adds whole hours: since the first and the last report's hour, and between the two reports.

    Works on every summary with ``first_report`` and ``last_report``.
    """
    now = times.wall_clock(as_of)
    first, last = F.col("first_report"), F.col("last_report")
    return summary.withColumns(
        {
            "age_hours": times.whole_hours(times.start_of_hour(first), now),
            "last_age_hours": times.whole_hours(times.start_of_hour(last), now),
            "active_hours": times.whole_hours(first, last),
        }
    )


def browser_versions(tallies: DataFrame, browsers: DataFrame, type: str | None = None) -> DataFrame:
    """Reports per (type, version), of one type if given. Takes tallies by at least ``browser``."""
    named = name_browser_ids(regroup(tallies, "browser"), browsers)
    if type is not None:
        named = named.where(F.col("type") == type)
    return regroup(named, "type", "version").drop("last_id")


def browser_summary(tallies: DataFrame, browsers: DataFrame) -> DataFrame:
    """Reports and number of versions per browser type."""
    # One row per version arrives here, so counting rows counts distinct versions.
    per_version = browser_versions(tallies, browsers)
    return per_version.groupBy("type").agg(
        F.sum("times").alias("times"),
        F.count(F.lit(1)).alias("versions"),
        F.min("first_id").alias("first_id"),
        F.min("first_report").alias("first_report"),
        F.max("last_report").alias("last_report"),
    )


def browser_summary_since_newest_version(
    reports: DataFrame, browsers: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """As ``browser_summary``, but first and last report count from when the type's newest version
    first appeared.

    Two passes over id, browser and date of the open reports: one for the cuts, one for the times.
    """
    per_browser = name_browser_ids(tally(reports, "browser"), browsers)
    cuts = (
        regroup(per_browser, "type", "version")
        .groupBy("type")
        .agg(
            F.max("first_id").alias("cut"),
            F.sum("times").alias("times"),
            F.count(F.lit(1)).alias("versions"),
            F.min("first_id").alias("first_id"),
        )
    )
    # One row per browser id that occurs.
    lookup = per_browser.select("browser", "type").join(cuts, "type")
    rows = only_open(reports).select("id", "browser", "date")
    # Every type keeps at least the report that made the cut.
    return (
        join_lookup(rows, lookup, ["browser"], "inner", max_lookup_bytes, costly=True)
        .where(F.col("id") >= F.col("cut"))
        .groupBy("type", "times", "versions", "first_id")
        .agg(F.min("date").alias("first_report"), F.max("date").alias("last_report"))
    )


def script_summary(tallies: DataFrame) -> DataFrame:
    """Reports per script. Takes tallies by at least ``file``."""
    return regroup(tallies, "file").drop("last_id")


def script_details(
    reports: DataFrame, browsers: DataFrame, file: str, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every open report of one script, unordered; sort by ``id`` to display."""
    rows = only_open(reports).where(F.col("file") == file)
    return name_browser(rows, browsers, max_lookup_bytes).select(
        "id",
        text.browser_label(F.col("type"), F.col("version")).alias("browser_label"),
        "line",
        "message",
        "platform",
    )
