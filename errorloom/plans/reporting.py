"""Writing the reports."""

from pyspark.sql import DataFrame, SparkSession

from errorloom.config import Config
from errorloom.operators.summaries import (
    browser_summary,
    browser_versions,
    message_summary,
    script_summary,
)
from errorloom.operators.tallies import tally
from errorloom.plans.resolving import stored
from errorloom.sources.log import Log
from errorloom.sources.tables import location, read_table, write_batch


def summaries(tallies: DataFrame, browsers: DataFrame) -> dict:
    return {
        "message_summary": message_summary(tallies, browsers),
        "browser_summary": browser_summary(tallies, browsers),
        "browser_versions": browser_versions(tallies, browsers),
        "script_summary": script_summary(tallies),
    }


def write_reports(spark: SparkSession, config: Config, out_uri: str) -> None:
    """Reads the open reports once and writes every summary.

    The snapshot that the summaries share is a table of tallies, far smaller than the reports and
    safe from lost executors.
    """
    snapshot = f"{out_uri.rstrip('/')}/snapshot"
    manifest = Log(spark, config.reports_from).latest()
    reports = stored(spark, config.reports_from, "reports", manifest)
    write_batch(tally(reports), snapshot, "tallies", batch_id=0)
    tallies = read_table(spark, snapshot, "tallies")
    browsers = read_table(spark, config.reports_from, "browsers", manifest=manifest)
    for name, summary in summaries(tallies, browsers).items():
        summary.write.mode("overwrite").parquet(location(out_uri, name))


def running_summaries(spark: SparkSession, config: Config) -> dict:
    """The summaries as of the last ingested batch, without reading reports.

    Adds up the tallies that batches left behind and compaction merged, without what was resolved since.
    """
    manifest = Log(spark, config.reports_from).latest()
    tallies = stored(spark, config.reports_from, "tallies", manifest)
    return summaries(tallies, read_table(spark, config.reports_from, "browsers", manifest=manifest))
