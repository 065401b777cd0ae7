"""Summaries kept up to date by Structured Streaming itself.

One aggregation each, with buffers of fixed width. Where a summary has two levels (browsers have versions) the stream
counts on the lower one, a state row per type and version, and the upper one is rolled up when it is read: no
state row grows with what clients send. As in the dimension, spellings that differ in case are one version.

What changed in a micro-batch is committed as a part (``sources.log``). Parts are merged in levels, of every group only
the latest row stays, so readers open a bounded number of files, however long the stream runs.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from errorloom.functions import text
from errorloom.operators.agents import apply_rules
from errorloom.operators.beacons import accepted, decode_requests, triage
from errorloom.sources.log import Log, Manifest, Part, runs

TABLE = "groups"
FAN = 8


def live_feed(raw: DataFrame, **rules) -> DataFrame:
    """Requests as feed rows, row by row: no dimension, no shuffle."""
    events = decode_requests(apply_rules(accepted(triage(raw, **rules))))
    return events.select(
        "id",
        "file",
        "line",
        "message",
        F.col("received_at").alias("date"),
        "type",
        "version",
        "platform",
        text.fingerprint(F.col("message"), F.col("line")).alias("hash"),
    )


def _counts():
    return [
        F.count(F.lit(1)).alias("times"),
        F.min("id").alias("first_id"),
        F.min("date").alias("first_report"),
        F.max("date").alias("last_report"),
    ]


def live_message_summary(feed: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("message", "file", "line", "type", "version", "platform"), "id")
    groups = feed.groupBy("hash").agg(last.alias("last"), *_counts())
    return groups.select("*", "last.*").drop("last").withColumn("severity", text.severity(F.col("times")))


def live_browser_versions(feed: DataFrame) -> DataFrame:
    return feed.groupBy("type", F.lower("version").alias("version_key")).agg(*_counts())


def browser_summary(versions: DataFrame) -> DataFrame:
    """Browser types from the current rows of ``live_browser_versions``."""
    return versions.groupBy("type").agg(
        F.count(F.lit(1)).alias("versions"),
        F.sum("times").alias("times"),
        F.min("first_id").alias("first_id"),
        F.min("first_report").alias("first_report"),
        F.max("last_report").alias("last_report"),
    )


def live_script_summary(feed: DataFrame) -> DataFrame:
    return feed.groupBy("file").agg(*_counts())


def _read(spark, path, parts):
    return spark.read.parquet(*[f"{path.rstrip('/')}/{TABLE}/folder={part.folder}" for part in parts])


def _write(rows, path, level, batches):
    part = Part(TABLE, f"{level}-{uuid.uuid4().hex}", level, batches=runs(batches))
    rows.write.parquet(f"{path.rstrip('/')}/{TABLE}/folder={part.folder}")
    return part


def start_live(
    summary: DataFrame, path: str, checkpoint: str, keys, trigger: dict | None = None, mode: str = "update", fan: int = FAN
) -> StreamingQuery:
    """Keeps the latest row of every group, named by ``keys``, under the path.

    "update" writes the groups that changed, so the cost follows the arrivals; "complete" writes all
    groups every time, in place of all before. A micro-batch that is run again replaces what it wrote.
    """

    def store(batch, batch_id):
        log = Log(batch.sparkSession, path)
        base = log.latest()
        merged = [part for part in base.parts if part.holds(batch_id) and part.level]
        if merged:  # committed and merged before the stream could note that it was done
            return
        part = _write(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), path, 0, [batch_id])
        base = log.commit(base, [part], [p for p in base.parts if mode == "complete" or p.holds(batch_id)])
        _compact(batch.sparkSession, log, base, path, list(keys), fan)

    return (
        summary.writeStream.foreachBatch(store)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def _compact(spark: SparkSession, log: Log, manifest: Manifest, path: str, keys: list, fan: int) -> None:
    while True:
        levels = {}
        for part in sorted(manifest.parts, key=lambda part: part.batches):
            levels.setdefault(part.level, []).append(part)
        crowded = [parts[:fan] for parts in levels.values() if len(parts) > fan]
        if not crowded:
            return
        parts = crowded[0]
        rows = _latest(_read(spark, path, parts), keys)
        merged = _write(rows, path, parts[0].level + 1, [run for part in parts for run in part.batches])
        manifest = log.commit(manifest, [merged], parts)


def _latest(rows: DataFrame, keys: list) -> DataFrame:
    """Of every group the row of the last micro-batch."""
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_latest")).select(*keys, "_latest.*")


def current(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The latest state of every group."""
    parts = Log(spark, path).latest().parts
    if not parts:
        raise FileNotFoundError(f"PATH_NOT_FOUND: no micro-batch was committed under {path}")
    return _latest(_read(spark, path, parts), list(keys)).drop("batch_id")
