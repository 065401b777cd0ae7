"""Browser types since their newest version first appeared, kept up to date while requests arrive.

The state is keyed by type and version and lies in committed parts (``sources.log``), rows of fixed width. A type's
cut is the id with which its newest version began. Every micro-batch counts its rows by version on either side of the
cut as known then. When a newer version comes, the cut moves up and what lay above the old cut is withdrawn: its
last id is below the new one, so it is left out when read, and nothing is rewritten.

Only requests that arrive out of order can tear a count, so that some of its ids lie below the cut and some above: a
version whose first request comes late moves the cut down, or up into ids that were counted together. Times of such a
type are taken again from its rows (type, version, id and date of every request are kept, clustered by id once
merged), from the cut on. In order, rows are never read.

Parts are merged in levels as in ``live``. The number of types is that of the user-agent rules, so a table of cuts is small.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from errorloom.sources.log import Log, Part, runs

ROWS, GROUPS = "rows", "groups"
FAN = 8

SCHEMAS = {
    ROWS: "type string, version_key string, id bigint, date timestamp_ntz",
    GROUPS: "type string, version_key string, times bigint, first_id bigint, last_id bigint,"
    " first_report timestamp_ntz, last_report timestamp_ntz",
}


def _read(spark, path, table, parts):
    folders = [f"{path.rstrip('/')}/{table}/folder={part.folder}" for part in parts]
    return spark.read.schema(SCHEMAS[table]).parquet(*folders) if folders else spark.createDataFrame([], SCHEMAS[table])


def _write(rows, path, table, level, batches):
    part = Part(table, f"{level}-{uuid.uuid4().hex}", level, batches=runs(batches))
    rows.write.parquet(f"{path.rstrip('/')}/{table}/folder={part.folder}")
    return part


def _as_groups(rows):
    return rows.select(
        "type",
        "version_key",
        F.lit(1).cast("bigint").alias("times"),
        F.col("id").alias("first_id"),
        F.col("id").alias("last_id"),
        F.col("date").alias("first_report"),
        F.col("date").alias("last_report"),
    )


def _merged(groups, *keys):
    return groups.groupBy("type", "version_key", *keys).agg(
        F.sum("times").alias("times"),
        F.min("first_id").alias("first_id"),
        F.max("last_id").alias("last_id"),
        F.min("first_report").alias("first_report"),
        F.max("last_report").alias("last_report"),
    )


def _types(groups):
    return _merged(groups).groupBy("type").agg(
        F.sum("times").alias("times"),
        F.count(F.lit(1)).alias("versions"),
        F.min("first_id").alias("first_id"),
        F.max("first_id").alias("cut"),
    )


def _with_cut(rows, cuts):
    """Rows of the types in ``cuts``, with the cut."""
    named = F.broadcast(cuts.select(F.col("type").alias("_type"), "cut"))
    return rows.join(named, F.col("type").eqNullSafe(F.col("_type"))).drop("_type")


def _by_side(groups, cuts):
    """Groups merged by version and side of the cut, so that merging tears nothing that was whole."""
    side = F.when(F.col("first_id") >= F.col("cut"), 1).when(F.col("last_id") < F.col("cut"), -1).otherwise(0)
    return _merged(_with_cut(groups, cuts).withColumn("_side", side), "_side").drop("_side")


def start_newest(feed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fan: int = FAN) -> StreamingQuery:
    """Counts a stream of feed rows (``live.live_feed``) under the path.

    A micro-batch that is run again replaces what it wrote. Versions that differ in case are one.
    """

    def store(batch, batch_id):
        spark = batch.sparkSession
        log = Log(spark, path)
        base = log.latest()
        if any(part.level and part.holds(batch_id) for part in base.parts):
            return  # committed and merged before the stream could note that it was done
        narrow = batch.select("type", F.lower("version").alias("version_key"), "id", "date")
        rows_part = _write(narrow, path, ROWS, 0, [batch_id])
        arrived = _as_groups(_read(spark, path, ROWS, [rows_part]))
        earlier = _read(spark, path, GROUPS, [part for part in base.of(GROUPS) if not part.holds(batch_id)])
        groups = _by_side(arrived, _types(earlier.unionByName(arrived)))
        groups_part = _write(groups, path, GROUPS, 0, [batch_id])
        base = log.commit(base, [rows_part, groups_part], [part for part in base.parts if part.holds(batch_id)])
        for table in (GROUPS, ROWS):
            base = _compact(spark, log, base, path, table, fan)

    return (
        feed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def _compact(spark, log, manifest, path, table, fan):
    while True:
        levels = {}
        for part in sorted(manifest.of(table), key=lambda part: part.batches):
            levels.setdefault(part.level, []).append(part)
        crowded = [parts[:fan] for parts in levels.values() if len(parts) > fan]
        if not crowded:
            return manifest
        parts = crowded[0]
        rows = _read(spark, path, table, parts)
        if table == GROUPS:
            rows = _by_side(rows, _types(_read(spark, path, GROUPS, manifest.of(GROUPS))))
        else:
            rows = rows.repartitionByRange("id").sortWithinPartitions("id")
        batches = [run for part in parts for run in part.batches]
        manifest = log.commit(manifest, [_write(rows, path, table, parts[0].level + 1, batches)], parts)


def since_newest(spark: SparkSession, path: str) -> DataFrame:
    """What ``summaries.browser_summary_since_newest_version`` gives for all requests counted so far."""
    manifest = Log(spark, path).latest()
    if not manifest.parts:
        raise FileNotFoundError(f"PATH_NOT_FOUND: no micro-batch was committed under {path}")
    groups = _read(spark, path, GROUPS, manifest.of(GROUPS))
    types = _types(groups)
    sided = _with_cut(groups, types)
    whole = sided.where("first_id >= cut").select("type", "first_report", "last_report")
    torn = sided.where("first_id < cut and last_id >= cut").groupBy("type").agg(F.max("cut").alias("cut"))
    lowest = torn.agg(F.min("cut")).first()[0]
    if lowest is not None:
        rows = _read(spark, path, ROWS, manifest.of(ROWS)).where(F.col("id") >= lowest)
        again = _with_cut(rows, torn).where("id >= cut")
        whole = whole.unionByName(again.select("type", F.col("date").alias("first_report"), F.col("date").alias("last_report")))
    spans = whole.groupBy(F.col("type").alias("_type")).agg(
        F.min("first_report").alias("first_report"), F.max("last_report").alias("last_report")
    )
    return types.join(spans, F.col("type").eqNullSafe(F.col("_type"))).select(
        "type", "times", "versions", "first_id", "first_report", "last_report"
    )
