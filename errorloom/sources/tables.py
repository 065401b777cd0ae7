"""The stored tables: parquet, in parts that the commit log names (``sources.log``).

A batch owns its parts, which committing it again replaces as a whole, days that the new rows do not have and
an empty result included. So a batch that is run twice, after a lost driver, a replay of the stream or with
other settings, leaves one copy, and one that fails half way leaves what was there before.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructType

from errorloom import schemas
from errorloom.sources.log import Log, Manifest, Part, runs


@dataclass(frozen=True)
class Table:
    schema: StructType
    by_batch: bool = True  # rows carry their batch_id, so that a batch can be found in merged parts
    by_day: bool = False  # also partitioned by day, for pruning


TABLES = {
    "reports": Table(schemas.REPORTS, by_day=True),
    "browsers": Table(schemas.BROWSERS),
    "rejects": Table(schemas.REJECTS),
    "agents": Table(schemas.AGENTS),
    "tallies": Table(schemas.TALLIES, by_batch=False),
    "resolutions": Table(schemas.RESOLUTIONS, by_batch=False),
}
SCHEMAS = {name: table.schema for name, table in TABLES.items()}


class SealedBatch(ValueError):
    """The batch was merged with others and can no longer be replaced."""


def location(uri: str, name: str) -> str:
    return f"{uri.rstrip('/')}/{name}"


def part_location(uri: str, part: Part) -> str:
    return f"{location(uri, part.table)}/folder={part.folder}"


def write_part(
    df: DataFrame, uri: str, name: str, batches=(), gather_days: bool = False, level: int = 0
) -> Part:
    """Writes rows to a folder of their own, which counts once it is committed.

    ``df`` has the table's columns, and batch_id if several ``batches`` are merged. ``gather_days`` first brings the
    rows of a day together, for input in which every file holds many days and would otherwise leave as many small
    files. A big day is spread over several tasks.
    """
    table, batches = TABLES[name], runs(batches)
    part = Part(name, f"{level}-{uuid.uuid4().hex}", level, batches=batches)
    rows = df
    if table.by_batch and level == 0:
        rows = rows.withColumn("batch_id", F.lit(batches[0][0]).cast("bigint"))
    rows = rows.select(*table.schema.fieldNames(), *(["batch_id"] if table.by_batch else []))
    if table.by_day:
        rows = rows.withColumn("day", F.to_date("date"))
        if gather_days:
            rows = rows.hint("rebalance", "day")
    rows.write.partitionBy(*(["day"] if table.by_day else [])).parquet(part_location(uri, part))
    return part


def commit_batch(spark: SparkSession, uri: str, batch_id: int, parts) -> Manifest:
    """Makes the parts the batch's, in all their tables at once, in place of those it had."""
    log = Log(spark, uri)
    base = log.latest()
    names = {part.table for part in parts}
    check_open(base, batch_id, names)
    old = {part.table: part for part in base.parts if part.table in names and part.holds(batch_id)}
    # Rows that replace others are as old as those, which decides what a resolution covers.
    kept_age = [
        Part(p.table, p.folder, p.level, old[p.table].since if p.table in old else 0, p.batches) for p in parts
    ]
    return log.commit(base, kept_age, old.values())


def check_open(manifest: Manifest, batch_id: int, names) -> None:
    for part in manifest.parts:
        if part.table in names and part.level > 0 and part.holds(batch_id):
            raise SealedBatch(f"batch {batch_id} of {part.table} has been merged with others; load corrections as a new batch")


def write_batch(
    df: DataFrame, uri: str, name: str, batch_id: int, gather_days: bool = False
) -> None:
    """Writes and commits the batch's rows of one table."""
    part = write_part(df, uri, name, [int(batch_id)], gather_days)
    commit_batch(df.sparkSession, uri, int(batch_id), [part])


def read_parts(spark: SparkSession, uri: str, name: str, parts) -> DataFrame:
    """The rows of some parts, with all stored columns and ``folder``. Other parts are not even listed."""
    table = TABLES[name]
    schema = StructType(list(table.schema.fields))
    if table.by_batch:
        schema = schema.add("batch_id", LongType())
    schema = schema.add("folder", StringType())
    if table.by_day:
        schema = schema.add("day", DateType())
    if not parts:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", location(uri, name))
    return reader.parquet(*[part_location(uri, part) for part in parts]).select(*schema.fieldNames())


def read_table(
    spark: SparkSession,
    uri: str,
    name: str,
    before_batch: int | None = None,
    batch: int | None = None,
    missing_ok: bool = False,
    manifest: Manifest | None = None,
) -> DataFrame:
    """The table's columns, of all batches, of earlier ones, or of one; ``reports`` has batch_id and day too.

    With a ``manifest``, as of that version, so that several tables are read as of the same moment. A table that was never
    written is an error, or with ``missing_ok`` empty.
    """
    table = TABLES[name]
    parts = (manifest or Log(spark, uri).latest()).of(name)
    if not parts and not missing_ok:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {location(uri, name)} was never written")
    if batch is not None:
        parts = [part for part in parts if part.holds(batch)]
    if before_batch is not None:
        parts = [part for part in parts if part.batches[0][0] < before_batch]
    rows = read_parts(spark, uri, name, parts)
    if table.by_batch and batch is not None:
        rows = rows.where(F.col("batch_id") == batch)
    if table.by_batch and before_batch is not None:
        rows = rows.where(F.col("batch_id") < before_batch)
    return rows.drop("folder") if table.by_day else rows.select(*table.schema.fieldNames())
