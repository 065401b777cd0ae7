"""Marking stored errors as fixed, or deleting them, without rewriting reports.

A resolution lists fingerprints and covers every report that was stored before it; the same error reported later is open
again. It is a small table. Readers join it to reports and tallies by fingerprint (merge on read): whole tally
rows drop out, as a batch's tallies are either older than the resolution or younger. Compaction
applies it for good to what it merges.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorloom.config import Config
from errorloom.functions import text, times
from errorloom.operators.lookups import BROADCAST_BYTES, join_lookup
from errorloom.operators.manage import RESOLVED
from errorloom.sources.log import Log, Manifest
from errorloom.sources.tables import read_parts, write_part

FIXED, DELETED = "fixed", "deleted"


def resolve_stored(spark: SparkSession, config: Config, hashes: DataFrame, as_of, action: str = FIXED) -> Manifest:
    """Marks what is stored now under the fingerprints ``hash`` as fixed, or takes it out if the action is ``DELETED``.

    ``as_of`` is noted as the time. Null fingerprints are ignored, repeated ones count once; doing it twice changes nothing.
    """
    if action not in (FIXED, DELETED):
        raise ValueError(f"action must be {FIXED!r} or {DELETED!r}, not {action!r}")
    rows = hashes.select("hash").where("hash is not null").distinct().select(
        "hash", F.lit(action).alias("action"), F.lit(None).cast("bigint").alias("through"), times.wall_clock(as_of).alias("date")
    )
    part = write_part(rows, config.write_uri, "resolutions")
    log = Log(spark, config.write_uri)
    return log.commit(log.latest(), [part])


def _since(parts):
    """The version that committed each row, by its folder."""
    return F.element_at(F.create_map(*[F.lit(x) for part in parts for x in (part.folder, part.since)]), F.col("folder"))


def _with_through(spark, uri, parts):
    rows = read_parts(spark, uri, "resolutions", parts)
    return rows.withColumn("through", F.coalesce("through", _since(parts))) if parts else rows


def by_hash(spark: SparkSession, uri: str, manifest: Manifest) -> DataFrame:
    """Per fingerprint the last version that fixed it and the last that deleted it."""
    last = lambda action: F.max(F.when(F.col("action") == action, F.col("through")))
    rows = _with_through(spark, uri, manifest.of("resolutions"))
    return rows.groupBy("hash").agg(last(FIXED).alias("_fixed"), last(DELETED).alias("_deleted"))


def resolved(
    spark: SparkSession, uri: str, name: str, parts, manifest: Manifest, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows of some parts as they are now: deleted reports are gone and fixed ones have the status for it; of
    tallies, which count open reports, both are gone."""
    if name == "resolutions":
        return _with_through(spark, uri, parts).drop("folder")
    rows = read_parts(spark, uri, name, parts)
    if name not in ("reports", "tallies") or not parts or not manifest.of("resolutions"):
        return rows.drop("folder")
    columns = [column for column in rows.columns if column != "folder"]
    marked = rows.withColumns({"hash": text.fingerprint(F.col("message"), F.col("line")), "_since": _since(parts)})
    joined = join_lookup(marked, by_hash(spark, uri, manifest), ["hash"], "left", max_lookup_bytes)
    hit = lambda column: F.coalesce(F.col(column) > F.col("_since"), F.lit(False))
    if name == "tallies":
        return joined.where(~hit("_fixed") & ~hit("_deleted")).select(*columns)
    status = F.when(hit("_fixed"), F.lit(RESOLVED)).otherwise(F.col("status"))
    return joined.where(~hit("_deleted")).withColumn("status", status).select(*columns)


def stored(spark: SparkSession, uri: str, name: str, manifest: Manifest | None = None) -> DataFrame:
    """A whole table with all resolutions applied, as of a version."""
    manifest = manifest or Log(spark, uri).latest()
    return resolved(spark, uri, name, manifest.of(name), manifest)
