"""Looking after known errors."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errorloom.functions import net, text
from errorloom.operators.browsers import name_browser
from errorloom.operators.feed import only_open
from errorloom.operators.lookups import BROADCAST_BYTES, cut_lineage, join_lookup
from errorloom.operators.tallies import regroup, tally

RESOLVED = 1


def _marked(reports):
    return reports.withColumn("hash", text.fingerprint(F.col("message"), F.col("line")))


def resolve(reports: DataFrame, hashes: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The reports, those with a listed fingerprint marked as fixed."""
    listed = hashes.select("hash", F.lit(True).alias("_hit")).distinct()
    status = F.when(F.col("_hit"), F.lit(RESOLVED)).otherwise(F.col("status"))
    joined = join_lookup(_marked(reports), listed, ["hash"], "left", max_lookup_bytes, costly=True)
    return joined.withColumn("status", status).select(*reports.columns)


def delete(reports: DataFrame, hashes: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The reports without those that have a listed fingerprint."""
    listed = hashes.select("hash").distinct()
    kept = join_lookup(_marked(reports), listed, ["hash"], "left_anti", max_lookup_bytes, costly=True)
    return kept.select(*reports.columns)


def message_browsers(tallies: DataFrame) -> DataFrame:
    """Affected browser ids per fingerprint, as "1,2,3". Takes tallies by message, line, browser.

    A list is at most as long as the browser dimension: for display. ``affected_browsers`` counts without lists.
    """
    marked = tallies.withColumn("hash", text.fingerprint(F.col("message"), F.col("line")))
    per_browser = regroup(marked, "hash", "browser")
    ids = F.transform(F.sort_array(F.collect_list("browser")), lambda id_: id_.cast("string"))
    return per_browser.groupBy("hash").agg(
        F.sum("times").alias("times"), F.array_join(ids, ",").alias("browsers")
    )


def number_browsers(browsers: DataFrame) -> DataFrame:
    """``browser`` and a dense ``number`` from 1 in order of ids, without bringing the dimension into one task.

    Ids are sorted into ranges and numbered within each; only the sizes of the ranges are added up in one place.
    """
    inside = Window.partitionBy("_range").orderBy("browser")
    ids = browsers.select(F.col("id").alias("browser")).where("browser is not null").distinct()
    # Written, as ranges come from a sample and would differ if they were drawn again.
    ranged = cut_lineage(ids.repartitionByRange("browser").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(inside)).join(F.broadcast(offsets), "_range")
    return placed.select("browser", (F.col("_before") + F.col("_place")).alias("number"))


def affected_browsers(tallies: DataFrame, numbers: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Affected browsers per fingerprint as bitmaps: hash, bucket, ``bits`` and times. Takes tallies by message, line, browser.

    A bitmap is of fixed size, one for every 32,768 numbers of browsers, so no group holds a list. Browsers that have no
    number are counted in ``times`` under the null bucket.
    """
    marked = tallies.withColumn("hash", text.fingerprint(F.col("message"), F.col("line")))
    numbered = join_lookup(regroup(marked, "hash", "browser"), numbers, ["browser"], "left", max_lookup_bytes)
    return numbered.groupBy("hash", F.expr("bitmap_bucket_number(number)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits"), F.sum("times").alias("times")
    )


def merge_affected(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps of several batches, by one numbering, as one."""
    return bitmaps.groupBy("hash", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"), F.sum("times").alias("times"))


def affected_counts(bitmaps: DataFrame) -> DataFrame:
    """How many browsers each fingerprint affects, and how often it was reported."""
    return bitmaps.groupBy("hash").agg(
        F.sum(F.when(F.col("bucket").isNull(), F.lit(0)).otherwise(F.expr("bitmap_count(bits)"))).cast("bigint").alias("browsers"),
        F.sum("times").alias("times"),
    )


def strict_messages(reports: DataFrame) -> DataFrame:
    """Open reports merged only if file, line and message all agree."""
    key = text.strict_fingerprint(F.col("file"), F.col("line"), F.col("message"))
    return tally(reports, "file", "line", "message").select(
        key.alias("hash"), "file", "line", "message", "times", "first_report", "last_report"
    )


def affected(
    reports: DataFrame,
    browsers: DataFrame,
    browser: str | None = None,
    ip: str | None = None,
    file: str | None = None,
    line: int | None = None,
) -> DataFrame:
    """Who met the errors: open reports per client address, narrowed by any of the arguments."""
    rows = only_open(reports)
    if ip is not None:
        rows = rows.where(F.col("ip") == net.dotted_to_long(F.lit(ip)))
    if file is not None:
        rows = rows.where(F.col("file") == file)
    if line is not None:
        rows = rows.where(F.col("line") == line)
    if browser is None:
        clients = tally(rows, "ip")
    else:
        # Counted per browser id first, so the lookup sees counts and not reports.
        per_browser = name_browser(tally(rows, "ip", "browser"), browsers)
        clients = regroup(per_browser.where(F.col("type") == browser), "ip")
    return clients.select(
        net.long_to_dotted(F.col("ip")).alias("ip"), "times", "first_report", "last_report"
    )


def daily_digest(reports: DataFrame) -> DataFrame:
    """Open reports per day and fingerprint."""
    days = only_open(reports).withColumn("day", F.to_date("date"))
    marked = tally(days, "day", "message", "line").withColumn(
        "hash", text.fingerprint(F.col("message"), F.col("line"))
    )
    return regroup(marked, "day", "hash", message=F.max_by("message", "last_id")).select(
        "day", "hash", "message", "times", "first_report", "last_report"
    )
