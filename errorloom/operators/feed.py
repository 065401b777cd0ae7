"""The open-error feed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.functions import net, text
from errorloom.operators.browsers import name_browser
from errorloom.operators.lookups import BROADCAST_BYTES

OPEN = 0


def only_open(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("status") == OPEN)


def open_reports(
    reports: DataFrame, browsers: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every open report with its browser, dotted address and fingerprint.

    Reports are not shuffled, unless the browser dimension outgrows the bound.
    """
    return name_browser(only_open(reports), browsers, max_lookup_bytes).select(
        "id",
        "file",
        "line",
        "message",
        "date",
        F.struct("type", "version").alias("browser"),
        "status",
        net.long_to_dotted(F.col("ip")).alias("ip"),
        "platform",
        text.fingerprint(F.col("message"), F.col("line")).alias("hash"),
    )


def feed_json(feed: DataFrame) -> DataFrame:
    """``id`` and ``json``, one object per report. The scalar fields are text, as feed readers expect."""
    fields = []
    for name in feed.columns:
        field = F.col(name) if name == "browser" else F.col(name).cast("string")
        # Whole seconds, without a detour through the session's time zone.
        fields.append((F.substring(field, 1, 19) if name == "date" else field).alias(name))
    return feed.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def export_json(feed: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes the feed as lines of JSON."""
    feed_json(feed).select("json").write.mode("overwrite").option("compression", compression).text(path)


def display_labels(feed: DataFrame) -> DataFrame:
    return feed.select(
        "id",
        text.icon_key(F.col("browser.type")).alias("icon_key"),
        text.location(F.col("file"), F.col("line")).alias("location"),
        text.browser_label(F.col("browser.type"), F.col("browser.version")).alias("browser_label"),
    )


def in_display_order(df: DataFrame, first_id: str = "first_id") -> DataFrame:
    """Groups in order of their first report: a range-partitioned sort."""
    return df.orderBy(first_id)
