"""The (type, version) dimension: get-or-create, and the lookups against it.

The dimension is small by nature, but its versions come from outside, so lookups measure it first
and broadcast it only within a bound.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.operators.lookups import BROADCAST_BYTES, join_lookup

UNKNOWN = "unknown"
KEYS = ("type_key", "version_key")


def _with_keys(df):
    # One dimension row per spelling-insensitive pair.
    return df.withColumns({"type_key": F.lower("type"), "version_key": F.lower("version")})


def first_appearances(events: DataFrame) -> DataFrame:
    """Per pair as spelled: the smallest event ``id`` and its time. Hash-aggregates per task first."""
    return events.groupBy("type", "version").agg(
        F.min("id").alias("id"), F.min("received_at").alias("received_at")
    )


def new_browsers(events: DataFrame, browsers: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """The dimension rows that the events add: id, type, version, date.

    Pairs are equal regardless of case and keep the spelling seen first. A new row's id is the id of
    the event that brought it, plus the highest id in ``above`` (by default all of ``browsers``):
    unique and in order of appearance without numbering all new rows in one task, and the same
    whenever a batch is replayed.
    """
    spellings = _with_keys(first_appearances(events))
    pairs = spellings.groupBy(*KEYS).agg(
        F.min_by(F.struct("type", "version"), "id").alias("pair"),
        F.min("id").alias("first_id"),
        F.min("received_at").alias("date"),
    )
    highest = F.coalesce((browsers if above is None else above).select(F.max("id")).scalar(), F.lit(0))
    return pairs.join(_with_keys(browsers).select(*KEYS), list(KEYS), "left_anti").select(
        (highest + F.col("first_id")).cast("bigint").alias("id"),
        F.col("pair.type").alias("type"),
        F.col("pair.version").alias("version"),
        "date",
    )


def ids_by_pair(browsers: DataFrame) -> DataFrame:
    """The smallest id of every pair, as ``browser``."""
    return _with_keys(browsers).groupBy(*KEYS).agg(F.min("id").cast("bigint").alias("browser"))


def names_by_id(browsers: DataFrame) -> DataFrame:
    """One (type, version) per id; the id is called ``browser``."""
    return browsers.groupBy(F.col("id").alias("browser")).agg(
        F.min(F.struct("type", "version")).alias("named")
    )


def _or_unknown(rows):
    return rows.withColumns(
        {
            "type": F.coalesce(F.col("named.type"), F.lit(UNKNOWN)),
            "version": F.coalesce(F.col("named.version"), F.lit(UNKNOWN)),
        }
    ).drop("named")


def attach_browser_id(
    events: DataFrame, browsers: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Replaces ``type`` and ``version`` of every event with ``browser``, the pair's smallest id."""
    joined = join_lookup(
        _with_keys(events), ids_by_pair(browsers), list(KEYS), "inner", max_lookup_bytes
    )
    return joined.drop(*KEYS, "type", "version")


def name_browser(
    reports: DataFrame, browsers: DataFrame, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds ``type`` and ``version`` to every report; "unknown" where the dimension has no row."""
    return _or_unknown(
        join_lookup(reports, names_by_id(browsers), ["browser"], "left", max_lookup_bytes)
    )


def name_browser_ids(ids: DataFrame, browsers: DataFrame) -> DataFrame:
    """The same for rows of which each browser id has one: no key is hot, so Spark may choose."""
    return _or_unknown(ids.join(names_by_id(browsers), "browser", "left"))
