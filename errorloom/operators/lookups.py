"""Joining a lookup table to all rows, by a way that its measured size decides."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.config import shared_folder

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 64


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that losing an executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured_bytes(df: DataFrame) -> int:
    """The rows' length as text, nested fields included, plus a fixed share per row.

    Added up on the executors; one number reaches the driver.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns))) + ROW_BYTES
    return df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def join_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list,
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    costly: bool = False,
) -> DataFrame:
    """Joins every row to a table with at most one row per key.

    The table is measured and broadcast if it stays within the bound. Beyond it both sides are shuffled by
    the keys, and adaptive execution splits those that are hot: it reads such a partition of the rows in several tasks
    and gives each the table's partition, so only what is hot is read more than once. For that the table has
    to come from a shuffle of its own, hence it is written first. A ``costly`` table is written in any case.
    """
    table = cut_lineage(table) if costly else table
    if measured_bytes(table) <= max_bytes:
        return rows.join(F.broadcast(table), keys, how)
    return rows.join(table if costly else cut_lineage(table), keys, how)
