"""Time columns that give the same result in every session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def start_of_hour(ts: Column) -> Column:
    # date_trunc would pass a timestamp_ntz through the session's zone and its clock changes.
    into_the_hour = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts)
    )
    return ts - into_the_hour


def whole_hours(start: Column, end: Column) -> Column:
    """Complete hours from ``start`` to ``end``."""
    return (end - start).cast("interval hour").cast("bigint")


def wall_clock(text) -> Column:
    """An ``as_of`` argument (text, datetime or column) as ``timestamp_ntz``."""
    return (text if isinstance(text, Column) else F.lit(text)).cast("timestamp_ntz")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970-01-01, reading the wall-clock time as UTC."""
    since = (ts - wall_clock("1970-01-01 00:00:00")).cast("interval second")
    return F.floor(since.cast("decimal(20,6)") * 1000).cast("bigint")
