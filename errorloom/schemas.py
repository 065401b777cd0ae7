"""Explicit schemas of every table. Nothing is inferred.

Timestamps are ``timestamp_ntz``: wall-clock time in the one zone the deployment has agreed on
(UTC in the tests), so no result depends on a session's time zone.
"""

from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _table(*fields):
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


# One request as the web tier logged it. ``id`` is unique and grows in arrival order.
RAW_BEACONS = _table(
    ("id", LongType(), False),
    ("received_at", TimestampNTZType(), True),
    ("query_string", StringType(), True),
    ("user_agent", StringType(), True),
    ("xff", StringType(), True),
    ("remote_addr", StringType(), True),
)

# One row per accepted error event. ``status`` 0 is open; ``ip`` is an IPv4 address as 0..2^32-1.
REPORTS = _table(
    ("id", LongType(), False),
    ("file", StringType(), True),
    ("line", IntegerType(), True),
    ("message", StringType(), True),
    ("browser", LongType(), True),
    ("status", IntegerType(), True),
    ("date", TimestampNTZType(), True),
    ("ip", LongType(), True),
    ("platform", StringType(), True),
)

# The (type, version) dimension; ``date`` is when the pair was first seen.
BROWSERS = _table(
    ("id", LongType(), False),
    ("type", StringType(), True),
    ("version", StringType(), True),
    ("date", TimestampNTZType(), True),
)

# Requests that could not become a report, with the reason.
REJECTS = _table(
    ("id", LongType(), False),
    ("date", TimestampNTZType(), True),
    ("ip", LongType(), True),
    ("reject_reason", StringType(), True),
)

# What the rules made of each user agent, and which rules they were.
AGENTS = _table(
    ("user_agent", StringType(), False),
    ("type", StringType(), True),
    ("version", StringType(), True),
    ("platform", StringType(), True),
    ("rules", StringType(), False),
)

# Fingerprints that were fixed or deleted. ``through`` is the version up to which that goes, null until parts are
# merged: then it is the version that committed the part.
RESOLUTIONS = _table(
    ("hash", StringType(), False),
    ("action", StringType(), False),
    ("through", LongType(), True),
    ("date", TimestampNTZType(), True),
)

# Triaged and decoded requests of one batch, while it is being written.
STAGED = _table(
    ("id", LongType(), False),
    ("received_at", TimestampNTZType(), True),
    ("ip", LongType(), True),
    ("reject_reason", StringType(), True),
    ("user_agent", StringType(), True),
    ("message", StringType(), True),
    ("file", StringType(), True),
    ("line", IntegerType(), True),
)

# Partial counts of open reports, see ``operators.tallies``.
TALLIES = _table(
    ("message", StringType(), True),
    ("line", IntegerType(), True),
    ("file", StringType(), True),
    ("browser", LongType(), True),
    ("platform", StringType(), True),
    ("times", LongType(), False),
    ("first_id", LongType(), True),
    ("last_id", LongType(), True),
    ("first_report", TimestampNTZType(), True),
    ("last_report", TimestampNTZType(), True),
)
