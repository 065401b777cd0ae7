"""Fingerprints and display strings of a report."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def fingerprint(message: Column, line: Column) -> Column:
    """md5 of message and line with nothing between them.

    Equal errors in two files share a fingerprint, and ("a1", 2) shares one with ("a", 12).
    """
    return F.md5(F.concat(message, line.cast("string")))


def strict_fingerprint(file: Column, line: Column, message: Column) -> Column:
    """md5 over file, line and message, kept apart by a control character."""
    return F.md5(F.concat_ws("\u0001", file, line.cast("string"), message))


def severity(times: Column, danger_at: int = 3) -> Column:
    return F.when(times >= danger_at, "danger").otherwise("warning")


def icon_key(browser_type: Column) -> Column:
    key = F.lower(browser_type)
    return F.when(key == "internet explorer", "ie").otherwise(key)


def location(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))


def browser_label(browser_type: Column, version: Column) -> Column:
    return F.concat_ws(" ", browser_type, version)


def submissions_label(times: Column, versions: Column) -> Column:
    return F.format_string("%d (%d vers)", times, versions)
