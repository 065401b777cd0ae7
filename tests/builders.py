"""Small tables for the tests."""

from datetime import datetime, timedelta

from errorloom import schemas

START = datetime(2024, 1, 10, 8, 30)


def raw(spark, *rows):
    """Rows are dicts; what they leave out gets a harmless value."""
    return spark.createDataFrame(
        [
            (
                row.get("id", number + 1),
                row.get("received_at", START + timedelta(minutes=number)),
                row.get("query_string", "message=m&url=u&line=1"),
                row.get("user_agent", "Mozilla/5.0 (Windows NT 6.1; rv:21.0) Gecko/2010 Firefox/21.0"),
                row.get("xff"),
                row.get("remote_addr", "192.0.2.1"),
            )
            for number, row in enumerate(rows)
        ],
        schemas.RAW_BEACONS,
    )


def reports(spark, *rows):
    return spark.createDataFrame(
        [
            (
                row.get("id", number + 1),
                row.get("file", "a.js"),
                row.get("line", 1),
                row.get("message", "m"),
                row.get("browser", 1),
                row.get("status", 0),
                row.get("date", START + timedelta(minutes=number)),
                row.get("ip", 167_772_161),
                row.get("platform", "Linux"),
            )
            for number, row in enumerate(rows)
        ],
        schemas.REPORTS,
    )


def browsers(spark, *rows):
    return spark.createDataFrame([(*row, START) for row in rows], schemas.BROWSERS)


def dicts(df, *order):
    rows = df.orderBy(*order) if order else df
    return [row.asDict(recursive=True) for row in rows.collect()]


def column(df, name, order="id"):
    return [row[name] for row in df.orderBy(order).collect()]
