"""Browser types since their newest version, on streams in and out of order, against plain Python."""

import random
from datetime import timedelta

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from builders import START
from errorloom.sources.log import Log
from errorloom.streaming import newest

NOW = {"availableNow": True}
FEED = StructType(
    [
        StructField("id", LongType()),
        StructField("type", StringType()),
        StructField("version", StringType()),
        StructField("date", TimestampNTZType()),
    ]
)


def brute(rows):
    out = []
    for kind in {row[1] for row in rows}:
        own = [row for row in rows if row[1] == kind]
        firsts = {}
        for id_, _, version, _ in own:
            key = version and version.lower()
            firsts[key] = min(id_, firsts.get(key, id_))
        cut = max(firsts.values())
        dates = [row[3] for row in own if row[0] >= cut]
        out.append((kind, len(own), len(firsts), min(firsts.values()), min(dates), max(dates)))
    return sorted(out, key=str)


def random_rows(seed, count=240):
    rng = random.Random(seed)
    rows = []
    for id_ in range(count):
        kind = rng.choice(["Chrome", "Chrome", "Firefox", "Opera", None])
        # Versions come up one after the other, old ones go on being used; spellings differ in case.
        version = rng.choice([None, "A", "a", *"bcdefgh"[: 1 + id_ * 7 // count]])
        date = START + timedelta(minutes=rng.randrange(10_000))
        rows.append((id_, kind, version, date))
    return rows


def stream(spark, slices, source, checkpoint, path, fan=2):
    for rows in slices:
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
        newest.start_newest(feed, path, checkpoint, NOW, fan).awaitTermination()


def found(spark, path):
    return sorted(map(tuple, newest.since_newest(spark, path).collect()), key=str)


@pytest.mark.parametrize("order", ["in order", "shuffled", "backwards"])
def test_since_newest_against_brute_force(spark, tmp_path, order):
    rows = random_rows(order)
    arrived = list(rows)
    if order == "shuffled":
        random.Random(5).shuffle(arrived)
    if order == "backwards":
        arrived.reverse()
    slices = [arrived[at : at + 40] for at in range(0, len(arrived), 40)]
    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for number, part in enumerate(slices):
        stream(spark, [part], source, checkpoint, path)
        if number in (1, 5):
            seen = [row for part in slices[: number + 1] for row in part]
            assert found(spark, path) == brute(seen)
    for table in (newest.GROUPS, newest.ROWS):
        assert len(Log(spark, path).latest().of(table)) <= 4


def test_in_order_rows_are_never_read(spark, tmp_path, monkeypatch):
    rows = random_rows("plain", 120)
    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    stream(spark, [rows[:40], rows[40:80], rows[80:]], source, checkpoint, path)
    tables, read = [], newest._read
    monkeypatch.setattr(newest, "_read", lambda spark, path, table, parts: tables.append(table) or read(spark, path, table, parts))
    assert found(spark, path) == brute(rows)
    assert tables == [newest.GROUPS]


def test_run_again_counts_once(spark, tmp_path):
    rows = random_rows("again", 80)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    stream(spark, [rows], source, str(tmp_path / "cp"), path)
    feed = spark.readStream.schema(FEED).parquet(source)
    newest.start_newest(feed, path, str(tmp_path / "lost"), NOW).awaitTermination()
    assert found(spark, path) == brute(rows)


def test_nothing_counted(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        newest.since_newest(spark, str(tmp_path / "none"))
    stream(spark, [[]], str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "out"))
