import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from builders import START, browsers, dicts, reports
from errorloom.functions import text, times
from errorloom.operators import feed, manage, summaries
from errorloom.operators.tallies import regroup, tally


def md5(value):
    return hashlib.md5(value.encode()).hexdigest()


def known(spark):
    return browsers(
        spark, (1, "Chrome", "26"), (2, "Chrome", "27"), (3, "Internet Explorer", "8"), (4, "Chrome", "26")
    )


def test_empty_feed_keeps_its_columns(spark):
    closed = reports(spark, {"status": 1}, {"status": 1})
    rows = feed.open_reports(closed, known(spark))
    assert rows.columns == [
        "id", "file", "line", "message", "date", "browser", "status", "ip", "platform", "hash",
    ]
    assert rows.isEmpty()
    tallies = tally(closed)
    for summary in (
        summaries.message_summary(tallies, known(spark)),
        summaries.browser_summary(tallies, known(spark)),
        summaries.script_summary(tallies),
        summaries.browser_summary_since_newest_version(closed, known(spark)),
    ):
        assert summary.isEmpty()
        assert "times" in summary.columns


def test_severity_turns_at_three(spark):
    rows = reports(spark, *[{"message": "two"}] * 2, *[{"message": "three"}] * 3)
    got = {r["message"]: r for r in dicts(summaries.message_summary(tally(rows), known(spark)))}
    assert (got["two"]["times"], got["two"]["severity"]) == (2, "warning")
    assert (got["three"]["times"], got["three"]["severity"]) == (3, "danger")
    strict = summaries.message_summary(tally(rows), known(spark), danger_at=4)
    assert {r["severity"] for r in dicts(strict)} == {"warning"}


def test_fingerprints_ignore_the_file_and_run_message_and_line_together(spark):
    rows = reports(
        spark,
        {"message": "a1", "line": 2, "file": "x.js", "browser": 2, "platform": "Linux"},
        {"message": "a", "line": 12, "file": "y.js", "browser": 3, "platform": "Apple"},
        {"message": "a", "line": 12, "file": "z.js", "browser": 99, "platform": "Windows"},
    )
    (group,) = dicts(summaries.message_summary(tally(rows), known(spark)))
    assert group["hash"] == md5("a12")
    assert group["times"] == 3
    assert (group["message"], group["line"], group["file"]) == ("a", 12, "z.js")
    assert (group["type"], group["version"], group["platform"]) == ("unknown", "unknown", "Windows")
    assert (group["first_id"], group["first_report"]) == (1, START)
    assert group["last_report"] == START + timedelta(minutes=2)
    assert manage.strict_messages(rows).count() == 3


def test_the_last_report_is_the_one_with_the_greatest_id(spark):
    late, early = START + timedelta(days=1), START
    rows = reports(
        spark,
        {"id": 20, "file": "new.js", "date": early, "browser": 3},
        {"id": 10, "file": "old.js", "date": late},
    )
    (group,) = dicts(summaries.message_summary(tally(rows), known(spark)))
    assert (group["file"], group["type"]) == ("new.js", "Internet Explorer")
    assert (group["first_report"], group["last_report"]) == (early, late)


def test_since_newest_version(spark):
    # Version 26 twice, then 27, then 26 again under another id.
    rows = reports(spark, {"browser": 1}, {"browser": 1}, {"browser": 2}, {"browser": 4})
    (whole,) = dicts(summaries.browser_summary(tally(rows), known(spark)))
    (recent,) = dicts(summaries.browser_summary_since_newest_version(rows, known(spark)))
    assert (whole["times"], whole["versions"]) == (recent["times"], recent["versions"]) == (4, 2)
    assert whole["first_report"] == START
    assert recent["first_report"] == START + timedelta(minutes=2)
    assert whole["last_report"] == recent["last_report"] == START + timedelta(minutes=3)


def test_since_newest_version_without_broadcast(spark):
    rows = reports(spark, *[{"browser": n % 6} for n in range(60)])
    small = summaries.browser_summary_since_newest_version(rows, known(spark))
    large = summaries.browser_summary_since_newest_version(rows, known(spark), max_lookup_bytes=0)
    assert dicts(small, "type") == dicts(large, "type")


def test_versions_and_drill_downs(spark):
    rows = reports(
        spark,
        {"browser": 1, "file": "a.js"},
        {"browser": 4, "file": "a.js", "line": 9},
        {"browser": 2, "file": "b.js"},
        {"browser": 3, "file": "a.js", "status": 1},
        {"browser": 3, "file": "A.js"},
    )
    versions = dicts(summaries.browser_versions(tally(rows), known(spark)), "type", "version")
    assert [(v["type"], v["version"], v["times"]) for v in versions] == [
        ("Chrome", "26", 2),
        ("Chrome", "27", 1),
        ("Internet Explorer", "8", 1),
    ]
    chrome = summaries.browser_versions(tally(rows), known(spark), type="Chrome")
    assert dicts(chrome, "version") == versions[:2]
    details = dicts(summaries.script_details(rows, known(spark), "a.js"), "id")
    assert [(d["id"], d["browser_label"], d["line"]) for d in details] == [
        (1, "Chrome 26", 1),
        (2, "Chrome 26", 9),
    ]
    scripts = dicts(summaries.script_summary(tally(rows)), "first_id")
    assert [(s["file"], s["times"]) for s in scripts] == [("a.js", 2), ("b.js", 1), ("A.js", 1)]


def test_display_order_is_first_seen(spark):
    rows = reports(spark, {"message": "z"}, {"message": "a"}, {"message": "z"}, {"message": "m"})
    shown = feed.in_display_order(summaries.message_summary(tally(rows), known(spark)))
    assert [row.message for row in shown.collect()] == ["z", "a", "m"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Shanghai"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York that day.
        first, last = datetime(2024, 3, 10, 2, 30, 15, 250000), datetime(2024, 3, 11, 2, 29)
        rows = reports(spark, {"date": first}, {"date": last})
        summary = summaries.message_summary(tally(rows), known(spark))
        (group,) = dicts(summaries.with_age(summary, "2024-03-12 00:00:00"))
        assert group["first_hour"] == datetime(2024, 3, 10, 2)
        assert group["last_hour"] == datetime(2024, 3, 11, 2)
        assert (group["age_hours"], group["last_age_hours"], group["active_hours"]) == (46, 22, 23)
        millis = rows.select(times.epoch_millis(F.col("date"))).first()[0]
        assert millis == 1710037815250
        (day, *_) = sorted(row.day for row in manage.daily_digest(rows).collect())
        assert str(day) == "2024-03-10"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_labels(spark):
    rows = feed.display_labels(feed.open_reports(reports(spark, {"browser": 3, "line": 7}), known(spark)))
    (label,) = dicts(rows)
    assert label == {
        "id": 1, "icon_key": "ie", "location": "a.js:7", "browser_label": "Internet Explorer 8",
    }
    counted = spark.createDataFrame([(1234, 2)], "t bigint, v bigint")
    shown = counted.select(text.submissions_label(F.col("t"), F.col("v"))).first()[0]
    assert shown == "1234 (2 vers)"


def test_feed_json(spark, tmp_path):
    rows = reports(spark, {"message": 'say "hi" / é', "date": datetime(2024, 1, 2, 3, 4, 5, 678000), "ip": None})
    plain = feed.open_reports(rows, known(spark))
    feed.export_json(plain, str(tmp_path / "feed"))
    assert {path.name[-7:] for path in (tmp_path / "feed").glob("part-*")} == {".txt.gz"}
    (line,) = spark.read.text(str(tmp_path / "feed")).collect()
    assert json.loads(line.value) == {
        "id": "1",
        "file": "a.js",
        "line": "1",
        "message": 'say "hi" / é',
        "date": "2024-01-02 03:04:05",
        "browser": {"type": "Chrome", "version": "26"},
        "status": "0",
        "ip": None,
        "platform": "Linux",
        "hash": md5('say "hi" / é1'),
    }


def test_totals_agree(spark):
    rows = reports(
        spark,
        *[
            {
                "message": f"m{n % 7}",
                "line": n % 3,
                "file": f"f{n % 5}.js",
                "browser": n % 6,
                "status": int(n % 4 == 0),
            }
            for n in range(300)
        ],
    )
    open_count = feed.only_open(rows).count()
    tallies = tally(rows)
    for summary in (
        summaries.message_summary(tallies, known(spark)),
        summaries.browser_summary(tallies, known(spark)),
        summaries.browser_versions(tallies, known(spark)),
        summaries.script_summary(tallies),
        manage.message_browsers(tallies),
        manage.daily_digest(rows),
        manage.affected(rows, known(spark)),
    ):
        assert summary.agg(F.sum("times")).first()[0] == open_count
    merged = regroup(tally(rows.where("id <= 100")).unionByName(tally(rows.where("id > 100"))), "file")
    assert dicts(merged, "file") == dicts(regroup(tallies, "file"), "file")


def test_resolve_and_delete(spark):
    rows = reports(spark, {"message": "a"}, {"message": "b"}, {"message": "a", "status": 1}, {"message": "c"})
    hashes = spark.createDataFrame([(md5("a1"),), (md5("a1"),), (md5("zzz"),)], "hash string")
    for bound in (0, 1_000_000):
        resolved = manage.resolve(rows, hashes, bound)
        assert resolved.columns == rows.columns
        assert [r["status"] for r in dicts(resolved, "id")] == [1, 0, 1, 0]
        assert [r["id"] for r in dicts(manage.delete(rows, hashes, bound), "id")] == [2, 4]


def test_affected(spark):
    rows = reports(
        spark,
        {"ip": 16909060, "browser": 1, "line": 5},
        {"ip": 16909060, "browser": 99, "line": 5},
        {"ip": 16909061, "browser": 2, "file": "b.js"},
        {"ip": 16909061, "status": 1},
    )

    def found(**narrowed):
        return {r["ip"]: r["times"] for r in dicts(manage.affected(rows, known(spark), **narrowed))}

    assert found() == {"1.2.3.4": 2, "1.2.3.5": 1}
    assert found(browser="Chrome") == {"1.2.3.4": 1, "1.2.3.5": 1}
    assert found(browser="unknown", line=5) == {"1.2.3.4": 1}
    assert found(ip="1.2.3.5", file="b.js") == {"1.2.3.5": 1}
    assert found(ip="9.9.9.9") == {}


def test_message_browsers_sorts_ids_as_numbers(spark):
    rows = reports(spark, {"browser": 10}, {"browser": 9}, {"browser": 10}, {"browser": 1})
    (group,) = dicts(manage.message_browsers(tally(rows)))
    assert (group["times"], group["browsers"]) == (4, "1,9,10")
