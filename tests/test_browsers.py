from datetime import timedelta

from builders import START, browsers, dicts
from errorloom.operators.browsers import attach_browser_id, name_browser, new_browsers


def events(spark, *pairs, first=1):
    return spark.createDataFrame(
        [
            (first + i, START + timedelta(minutes=i), type_, version)
            for i, (type_, version) in enumerate(pairs)
        ],
        "id bigint, received_at timestamp_ntz, type string, version string",
    )


def test_new_pairs_keep_their_first_spelling_and_time(spark):
    known = browsers(spark, (4, "Opera", "9.80"))
    arrived = events(spark, ("Firefox", "3.0b"), ("OPERA", "9.80"), ("firefox", "3.0B"), ("Firefox", ""))
    rows = dicts(new_browsers(arrived, known), "id")
    assert [(r["id"], r["type"], r["version"], r["date"]) for r in rows] == [
        (5, "Firefox", "3.0b", START),
        (8, "Firefox", "", START + timedelta(minutes=3)),
    ]


def test_second_run_adds_nothing(spark):
    known = browsers(spark)
    arrived = events(spark, ("Firefox", "3"), ("Chrome", "26"))
    fresh = new_browsers(arrived, known)
    assert fresh.count() == 2
    assert new_browsers(arrived, known.unionByName(fresh)).isEmpty()


def test_new_ids_never_meet_old_ones(spark):
    known = browsers(spark, (1, "A", "1"), (900, "B", "1"))
    fresh = new_browsers(events(spark, ("C", "1"), ("D", "1")), known)
    assert sorted(row.id for row in fresh.collect()) == [901, 902]


def test_duplicate_pairs_do_not_multiply_facts(spark):
    known = browsers(spark, (7, "Chrome", "26"), (3, "chrome", "26"), (9, "Opera", "1"))
    for bound in (0, 1_000_000):
        rows = attach_browser_id(events(spark, ("Chrome", "26"), ("CHROME", "26")), known, bound)
        assert [(row.id, row.browser) for row in rows.orderBy("id").collect()] == [(1, 3), (2, 3)]


def test_missing_and_duplicate_ids(spark):
    known = browsers(spark, (1, "Chrome", "26"), (1, "Chrome", "27"))
    rows = spark.createDataFrame([(1,), (7,), (None,)], "browser bigint")
    for bound in (0, 1_000_000):
        named = name_browser(rows, known, bound).collect()
        assert sorted((row.browser or 0, row.type, row.version) for row in named) == [
            (0, "unknown", "unknown"),
            (1, "Chrome", "26"),
            (7, "unknown", "unknown"),
        ]
