"""Affected browsers as bitmaps."""

import random

from builders import browsers, reports
from errorloom.operators.manage import affected_browsers, affected_counts, merge_affected, number_browsers
from errorloom.operators.tallies import tally


def test_numbers_are_dense_and_in_order(spark):
    ids = random.Random(2).sample(range(10**12), 3_000)
    known = spark.createDataFrame([(i,) for i in [*ids, *ids[:50], None]], "id bigint")
    rows = sorted((r.browser, r.number) for r in number_browsers(known).collect())
    assert rows == [(i, n) for n, i in enumerate(sorted(ids), 1)]
    assert number_browsers(known.limit(0)).count() == 0


def counts(frame):
    return sorted((r.browsers, r.times) for r in affected_counts(frame).collect())


def test_counts_against_sets(spark):
    rng = random.Random(1)
    # Numbers beyond one bitmap of 32,768, and browsers without a row in the dimension.
    numbers = number_browsers(spark.range(70_000).withColumnRenamed("id", "id"))
    rows = [(f"m{rng.randrange(3)}", rng.choice([rng.randrange(70_000), 5, 69_999])) for _ in range(400)]
    rows += [("m0", 10**9), ("lost", 10**9)]
    frames = [reports(spark, *[{"message": m, "browser": b} for m, b in part]) for part in (rows[:200], rows[200:])]
    parts = [affected_browsers(tally(f, "message", "line", "browser"), numbers) for f in frames]
    expected = sorted((len({b for m, b in rows if m == message and b < 70_000}), sum(m == message for m, _ in rows)) for message in {m for m, _ in rows})
    assert counts(merge_affected(parts[0].union(parts[1]))) == expected
    whole = affected_browsers(tally(frames[0].union(frames[1]), "message", "line", "browser"), numbers, max_lookup_bytes=0)
    assert counts(whole) == expected
    assert "collect" not in whole._jdf.queryExecution().executedPlan().toString().replace("CollectMetrics", "")
    assert counts(parts[0].limit(0)) == []


def test_nothing_known(spark):
    rows = tally(reports(spark, {"browser": 3}, {"browser": None}), "message", "line", "browser")
    assert counts(affected_browsers(rows, number_browsers(browsers(spark, (9, "x", "1"))))) == [(0, 2)]
