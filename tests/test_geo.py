import random

from builders import reports
from errorloom.operators.geo import aligned_blocks, distinct_ranges, locate_ips, winners


def ranges(spark, *rows):
    return spark.createDataFrame(list(rows), "ip_start bigint, ip_end bigint, location string")


def located(spark, addresses, table, **options):
    df = reports(spark, *[{"ip": ip} for ip in addresses])
    return {row.ip: row.location for row in locate_ips(df, table, **options).collect()}


def test_borders_gaps_and_ranges_over_many_blocks(spark):
    table = ranges(
        spark, (10, 20, "a"), (21, 21, "b"), (65_000, 400_000, "wide"), (4_294_967_295, 4_294_967_295, "end")
    )
    addresses = [9, 10, 20, 21, 22, 65_000, 65_536, 131_072, 400_000, 400_001, 4_294_967_295, None]
    assert located(spark, addresses, table) == {
        9: None, 10: "a", 20: "a", 21: "b", 22: None, 65_000: "wide", 65_536: "wide", 131_072: "wide",
        400_000: "wide", 400_001: None, 4_294_967_295: "end", None: None,
    }


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    cuts = sorted(rng.sample(range(300_000), 400))
    table = [(lo, hi - rng.randint(0, 1), f"l{lo}") for lo, hi in zip(cuts[::2], cuts[1::2])]
    addresses = [rng.randrange(300_000) for _ in range(2_000)] + [cuts[0]] * 1_000
    expected = {
        ip: next((loc for lo, hi, loc in table if lo <= ip <= hi), None) for ip in addresses
    }
    assert located(spark, addresses, ranges(spark, *table)) == expected
    assert located(spark, addresses, ranges(spark, *table), max_lookup_bytes=0) == expected


def test_every_report_stays(spark):
    df = reports(spark, *[{"ip": 5}] * 200, {"ip": None}, {"ip": 700})
    out = locate_ips(df, ranges(spark, (1, 6, "x")))
    assert out.count() == 202
    assert out.where("location = 'x'").count() == 200


def test_overlapping_ranges_same_as_brute_force(spark):
    rng = random.Random(11)
    table = [(0, 4_294_967_295, "all"), (70_000, 70_000, "one"), (70_000, 70_000, "one")]
    for number in range(300):
        start = rng.randrange(200_000)
        table.append((start, start + rng.choice((0, 3, 50, 5_000, 90_000)), f"r{number}"))
    table.append((9, 8, "empty"))
    addresses = [rng.randrange(300_000) for _ in range(1_500)] + [70_000, 4_294_967_295]

    def best(ip):
        holding = [(lo, -hi, loc) for lo, hi, loc in table if lo <= ip <= hi]
        return max(holding)[2]

    assert located(spark, addresses, ranges(spark, *table)) == {ip: best(ip) for ip in addresses}


def blocks_of(spark, *pairs):
    rows = aligned_blocks(spark.createDataFrame(list(pairs), "start bigint, end bigint")).collect()
    return {pair: sorted((r.bits, r.prefix) for r in rows if (r.start, r.end) == pair) for pair in pairs}


def test_blocks_cover_a_range_exactly(spark):
    rng = random.Random(3)
    pairs = {(s, s + rng.choice((0, 1, 5, 77, 1000))) for s in (rng.randrange(3_000) for _ in range(150))}
    for (start, end), blocks in blocks_of(spark, *pairs).items():
        held = sorted(a for bits, prefix in blocks for a in range(prefix << bits, (prefix + 1) << bits))
        assert held == list(range(start, end + 1))
        sizes = [bits for bits, _ in blocks]
        assert all(sizes.count(bits) <= 2 for bits in sizes)
    top = 2**32 - 1
    found = blocks_of(spark, (0, top), (1, top), (top, top), (0, top - 1))
    assert found[0, top] == [(32, 0)] and found[top, top] == [(0, top)]
    assert len(found[1, top]) == len(found[0, top - 1]) == 32


def test_nested_ranges_cost_rows_in_proportion(spark):
    """200,000 ranges of one block of addresses, each within the one before."""
    nested = spark.range(200_000).selectExpr("id % 32768 as d", "id").selectExpr(
        "d as ip_start", "65535 - d as ip_end", "concat('r', id) as location")
    best = winners(distinct_ranges(nested))
    # One row per block of addresses that some range has, whatever the number of ranges.
    assert best.count() <= 2 * 65_536
    got = located(spark, [0, 5, 32_767, 32_768, 65_535, 65_536], nested)
    ids = {ip: max(f"r{i}" for i in range(200_000) if i % 32_768 == min(ip, 65_535 - ip)) for ip in (0, 5, 32_767, 32_768, 65_535)}
    assert got == ids | {65_536: None}


def test_awkward_ranges(spark):
    table = ranges(spark, (None, 5, "no start"), (3, None, "no end"), (-10, 2, "before"), (2**32 - 2, 2**33, "after"), (7, 7, None), (2**33, 2**34, "far"))
    assert located(spark, [0, 2, 3, 7, 2**32 - 1], table) == {0: "before", 2: "before", 3: None, 7: None, 2**32 - 1: "after"}
    assert located(spark, [4, None], table.where("false")) == {4: None, None: None}
