import base64
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from builders import column, raw
from errorloom.functions import net, request, signing
from errorloom.operators import beacons


def decoded(spark, *queries):
    df = raw(spark, *[{"query_string": query} for query in queries])
    rows = beacons.decode_requests(df).orderBy("id").select("message", "file", "line").collect()
    return [tuple(row) for row in rows]


def test_decode(spark):
    assert decoded(
        spark,
        "message=a%20b%3A+c&url=http%3A%2F%2Fx%2Fy.js%3Fq%3D1%26r&line=12",
        "line=1&line=2",
        "message=%zz&url=%E4%BD%A0%20%2",
        "message=first&message",
        "message&message=last",
        "message=a=b&url=",
        "xmessage=no&messages=no",
        "",
        None,
    ) == [
        ("a b: c", "http://x/y.js?q=1&r", 12),
        ("", "", 2),
        ("%zz", "你 %2", 0),
        ("", "", 0),
        ("last", "", 0),
        ("a=b", "", 0),
        ("", "", 0),
        ("", "", 0),
        ("", "", 0),
    ]


@pytest.mark.parametrize(
    "text, line",
    [
        ("", 0),
        ("12abc", 12),
        ("99999999", 16777215),
        ("16777216", 16777215),
        ("0000000000000000000042", 42),
        ("9" * 40, 16777215),
        ("-5", 0),
        ("x7", 0),
    ],
)
def test_line_text(spark, text, line):
    assert decoded(spark, f"line={text}")[0][2] == line


def test_whole_long_texts_are_decoded(spark):
    message = "x" * 200_000 + "é end"
    assert decoded(spark, f"message={quote(message)}&line=3")[0] == (message, "", 3)


def test_url_encode_like_a_browser(spark):
    text = "a b+c/d?e=f&g~h!i'j(k)l*m-n_o.p%q é你"
    expected = quote(text, safe="~!'()*-_.")
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        request.url_encode(F.col("t")).alias("e"),
        request.url_decode(request.url_encode(F.col("t"))).alias("back"),
    ).first()
    assert tuple(row) == (expected, text)


ADDRESSES = [
    ({"xff": "10.1.8.9, 203.0.113.7"}, "10.1.8.9203.0.113.7", 167839753, None),
    ({"xff": "10.1.8.9, 10.1.8.9"}, "10.1.8.9", 167839753, 167839753),
    ({"xff": "fe80::1"}, "", None, None),
    ({"xff": "1.2.3.256"}, "1.2.3.256", None, None),
    ({"xff": "99999999999.1.1.1"}, "99999999999.1.1.1", None, None),
    ({"xff": "Unknown", "remote_addr": "1.2.3.4"}, "1.2.3.4", 16909060, 16909060),
    ({"xff": "", "remote_addr": "1.2.3.4"}, "1.2.3.4", 16909060, 16909060),
    ({"xff": "0", "remote_addr": "255.255.255.255"}, "255.255.255.255", 4294967295, 4294967295),
    ({"xff": None, "remote_addr": "unknown"}, "", None, None),
    ({"xff": None, "remote_addr": None}, "", None, None),
]


@pytest.mark.parametrize("mode, position", [("first", 2), ("reject", 3)])
def test_client_ip(spark, mode, position):
    df = beacons.client_ip(raw(spark, *[row for row, *_ in ADDRESSES]), mode)
    assert column(df, "ip_text") == [case[1] for case in ADDRESSES]
    assert column(df, "ip") == [case[position] for case in ADDRESSES]


@pytest.mark.parametrize("mode, position", [("first", 2), ("reject", 3)])
def test_triage_rejects_exactly_the_requests_without_ip(spark, mode, position):
    triaged = beacons.triage(raw(spark, *[row for row, *_ in ADDRESSES]), mode)
    expected = ["ip" if case[position] is None else None for case in ADDRESSES]
    assert column(triaged, "reject_reason") == expected
    assert column(triaged, "ip") == [case[position] for case in ADDRESSES]
    assert beacons.rejects(triaged).count() + beacons.accepted(triaged).count() == len(ADDRESSES)


def test_unknown_multi_ip_rule(spark):
    with pytest.raises(ValueError):
        beacons.client_ip(raw(spark, {}), "last")


def test_long_to_dotted(spark):
    df = spark.createDataFrame([(0,), (4294967295,), (167839753,), (None,)], "ip bigint")
    dotted = df.select(net.long_to_dotted(F.col("ip")).alias("d"), "ip")
    assert [row.d for row in dotted.collect()] == ["0.0.0.0", "255.255.255.255", "10.1.8.9", None]
    back = dotted.select(net.dotted_to_long(F.col("d")).alias("b"), "ip").collect()
    assert all(row.b == row.ip for row in back)


@pytest.mark.parametrize(
    "query, verdict",
    [
        ("a=x&b=a;b", "keyword"),
        ("a=Union", "ok"),
        ("a=xunionx", "keyword"),
        ("a=b%20c", "keyword"),
        ("a=b+c", "keyword"),
        ("a=%E3%80%80", "keyword"),
        ("a=100%25", "keyword"),
        ("a=it%27s", "keyword"),
        ("a=%3B&a=fine", "ok"),
        ("union=fine", "ok"),
        ("", "ok"),
        (None, "ok"),
    ],
)
def test_screen(spark, query, verdict):
    assert column(beacons.screen(raw(spark, {"query_string": query})), "verdict") == [verdict]


def test_screening_is_off_unless_asked_for(spark):
    df = raw(spark, {"query_string": "message=a%20b"})
    assert column(beacons.triage(df), "reject_reason") == [None]
    assert column(beacons.triage(df, screen_keywords=True), "reject_reason") == ["keyword"]
    assert column(beacons.triage(df, require_signature=True), "reject_reason") == ["signature"]


def test_range_check(spark):
    cases = [
        (None, "0"),
        ("x", "0"),
        ("11", "0"),
        ("5", "5"),
        ("1", "1"),
        ("10", "10"),
        ("10.01", "0"),
        (" 7", " 7"),
        ("7 ", "0"),
        ("5d", "0"),
        ("NaN", "0"),
        ("Infinity", "0"),
        ("5e0", "5e0"),
        (".5e1", ".5e1"),
        ("", "0"),
        ("-5", "0"),
    ]
    df = spark.createDataFrame([(i, value) for i, (value, _) in enumerate(cases)], "id int, v string")
    checked = df.select("id", beacons.range_check(F.col("v"), 1, 10).alias("c"))
    assert column(checked, "c") == [expected for _, expected in cases]


def code(text):
    return base64.b64encode(text.encode()).decode()[:-2][::-1]


def expected_signature(key, time):
    for digit, mask in zip("123456", ("Dp", "eF", "jw", "Kn", "iq", "oz")):
        key = key.replace(digit, mask)
    return code(key + time)


def letters(time):
    return code(time.translate(str.maketrans("0123456789", "FiReNdLSyu")))


def test_time_code(spark):
    df = spark.createDataFrame([("1369100000",)], "t string")
    row = df.select(
        signing.encode_time(F.col("t")).alias("e"),
        signing.decode_time(signing.encode_time(F.col("t"))).alias("d"),
    ).first()
    assert tuple(row) == (letters("1369100000"), "1369100000")


@pytest.mark.parametrize("coded", ["", "A", "!!", "AB CD", "ABCDE", "日本"])
def test_any_text_can_be_decoded_as_time(spark, coded):
    df = spark.createDataFrame([(coded,)], "t string")
    assert df.select(signing.decode_time(F.col("t"))).first()[0] is not None


def signed(p, t, f, time, given=None):
    given = expected_signature((p or "0") + (t or "0") + (f or "0"), time) if given is None else given
    named = {"p": p, "t": t, "f": f, "k": letters(time), "cr": given}
    return "&".join(f"{name}={quote(value, safe='')}" for name, value in named.items() if value is not None)


def test_verify_signed(spark):
    time = "1369100000"
    long_key = "page123456" * 30  # longer than one line of base64
    cases = [
        (signed("12", "x", "654321", time), "valid"),
        (signed(long_key, "2", "3", time), "valid"),
        (signed("12", "x", None, time), "valid"),
        (signed("12", "x", "y", time).replace("p=12", "p=13"), "invalid"),
        (signed("12", "x", "y", time, given="0"), "invalid"),
        (signed("12", "x", "y", time, given=""), "invalid"),
        ("p=12&t=x&f=y", "invalid"),
        ("", "invalid"),
    ]
    df = raw(spark, *[{"query_string": query} for query, _ in cases])
    assert column(beacons.verify_signed(df), "verdict") == [verdict for _, verdict in cases]
