import pytest
from pyspark.sql import functions as F

from errorloom.functions.useragent import is_browser
from errorloom.golden_agents import AOL_AGENT, AOL_VERSION, GOLDEN_AGENTS
from errorloom.operators.agents import OUTPUTS, agent_dictionary, apply_rules, enrich_user_agents

# Agents beyond the golden ones: (agent, type, version, platform, mobile, robot).
MORE = [
    ("Opera Mini no slash", "Opera Mini", "Mini", "unknown", True, False),
    ("Opera 7.5 (Windows)", "Opera", "7.5", "Windows", False, False),
    ("Opera", "Opera", "", "unknown", False, False),
    ("Opera/9(x) y", "Opera", "9", "unknown", False, False),
    ("Opera/9.80 Version/10.5 extra", "Opera", "10.5extra", "unknown", False, False),
    (
        "Mozilla/2.0 (MSIE 3.02; Pocket; Opera)",
        "Pocket Internet Explorer", "2.0MSIE3.02PocketOpera", "Windows CE", True, False,
    ),
    ("pocket", "Pocket Internet Explorer", "", "Windows CE", True, False),
    ("Microsoft Internet Explorer", "Internet Explorer", "1.0", "unknown", False, False),
    ("Microsoft Internet Explorer/308", "Internet Explorer", "1.5", "unknown", False, False),
    ("Netscape6/6.2.1 (Macintosh)", "Netscape Navigator", "6.2.1", "Apple", False, False),
    ("Mozilla/5.0 Android", "Android", "unknown", "Android", True, False),
    ("Mozilla/5.0 (iPad) Safari/1", "iPad", "unknown", "iPad", True, False),
    ("Mozilla/5.0 (iPod) Safari/1", "iPod", "unknown", "iPod", True, False),
    ("Mozilla/5.0 (iPhone) Version/5.1 x", "iPhone", "5.1", "iPhone", True, False),
    ("galeon foo galeon/1.2", "Galeon", "", "unknown", False, False),
    ("W3C_Validator/1.3", "W3C Validator", "1.3", "unknown", False, False),
    ("w3c_validator 1.3/x", "W3C Validator", "x", "unknown", False, False),
    ("Mozilla/4.8 [en] (X11; SunOS) Netscape", "unknown", "unknown", "SunOS", False, False),
    ("Mozilla/5.0 RV:1.9b x", "Mozilla", "RV1.9b", "unknown", False, False),
    ("Mozilla/5.0 rv:x", "Mozilla", "5.0", "unknown", False, False),
    ("MyOS\\/2 agent", "unknown", "unknown", "OS/2", False, False),
    ("Warp OS/2", "unknown", "unknown", "unknown", False, False),
    ("CHROME/9.1 chrome/8", "Chrome", "9.1", "unknown", False, False),
    ("chrome", "Chrome", "", "unknown", False, False),
    ("OpenSolaris thing", "unknown", "unknown", "OpenSolaris", False, False),
    ("Firefox/ Firefox(3.5;", "Firefox", "3.5", "unknown", False, False),
]


def frame(spark, agents):
    return spark.createDataFrame(list(enumerate(agents)), "id int, user_agent string")


def outcomes(df):
    columns = ("type", "version", "platform", "is_mobile", "is_robot")
    return [tuple(row) for row in df.orderBy("id").select(*columns).collect()]


CASES = [*GOLDEN_AGENTS, *MORE]


@pytest.mark.parametrize("how", ["rows", "dictionary"])
def test_rules(spark, how):
    df = frame(spark, [case[0] for case in CASES])
    got = outcomes(apply_rules(df) if how == "rows" else enrich_user_agents(df))
    for case, outcome in zip(CASES, got, strict=True):
        assert outcome == tuple(case[1:]), case[0]


def test_series_60_by_exact_token(spark):
    df = frame(spark, ["Mozilla S60 NokiaN97/12.0", "Mozilla s60 NokiaN97/12.0", "SERIES60 nokiaE5/1"])
    assert [row[:2] for row in outcomes(apply_rules(df))] == [
        ("Nokia S60 OSS Browser", "12.0"),
        ("Nokia Browser", "12.0"),
        ("Nokia S60 OSS Browser", "1"),
    ]


def test_other_flags(spark):
    df = frame(spark, [GOLDEN_AGENTS[AOL_AGENT][0], "x chromeframe y", "x ChromeFrame y", "AOL"])
    rows = apply_rules(df).orderBy("id").select("is_aol", "aol_version", "is_chromeframe").collect()
    assert [tuple(row) for row in rows] == [
        (True, AOL_VERSION, False),
        (False, "unknown", True),
        (False, "unknown", False),
        (True, "", False),
    ]


def test_missing_agent_reads_as_empty(spark):
    df = frame(spark, [None, ""])
    for enriched in (apply_rules(df), enrich_user_agents(df)):
        assert outcomes(enriched) == [("unknown", "unknown", "unknown", False, False)] * 2
        assert enriched.where("user_agent is null").count() == 1


def test_a_dictionary_too_big_to_broadcast_falls_back_to_rows(spark):
    df = frame(spark, [case[0] for case in CASES] * 3)
    small = enrich_user_agents(df, max_dictionary_bytes=100)
    assert "Broadcast" not in small._jdf.queryExecution().toString()
    assert outcomes(small) == outcomes(enrich_user_agents(df))


def test_enrichment_keeps_every_row_and_column(spark):
    df = frame(spark, ["same agent"] * 500 + [case[0] for case in CASES])
    enriched = enrich_user_agents(df)
    assert enriched.count() == df.count()
    assert set(enriched.columns) == {"id", "user_agent", *OUTPUTS}
    assert agent_dictionary(df).count() == len({case[0] for case in CASES} | {"same agent"})


def test_is_browser(spark):
    df = spark.createDataFrame([("Internet Explorer",), ("Opera",)], "type string")
    hits = df.select(is_browser(F.col("type"), " internet EXPLORER ").alias("hit")).collect()
    assert [row.hit for row in hits] == [True, False]
