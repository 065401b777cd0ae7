"""Inputs derived from the driver's tables: every event becomes a report and a raw request."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorloom.functions import request, signing
from errorloom.golden_agents import GOLDEN_AGENTS

EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
FIRST_IP = 167_772_160  # 10.0.0.0
AS_OF = "2024-02-01 00:00:00"

KNOWN_BROWSERS = (
    (1, "Chrome", "26.0.1410.64"),
    (2, "Chrome", "27.0.1453.93"),
    (3, "Firefox", "20.0"),
    (4, "Firefox", "21.0"),
    (5, "Internet Explorer", "8.0"),
    (6, "Opera", "9.80"),
)

K = "cast(get_json_object(props, '$.k') as int)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def event_slices(events: DataFrame, count: int) -> list:
    """All events as ``count`` tables, in the order of their ids, as they would arrive."""
    lowest, highest = events.agg(F.min("event_id"), F.max("event_id")).first()
    if lowest is None:
        return [events] * count
    step = (highest - lowest) // count + 1
    starts = [lowest + number * step for number in range(count)]
    return [events.where(F.col("event_id").between(start, start + step - 1)) for start in starts]


def arriving_events(slices, path: str) -> DataFrame:
    """A stream of the slices, which arrive one by one. Each is a file per core, so all cores share a micro-batch."""
    spark = slices[0].sparkSession
    files = spark.sparkContext.defaultParallelism
    for rows in slices:
        rows.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def browsers(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({id_}, '{type_}', '{version}')" for id_, type_, version in KNOWN_BROWSERS)
    return spark.sql(
        "select cast(id as bigint) as id, type, version, cast(null as timestamp_ntz) as date"
        f" from values {rows} as known(id, type, version)"
    )


MESSAGE = "concat('Uncaught ', event_type, ' failure ', cast(user_id % 4 as string))"


def reports(events: DataFrame, message: str = MESSAGE) -> DataFrame:
    """Browser 7 has no dimension row."""
    return events.selectExpr(
        "event_id + 1 as id",
        "concat('http://cdn.example.com/js/', event_type, '.js') as file",
        f"{K} as line",
        f"{message} as message",
        "user_id % 7 + 1 as browser",
        "case when event_id % 11 = 0 then 1 else 0 end as status",
        "ts as date",
        f"{FIRST_IP} + user_id as ip",
        "case user_id % 3 when 0 then 'Windows' when 1 then 'Linux' else 'Apple' end as platform",
    )


def raw_beacons(events: DataFrame) -> DataFrame:
    agents = F.array(*[F.lit(row[0]) for row in GOLDEN_AGENTS])
    agent = F.get(agents, (F.col("event_id") % len(GOLDEN_AGENTS)).cast("int"))
    return events.withColumn("user_agent", agent).selectExpr(
        "event_id + 1 as id",
        "ts as received_at",
        "concat('message=Uncaught%20', event_type, '%20failure%20', cast(user_id % 4 as string),"
        " '&url=http%3A%2F%2Fcdn.example.com%2Fjs%2F', event_type,"
        " '.js&line=', cast(event_id % 120 as string)) as query_string",
        "user_agent",
        "case event_id % 10"
        " when 0 then concat('10.1.', cast(user_id % 250 as string), '.9, 203.0.113.7')"
        " when 1 then 'unknown'"
        " when 2 then 'fe80::1'"
        " when 3 then concat('10.2.0.', cast(user_id % 250 as string)) end as xff",
        "concat('192.0.2.', cast(user_id % 250 as string)) as remote_addr",
    )


def untrusted_requests(events: DataFrame) -> DataFrame:
    """Requests of which some carry screened text and some a number ``n``."""
    return events.selectExpr(
        "event_id + 1 as id",
        "concat('a=', case event_id % 5 when 0 then event_type when 1 then 'x%3By'"
        " when 2 then 'Union' when 3 then 'reunion' else '%E3%80%80' end,"
        " '&user=', cast(user_id as string),"
        f" case event_id % 4 when 0 then '' when 1 then concat('&n=x', {K})"
        f" when 2 then concat('&n=', {K}) else concat('&n=', {K}, '.5') end) as query_string",
    )


def signed_requests(events: DataFrame) -> DataFrame:
    """Signed requests: of every six, one lacks the signature, one has a changed key."""
    coded_time = signing.encode_time((F.col("event_id") + 1_700_000_000).cast("string"))
    key = F.concat(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type"))
    sent = F.when(F.col("event_id") % 6 == 1, F.col("user_id") + 1).otherwise(F.col("user_id"))
    code = request.url_encode(signing.signature(key, coded_time))
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        F.concat(
            F.lit("p="),
            F.col("event_id").cast("string"),
            F.lit("&t="),
            sent.cast("string"),
            F.lit("&f="),
            F.col("event_type"),
            F.lit("&k="),
            request.url_encode(coded_time),
            F.when(F.col("event_id") % 6 == 0, "").otherwise(F.concat(F.lit("&cr="), code)),
        ).alias("query_string"),
    )


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six addresses per customer, then two that belong to nobody."""
    start = F.lit(FIRST_IP) + F.col("c_custkey") * 8
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        start.cast("bigint").alias("ip_start"),
        (start + 5).cast("bigint").alias("ip_end"),
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("location"),
    )


def nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for every order line, all around the middle of one block of 65,536 addresses and thus nested."""
    depth = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 30_000
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.lit(FIRST_IP) + depth).cast("bigint").alias("ip_start"),
        (F.lit(FIRST_IP + 65_535) - depth).cast("bigint").alias("ip_end"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("location"),
    )


def varied_reports(events: DataFrame) -> DataFrame:
    """Reports whose messages differ in numbers, names, quoted text and addresses."""
    name = "translate(cast(user_id as string), '0123456789', 'abcdefghij')"
    message = (
        "case event_id % 4"
        " when 0 then concat('Cannot read property \"p', user_id, '\" of null at line ', event_id % 50)"
        " when 1 then concat('Uncaught ', event_type, ' failure ', user_id % 4)"
        f" when 2 then concat('user name ', {name}, ' was not found in ', event_type)"
        f" else concat('Timeout of ', {K}, ' ms while loading http://cdn.example.com/', event_type, '.js') end"
    )
    return reports(events.withColumn("_message", F.expr(message)), message="_message")


def outcome_requests(events: DataFrame) -> DataFrame:
    """Requests for every outcome: several addresses or none, screened text, a missing or wrong signature, or in order."""
    plain = raw_beacons(events).drop("query_string")
    screened = F.when(F.col("id") % 7 == 0, "&a=x%3By").otherwise("")
    signed = signed_requests(events).withColumn("query_string", F.concat("query_string", screened))
    return plain.join(signed, "id")


def dropped_hashes(reports: DataFrame) -> DataFrame:
    """Fingerprints to delete: one message, on its last lines."""
    dropped = reports.where("message = 'Uncaught click failure 1' and line >= 100")
    return dropped.selectExpr("md5(concat(message, cast(line as string))) as hash").distinct()


def fixed_hashes(reports: DataFrame) -> DataFrame:
    """Fingerprints declared fixed: one message, on the first half of its lines."""
    fixed = reports.where("message = 'Uncaught click failure 0' and line < 50")
    return fixed.selectExpr("md5(concat(message, cast(line as string))) as hash").distinct()
