"""From raw requests to clean error events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.functions import net, request, signing
from errorloom.functions.let import let

# Text that no request value may contain when screening is on. The fifth is the
# full-width space.
SCREENED_KEYWORDS = ("'", ";", "union", " ", "　", "%")

NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def decode_requests(raw: DataFrame) -> DataFrame:
    """Adds ``message``, ``file`` and ``line``, read from the query string."""
    query = F.col("query_string")
    return raw.withColumns(
        {
            "message": request.text_parameter(query, "message"),
            "file": request.text_parameter(query, "url"),
            "line": request.line_number(request.text_parameter(query, "line")),
        }
    )


def client_ip(raw: DataFrame, multi_ip: str = "first") -> DataFrame:
    """Adds ``ip_text`` (all distinct addresses, run together) and ``ip`` (the one that counts).

    ``multi_ip`` decides about a request that names several: "first" takes the first, "reject"
    leaves ``ip`` null.
    """
    if multi_ip not in ("first", "reject"):
        raise ValueError(f"multi_ip must be 'first' or 'reject', not {multi_ip!r}")
    address = net.chosen_address(F.col("xff"), F.col("remote_addr"))
    return (
        raw.withColumn("_octets", F.split(net.counted_ipv4(address, multi_ip), r"\."))
        .withColumns(
            {
                "ip_text": F.array_join(net.ipv4_matches(address), ""),
                "ip": net.octets_to_long(F.col("_octets")),
            }
        )
        .drop("_octets")
    )


def has_keyword(query: Column, keywords=SCREENED_KEYWORDS) -> Column:
    def screened(value):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | value.contains(keyword)
        return hit

    return F.exists(request.parameter_values(query), screened)


def screen(raw: DataFrame, keywords=SCREENED_KEYWORDS) -> DataFrame:
    """Adds ``verdict``: "keyword" if a request value contains one of the keywords, else "ok"."""
    hit = has_keyword(F.col("query_string"), keywords)
    return raw.withColumn("verdict", F.when(hit, "keyword").otherwise("ok"))


def range_check(value: Column, low, high) -> Column:
    """The value as text if it is a number within [low, high], else "0"; missing reads as "0"."""
    value = F.coalesce(value, F.lit("0"))
    number = F.when(value.rlike(NUMERIC), F.trim(value).try_cast("double"))
    return F.when(number.between(low, high), value).otherwise(F.lit("0"))


def is_signed(query: Column) -> Column:
    """Whether ``cr`` is the signature of ``p``, ``t`` and ``f`` under the coded time ``k``."""
    key = F.concat(
        *[F.coalesce(request.parameter(query, name), F.lit("0")) for name in ("p", "t", "f")]
    )
    time = F.coalesce(request.parameter(query, "k"), F.lit(""))
    code = signing.signature(key, time)
    return let(
        request.parameter(query, "cr"),
        lambda given: given.isNotNull() & (given != "0") & (given == code),
    )


def verify_signed(raw: DataFrame) -> DataFrame:
    """Adds ``verdict``: "valid" or "invalid"."""
    return raw.withColumn("verdict", F.when(is_signed(F.col("query_string")), "valid").otherwise("invalid"))


def triage(
    raw: DataFrame,
    multi_ip: str = "first",
    screen_keywords: bool = False,
    require_signature: bool = False,
) -> DataFrame:
    """Adds ``ip`` and ``reject_reason``, null for a request that becomes a report."""
    # Not "ip is null": a filter on the reason is pushed down as a copy of all it refers to, and
    # this test reads the address once where the conversion names it for every octet.
    address = net.chosen_address(F.col("xff"), F.col("remote_addr"))
    reason = F.when(~net.is_ipv4(net.counted_ipv4(address, multi_ip)), "ip")
    if screen_keywords:
        reason = reason.when(has_keyword(F.col("query_string")), "keyword")
    if require_signature:
        reason = reason.when(~F.coalesce(is_signed(F.col("query_string")), F.lit(False)), "signature")
    return client_ip(raw, multi_ip).drop("ip_text").withColumn("reject_reason", reason)


def rejects(triaged: DataFrame) -> DataFrame:
    """The reject log: requests that could not become a report."""
    return triaged.where(F.col("reject_reason").isNotNull()).select(
        "id", F.col("received_at").alias("date"), "ip", "reject_reason"
    )


def accepted(triaged: DataFrame) -> DataFrame:
    return triaged.where(F.col("reject_reason").isNull()).drop("reject_reason")
