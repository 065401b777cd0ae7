"""Client addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"((?:[0-9]+\.){3}[0-9]+)"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def chosen_address(xff: Column, remote_addr: Column) -> Column:
    """The forwarded address if it says anything, else the peer's, else null."""
    return F.coalesce(F.when(_says_something(xff), xff), F.when(_says_something(remote_addr), remote_addr))


def _says_something(address):
    return ~F.lower(address).isin("", "0", "unknown")


def ipv4_matches(address: Column) -> Column:
    """Every distinct dotted quad in the text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(IPV4), F.lit(1)))


def counted_ipv4(address: Column, multi_ip: str) -> Column:
    """The dotted quad that counts: the first one, or ("reject") the only one.

    Text that is no address where there is none.
    """
    if multi_ip == "first":
        return F.regexp_extract(F.coalesce(address, F.lit("")), IPV4, 1)
    return F.array_join(ipv4_matches(address), " ")


def is_ipv4(text: Column) -> Column:
    return text.rlike(f"^(?:{OCTET}[.]){{3}}{OCTET}$")


def octets_to_long(octets: Column) -> Column:
    """An array of four numbers as text to a bigint; null unless all are 0..255."""
    value = F.lit(0).cast("bigint")
    for position in range(4):
        octet = F.get(octets, F.lit(position)).try_cast("int")
        value = value * 256 + F.when(octet <= 255, octet)
    return F.when(F.size(octets) == 4, value)


def dotted_to_long(dotted: Column) -> Column:
    """a.b.c.d as a bigint; null unless all four parts are 0..255."""
    return octets_to_long(F.split(dotted, r"\."))


def long_to_dotted(ip: Column) -> Column:
    octets = [F.shiftrightunsigned(ip, shift).bitwiseAND(F.lit(255)) for shift in (24, 16, 8, 0)]
    return F.when(ip.isNotNull(), F.concat_ws(".", *[octet.cast("string") for octet in octets]))
