"""Reading query strings the way a PHP endpoint reads them."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorloom.functions.let import let

MAX_LINE = 16_777_215  # largest unsigned 24-bit number, the range of a line number


def url_decode(text: Column) -> Column:
    """Percent-decode; ``+`` is a space and a broken ``%`` sequence stays as it is."""
    mended = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(text), F.try_url_decode(mended), text)
    return F.when(text.contains("%") | text.contains("+"), decoded).otherwise(text)


def url_encode(text: Column) -> Column:
    """Percent-encode as a browser's ``encodeURIComponent`` does."""
    encoded = F.url_encode(text)
    # The characters in which the two encodings differ.
    for ours, theirs in (
        ("+", "%20"),
        ("%21", "!"),
        ("%27", "'"),
        ("%28", "("),
        ("%29", ")"),
        ("%7E", "~"),
    ):
        encoded = F.replace(encoded, F.lit(ours), F.lit(theirs))
    return encoded


def _last_value(query, name):
    padded = F.concat(F.lit("&"), F.coalesce(query, F.lit("")), F.lit("&"))
    last = F.substring_index(F.substring_index(padded, f"&{name}=", -1), "&", 1)
    # Without an occurrence the first cut leaves everything and the second leaves nothing. A bare
    # "name", without "=", is rare; the greedy prefix finds the last occurrence of any form.
    careful = F.regexp_extract(padded, rf"(?s)^.*&{re.escape(name)}(?:=([^&]*))?&", 1)
    return F.when(padded.contains(f"&{name}&"), careful).otherwise(last)


def text_parameter(query: Column, name: str) -> Column:
    """The decoded value of the parameter's last occurrence; empty text if it never occurs."""
    return url_decode(_last_value(query, name))


def parameter(query: Column, name: str) -> Column:
    """As ``text_parameter``, but null if the parameter never occurs."""
    occurs = F.concat(F.lit("&"), query, F.lit("&")).rlike(f"&{re.escape(name)}[=&]")
    return F.when(occurs, let(_last_value(query, name), url_decode))


def parameter_values(query: Column) -> Column:
    """The decoded value of every parameter; the last occurrence of a name counts."""
    pairs = F.split(F.coalesce(query, F.lit("")), "&")
    names = F.array_distinct(F.transform(pairs, _name))
    return F.transform(
        names,
        lambda name: let(
            F.regexp_replace(
                F.try_element_at(F.filter(pairs, lambda pair: _name(pair) == name), F.lit(-1)),
                "^[^=]*=?",
                "",
            ),
            url_decode,
        ),
    )


def _name(pair):
    return F.split_part(pair, F.lit("="), F.lit(1))


def line_number(text: Column) -> Column:
    """Leading digits as an int, 0 without any, held to the largest line number."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*0*([0-9]*)", 1)
    number = F.coalesce(digits.try_cast("int"), F.lit(0))
    return F.when(F.length(digits) > 8, F.lit(MAX_LINE)).otherwise(F.least(number, F.lit(MAX_LINE)))
