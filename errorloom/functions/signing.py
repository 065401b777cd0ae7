"""The request signature: a masked, base64-coded key bound to a coded time."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from errorloom.functions.let import let

# Each digit of the key and its mask.
DIGIT_MASKS = (("1", "Dp"), ("2", "eF"), ("3", "jw"), ("4", "Kn"), ("5", "iq"), ("6", "oz"))
# The letters that stand for 0 to 9 in a coded time.
TIME_DIGITS, TIME_LETTERS = "0123456789", "FiReNdLSyu"


def mask_digits(key: Column) -> Column:
    for digit, mask in DIGIT_MASKS:
        key = F.replace(key, F.lit(digit), F.lit(mask))
    return key


def encode_time(time: Column) -> Column:
    return _coded(F.translate(time, TIME_DIGITS, TIME_LETTERS))


def decode_time(coded: Column) -> Column:
    # As lenient as the sender's decoder: foreign characters are skipped and so is a lone last one.
    clean = F.regexp_replace(F.reverse(coded), "[^A-Za-z0-9+/]", "")
    clean = F.regexp_replace(clean, "^((?:.{4})*).$", "$1")
    padded = let(clean, lambda c: F.rpad(c, F.ceil(F.length(c) / 4).cast("int") * 4, F.lit("=")))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.translate(F.coalesce(text, F.lit("")), TIME_LETTERS, TIME_DIGITS)


def signature(key: Column, coded_time: Column) -> Column:
    return _coded(F.concat(mask_digits(key), decode_time(coded_time)))


def _coded(text):
    code = F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", "")
    return let(code, lambda c: F.reverse(F.substring(c, F.lit(1), F.length(c) - 2)))
