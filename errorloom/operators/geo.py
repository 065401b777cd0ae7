"""Locating addresses by a table of address ranges, by longest prefixes.

Every range is cut into aligned blocks of a power of two addresses: at most two per size, and it covers an
address if one of its blocks does. A block is named by its size and prefix, so ranges that share a block meet in a
grouping, where the best range wins, and what is left is one row per block, however the ranges nest. An
address then has one candidate block per size that occurs: its prefixes of those lengths are joined to the blocks by
equality, and the best of the blocks found is its range. Nothing is compared with range after range, and
rows grow with ranges and with distinct addresses, never with their product.

Blocks of more than 2^16 addresses are at most 2^16 in number for each size; they are broadcast, as each may
hold many addresses. A smaller block holds at most 2^16 distinct addresses, so no key of the shuffled join is hot.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.operators.lookups import BROADCAST_BYTES, join_lookup

BITS = 32
LAST = (1 << BITS) - 1  # the last address
WIDE = 16  # blocks of more than 2^WIDE addresses are broadcast: fewer than 2^(BITS - WIDE) of them in all


def aligned_blocks(ranges: DataFrame) -> DataFrame:
    """Every range start..end with each of its blocks: ``2^bits`` addresses from ``prefix << bits``.

    On each size the part of the range that whole blocks of it cover has an odd block at its left end or at its right
    end that no larger block takes. Sizes beyond the range's own are not tried.
    """
    one = F.lit(1).cast("bigint")
    odd = lambda n: n.bitwiseAND(one) == 1
    first, stop = F.col("_first"), F.col("_stop")
    sizes = F.sequence(F.lit(0), F.length(F.bin(F.col("end") - F.col("start") + 1)) - 1)
    return (
        ranges.withColumn("bits", F.explode(sizes))
        .withColumns({"_first": F.expr("shiftright(start + shiftleft(1L, bits) - 1, bits)"), "_stop": F.expr("shiftright(end + 1, bits)")})
        .where(first < stop)
        .withColumn("prefix", F.explode(F.array(F.when(odd(first), first), F.when(odd(stop), stop - 1))))
        .where("prefix is not null")
        .drop("_first", "_stop")
    )


def distinct_ranges(ranges: DataFrame) -> DataFrame:
    """start, end, location and ``rank`` of every range within the address space, each once.

    The greater rank counts where ranges overlap: the one that starts last; of those, the shortest. It is a number, so
    that ranges are compared without their locations. Of ranges with equal ends the greatest location counts. Ranges that end
    before they start, or have a null end, hold nothing; what lies beyond the address space is cut off.
    """
    rows = ranges.where("ip_start <= ip_end").select(
        F.greatest("ip_start", F.lit(0)).cast("bigint").alias("start"),
        F.least("ip_end", F.lit(LAST)).cast("bigint").alias("end"),
        "location",
    )
    named = rows.where("start <= end").groupBy("start", "end").agg(F.max("location").alias("location"))
    rank = F.shiftleft(F.col("start") - (1 << BITS - 1), BITS) + (F.lit(LAST) - F.col("end"))
    return named.withColumn("rank", rank)


def winners(distinct: DataFrame) -> DataFrame:
    """The greatest rank (``best``) of every block, named by bits and prefix, that some of the distinct ranges has."""
    return aligned_blocks(distinct.select("start", "end", "rank")).groupBy("bits", "prefix").agg(F.max("rank").alias("best"))


def locations(df: DataFrame, ranges: DataFrame, ip_col: str = "ip") -> DataFrame:
    """``location`` of every distinct address that lies in a range. Runs a job, to see which sizes of blocks occur."""
    addresses = df.select(F.col(ip_col).cast("bigint").alias("at")).where(F.col("at").between(0, LAST)).distinct()
    distinct = distinct_ranges(ranges)
    blocks = winners(distinct)
    spans = ranges.where("ip_start <= ip_end").select(
        F.greatest("ip_start", F.lit(0)).cast("bigint").alias("start"), F.least("ip_end", F.lit(LAST)).cast("bigint").alias("end")
    ).where("start <= end")
    occurring = aligned_blocks(spans).agg(F.bit_or(F.expr("shiftleft(1L, bits)"))).first()[0] or 0
    sizes = [bits for bits in range(BITS + 1) if occurring >> bits & 1]

    def found(bits, side):
        prefixes = addresses.select("at", F.explode(F.array(*[F.lit(b) for b in bits])).alias("bits"))
        prefixes = prefixes.withColumn("prefix", F.expr("shiftright(at, bits)"))
        return prefixes.join(side(blocks.where(F.col("bits").isin(bits))), ["bits", "prefix"]).select("at", "best")

    rows = blocks.where("false").select(F.col("prefix").alias("at"), "best")
    if narrow := [b for b in sizes if b <= WIDE]:
        rows = found(narrow, lambda side: side)
    if wide := [b for b in sizes if b > WIDE]:
        rows = rows.unionByName(found(wide, F.broadcast))
    best = rows.groupBy("at").agg(F.max("best").alias("rank"))
    return best.join(distinct.select("rank", "location"), "rank").select(F.col("at").alias(ip_col), "location")


def locate_ips(
    df: DataFrame, ranges: DataFrame, ip_col: str = "ip", max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds ``location``, null where no range (ip_start, ip_end, location) holds the address."""
    found = locations(df, ranges, ip_col)
    return join_lookup(df, found, [ip_col], "left", max_lookup_bytes, costly=True)
