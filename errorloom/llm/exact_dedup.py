"""Exact duplicates by distributed radix partitioning, most significant bytes first.

All documents start in one group. In every round a group is split by the next bytes of its texts (the
digit); a group with one member, or whose texts end within the digit, is finished. Equality rests on
the compared bytes alone, never on a digest. Digits widen eightfold from round to round, so a text of
20 MB takes seven rounds, and only members of groups that are still open travel on.

A digit is counted with partial sums before the shuffle. Members then join the counts, which are a
stored table, by sort and merge at every size: adaptive execution can split a group that holds a large
share of all rows, and the counts, which grow with the corpus, are never broadcast.
"""

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errorloom.llm.common import stored

FIRST_DIGIT = 64
WIDENING = 8


ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def _grouped(docs: DataFrame, id_column: str, text_column: str, whole_rows: bool) -> DataFrame:
    """``row`` (a struct of the columns, or of the id alone) and the columns of ``ADDED``."""
    names = docs.columns if whole_rows else [id_column]
    # Whole rows hold their text; else it travels beside the id as long as the group is open.
    rest = F.col(f"`{text_column}`").cast("string")
    text = F.coalesce(F.col(f"row.`{text_column}`").cast("string") if whole_rows else F.col("text"), F.lit("")).cast("binary")
    active = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_column}`").alias("id"),
        (F.lit(None).cast("string") if whole_rows else rest).alias("text"),
        F.sha2(F.coalesce(rest, F.lit("")).cast("binary"), 256).alias("text_sha256"),
        F.lit(0).cast("bigint").alias("group"),
    )
    finished, done, width = [], 0, FIRST_DIGIT
    while True:
        members = active.withColumn("digit", F.substring(text, done + 1, width))
        groups = stored(
            members.groupBy("group", "digit")
            .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
            .where("n > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            "groups",
        )
        single = F.col("next").isNull()
        ended = single | (F.length("digit") < width)
        split = stored(
            members.join(groups.hint("merge"), ["group", "digit"], "left").select(
                "row",
                "id",
                F.when(~ended, F.col("text")).alias("text"),
                "text_sha256",
                F.col("next").alias("group"),
                F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
                ended.alias("ended"),
            ),
            "members",
        )
        finished.append(split.where("ended").drop("text", "ended"))
        active = split.where("not ended").select("row", "id", "text", "text_sha256", "group")
        if active.isEmpty():
            break
        done, width = done + width, width * WIDENING

    # Only rows that carry their group's greatest id can stay: one per group, or equals.
    may_stay = (F.col("group_size") > 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("group").orderBy("text_sha256")) == 1
    parts = []
    for level in finished:
        parts.append(level.where(~may_stay).withColumn("kept", F.col("group_size") == 1))
        parts.append(level.where(may_stay).withColumn("kept", first))
    return functools.reduce(DataFrame.unionByName, parts).select("row", *ADDED)


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", whole_rows: bool = True
) -> DataFrame:
    """Every row with the group of rows whose text is identical.

    Adds ``keep_id`` (greatest id of the group), ``group_size``, ``kept`` and ``text_sha256``. Without
    ``whole_rows`` only the id comes along. A null text counts as empty. Null ids rank below all
    others, and ``keep_id`` is null if the group has no other. Where several rows of a group carry
    the greatest id, one of them is kept. An empty table gives an empty result. Names of other columns
    are free, as rows travel in a struct; a column named like an added one is replaced.
    """
    names = [c for c in docs.columns if c not in ADDED] if whole_rows else [id_column]
    return _grouped(docs, id_column, text_column, whole_rows).select(*[F.col(f"row.`{c}`") for c in names], *ADDED)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return _grouped(docs, id_column, text_column, True).where("kept").select("row.*")
