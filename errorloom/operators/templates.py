"""Merging errors whose messages differ in details only: "… id 17" and "… id 18".

Messages are mined for templates with a parse tree of fixed depth. Numbers, quoted text, addresses and the like are
masked first; what remains is a shape. A leaf of the tree is reached by the number of words and the first ``depth``
words. Within a leaf shapes are alike where they share words: a word stays in the template if at least ``share`` of the
leaf's reports have it in that place, the other words of the place become ``ANY``, and shapes that come out
equal are one template. Words of a place with many variants (names, keys) so fall together, while a few
frequent ones (open, close) keep their templates apart.

Reports never move: tallies are merged by message, then by shape, and a leaf's words are counted from shapes. Counts add
up, so trees of different tasks, days or batches merge by adding them. Of a place at most 1 / ``share`` words
stay, so what a leaf keeps is as long as a few messages, however many shapes it has.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.operators.lookups import BROADCAST_BYTES, join_lookup
from errorloom.operators.tallies import regroup

ANY = "<*>"
DEPTH, SHARE = 2, 0.2
# What is masked, in this order, by what.
MASKS = (
    (r"""'[^']*'|"[^"]*\"""", "<text>"),
    (r"[A-Za-z][A-Za-z0-9+.-]*://[^\s,;)]+", "<url>"),
    (r"\b(?:[0-9A-Fa-f]+-){2,}[0-9A-Fa-f]+\b|\b0[xX][0-9A-Fa-f]+\b", "<hex>"),
    (r"[0-9]+(?:[.:][0-9]+)*", "<n>"),
)


def shape(message: Column) -> Column:
    """The message's words with details masked. Null reads as empty; an empty message has no words."""
    masked = F.coalesce(message, F.lit(""))
    for pattern, mask in MASKS:
        masked = F.regexp_replace(masked, pattern, mask)
    return F.filter(F.split(masked, r"[ \t\n\x0B\f\r]+"), lambda word: word != "")


def message_templates(
    tallies: DataFrame, depth: int = DEPTH, share: float = SHARE, max_lookup_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """template, times, first_id, last_id, first_report, last_report and ``messages``, the number of distinct messages.

    Takes tallies by at least ``message``. An empty table gives an empty one; equal shares keep equal words.
    """
    if depth < 0 or not 0 < share <= 1:
        raise ValueError("depth must not be negative and share must be within (0, 1]")
    messages = regroup(tallies, "message").withColumn("words", shape(F.col("message")))
    shapes = regroup(messages, "words", messages=F.count(F.lit(1)))
    shapes = shapes.withColumns({"_n": F.size("words"), "_head": F.array_join(F.slice("words", 1, depth), " ") if depth else F.lit("")})
    words = shapes.select("_n", "_head", "times", F.posexplode("words").alias("place", "word"))
    counted = words.groupBy("_n", "_head", "place", "word").agg(F.sum("times").alias("times"))
    leaves = regroup_times(shapes)
    frequent = (
        counted.join(leaves, ["_n", "_head"])
        .where(F.col("times") >= F.lit(share) * F.col("_total"))
        .groupBy("_n", "_head")
        .agg(F.collect_list(F.struct("place", "word")).alias("_kept"))
    )
    known = join_lookup(shapes, frequent, ["_n", "_head"], "left", max_lookup_bytes, costly=True)
    kept = F.coalesce("_kept", F.array().cast("array<struct<place:int,word:string>>"))
    template = F.transform(
        "words",
        lambda word, place: F.when(
            (place < depth) | F.array_contains(kept, F.struct(place.cast("int").alias("place"), word.alias("word"))), word
        ).otherwise(ANY),
    )
    named = known.withColumn("template", F.array_join(template, " "))
    return regroup(named, "template", messages=F.sum("messages"))


def regroup_times(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("_n", "_head").agg(F.sum("times").alias("_total"))
