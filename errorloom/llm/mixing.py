"""Mixing sources to target weights by fitting a budget of words.

Documents are counted by source and exact size. Each source's budget is filled with whole copies of all
its documents, then with a share of every size, then by a bounded knapsack over the counts that are
left, so that the rest of the budget is met to the word wherever a subset of sizes can meet it. Which
documents of a size are taken is a seeded choice.

Only counts reach the knapsack: per source as many rows as it has distinct sizes. A choice among the
documents of one source and size is made in ``BUCKETS`` buckets of the seeded hash, so that no group of
equal sizes, however large, is ranked in one task.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errorloom.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BUCKETS = 4096
ADDED = ("size", "source_size", "target", "copies")
EXACT_WORDS = 1 << 15  # the knapsack settles the last words of a budget


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """Per source its ``target``, from its ``source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share`` of all words.
    No target passes ``MOST_COPIES`` times its source; the excess goes to the others by weight. That
    is a common level of words per unit of weight, found by going through the sources from the first
    to reach its limit: while limits are passed the level rises, then it falls, so it is the maximum.
    ``sizes`` has one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(MOST_COPIES))
    earlier = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("words_left", F.sum("source_size").over(everything) * F.lit(share)
                    - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", F.max(F.col("words_left") / F.col("weight_left")).over(everything))
    )
    return leveled.select("source", "source_size",
                          F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def fit(sizes: list, counts: list, budget: int) -> list:
    """How many of each size to take, so that their sum comes as near to ``budget`` from below as it can.

    A proportional share of every size first, then the largest sizes down to ``EXACT_WORDS`` of rest,
    then a bounded knapsack: bit s of an integer says that some subset sums to s, and a count is added in
    powers of two.
    """
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    taken = [n * min(budget, total) // total if s else 0 for s, n in zip(sizes, counts)]
    rest = min(budget, total) - sum(s * k for s, k in zip(sizes, taken))
    order = sorted((i for i, s in enumerate(sizes) if s), key=lambda i: -sizes[i])
    for i in order:
        more = min(counts[i] - taken[i], max(0, rest - EXACT_WORDS) // sizes[i])
        taken[i] += more
        rest -= more * sizes[i]
    sums, steps, within = 1, [], (1 << (rest + 1)) - 1
    for i in order:
        left, part = min(counts[i] - taken[i], rest // sizes[i]), 1
        while left and not sums >> rest & 1:
            part = min(part, left)
            steps.append((i, part, sums))
            sums |= (sums << part * sizes[i]) & within
            left, part = left - part, part * 2
    reached = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> reached & 1:
            taken[i] += part
            reached -= part * sizes[i]
    return taken


def _plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies and the number of further documents for each size of one source."""
    sizes, counts = rows["size"].astype(int).tolist(), rows["n"].astype(int).tolist()
    whole = sum(s * n for s, n in zip(sizes, counts))
    budget = min(round(float(rows["target"].iloc[0])), MOST_COPIES * whole)
    copies = budget // whole if whole else 0
    return rows[["source", "size", "source_size", "target"]].assign(
        copies=copies, more=fit(sizes, counts, budget - copies * whole)
    )


def mix(docs: DataFrame, size: Column, id_column: str = "doc_id", source_column: str = "source",
        seed: int = 7, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes it).

    A null source is a source of its own, a null size counts as 0; documents of size 0 are never
    taken beyond whole copies. A null id is an id like any other. Of rows that repeat an id each
    counts, and equal rows are interchangeable. An empty table gives an empty result.
    """
    bucket = F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.lit(seed)), F.lit(BUCKETS)).cast("int")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("row"),
        F.col(f"`{source_column}`").alias("source"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        bucket.alias("bucket"),
        F.xxhash64(F.lit(seed + 1), F.col(f"`{id_column}`")).alias("order"),
    )
    counts = stored(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = stored(targets(sizes, weights, share), "targets")
    same_source = F.col("l.source").eqNullSafe(F.col("r.source"))
    plan = (
        by_size.alias("l").join(aims.alias("r"), same_source)
        .select("l.source", "l.size", "l.n", "r.source_size", "r.target")
        .groupBy("source")
        .applyInPandas(_plan_source, "source string, size bigint, source_size bigint, target double, "
                                     "copies bigint, more bigint")
    )
    plan = stored(plan, "plan")
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same_size = same_source & (F.col("l.size") == F.col("r.size"))
    quota = stored(
        counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("l")
        .join(plan.alias("r"), same_size)
        .select("l.source", "l.size", "l.bucket", "r.source_size", "r.target", "r.copies",
                (F.col("r.more") - F.col("l.before")).alias("more")),
        "quota",
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order"))
    same = same_size & (F.col("l.bucket") == F.col("r.bucket"))
    return (
        rows.withColumn("place", place).alias("l").join(quota.alias("r"), same)
        .select("l.row.*", "l.size", "r.source_size", "r.target",
                (F.col("r.copies") + (F.col("l.place") <= F.col("r.more")).cast("bigint")).alias("copies"))
    )


def take(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it."""
    mixed = mix(docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_doc"),
                            F.col(options.pop("id_column", "doc_id")).alias("doc_id"),
                            F.col(options.pop("source_column", "source")).alias("source"),
                            size.alias("_size")), F.col("_size"), **options)
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return mixed.where("copies > 0").select("_doc", times.alias("_time")).select("_doc.*")
