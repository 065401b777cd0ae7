"""Exact top-k search by inner product over integer vectors, after MaxScore.

Components are terms, and a shard of vectors is their postings. The least and greatest posting of a term
in the shard, times the query's weight, bound what the term adds; counted from the lower bound, every
term adds between 0 and its spread. Terms are ordered by spread over all queries of a block. For a query the
terms from some place on are non-essential: their spreads together stay below what separates the lower
bounds from the query's k-th best score so far, so no vector competes on them alone. Essential terms are
added up for all vectors; the others are probed, some at a time, only for vectors whose sum plus the
spreads to come still competes. The first rows of a shard, scored in full, give the first thresholds. Shards are
merged by rank.

Queries come in blocks and vectors in shards, both of bounded size, so a task holds one block and one shard.
All queries are run against all rows: the work is queries times rows, as asked for.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 16_384
QUERY_BLOCK = 2_048
ROWS = 2_048
PROBE = 8
SMALL = 1 << 20  # components below this, in up to 4,096 terms, are exact in doubles


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component), components as doubles. A vector with a null or non-finite component is null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; missing components count as 0."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(query, ids, scores, k: int):
    """The k best rows of each query, in order of query, score and id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def search_shard(ids, rows, query_ids, queries, k: int):
    """The k best rows of one shard for each query, but for rows with the query's own id: the query's place,
    id and score. Ties go to the smaller id."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(query_ids):
        return none, none, none
    exact = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)) < SMALL
    kind = np.float64 if exact else np.int64
    least, greatest = rows.min(0), rows.max(0)
    lowest = np.minimum(queries * least, queries * greatest)
    spread = np.abs(queries * (greatest - least))
    terms = np.argsort(-spread.sum(0), kind="stable")
    floors = lowest.sum(1)
    to_come = np.zeros((len(queries), len(terms) + 1), dtype=np.int64)
    to_come[:, :-1] = np.cumsum(spread[:, terms][:, ::-1], 1)[:, ::-1]
    # Postings and weights in the order of terms; a score is ``floors`` plus what exceeds the lower bounds.
    postings, weights = rows[:, terms].astype(kind), queries[:, terms].astype(kind)
    lowered = np.zeros((len(queries), len(terms) + 1), dtype=np.int64)
    lowered[:, 1:] = np.cumsum(lowest[:, terms], 1)

    query, best_ids, best = none, none, none
    for start in range(0, len(ids), ROWS):
        block, block_ids = postings[start : start + ROWS], ids[start : start + ROWS]
        counts = np.bincount(query, minlength=len(queries))
        threshold = np.full(len(queries), np.iinfo(np.int64).min // 4)
        last = np.cumsum(counts) - 1
        threshold[counts == k] = best[last[counts == k]]
        reach = threshold - floors
        # The first place from which the spreads no longer reach the threshold.
        place = (to_come >= reach[:, None]).sum(1)
        essential = int(min(place.max(), len(terms)))
        sums = block[:, :essential] @ weights[:, :essential].T
        open_ = sums + (to_come[:, essential] - lowered[:, essential]) >= reach
        open_ &= block_ids[:, None] != query_ids
        if essential == len(terms) and len(block) > k:
            kth = np.partition(np.where(open_, sums, np.iinfo(np.int64).min // 4), len(block) - k, axis=0)[len(block) - k]
            open_ &= sums >= kth
        row, of = np.nonzero(open_)
        score, at = sums[row, of], essential
        while at < len(terms) and len(row):
            to = min(len(terms), at + PROBE)
            score = score + np.einsum("ij,ij->i", block[row, at:to], weights[of, at:to])
            at = to
            competes = score + (to_come[of, at] - lowered[of, at]) >= reach[of]
            row, of, score = row[competes], of[competes], score[competes]
        query, best_ids, best = _best(
            np.concatenate([query, of]),
            np.concatenate([best_ids, block_ids[row]]),
            np.concatenate([best, score.astype(np.int64)]),
            k,
        )
    return query, best_ids, best


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``.

    Both have ``vec_id`` and ``vector``, an array of long; other columns are not read. Rows whose vector
    or id is null take no part. A row is no answer to the query with its own id; of rows that repeat an id each is a
    candidate, and of queries that do, the one with the greatest vector counts. Vectors of unequal length
    are compared as if the shorter ended in zeros. Fewer than k candidates give fewer rows, none give none.
    Scores must fit a long.
    """
    rows = vectors.where("vec_id is not null and vector is not null").select(F.col("vec_id").cast("bigint"), "vector")
    asked = (
        queries.where("vec_id is not null and vector is not null")
        .groupBy(F.col("vec_id").cast("bigint").alias("query_id")).agg(F.max("vector").alias("vector"))
    )
    totals = rows.agg(F.count(F.lit(1))).first()[0], asked.agg(F.count(F.lit(1))).first()[0]
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(totals, (SHARD, QUERY_BLOCK)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    left = rows.select("vec_id", "vector", shard, every(blocks, "block"))
    right = asked.select("query_id", "vector", block, every(shards, "shard"))

    def searched(key, own, ask):
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, own["vector"])), max(map(len, ask["vector"])))
        ids, asking = own["vec_id"].to_numpy(np.int64), ask["query_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        query, found, scores = search_shard(
            ids[order], _matrix(own["vector"], width)[order], asking, _matrix(ask["vector"], width), k
        )
        return pd.DataFrame({"query_id": asking[query], "vec_id": found, "score": scores})

    found = (
        left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
        .applyInPandas(searched, "query_id bigint, vec_id bigint, score bigint")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
