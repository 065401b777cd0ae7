"""Clustering of integer vectors around centroids, by Walsh-Hadamard progressive search.

Vectors and centroids go through the Walsh-Hadamard transform: sums and differences of integers, so it is
exact, and it keeps squared distances up to a factor, the width. Coefficients are taken in the order of their
sign changes, coarse to fine. Differences in the first few coefficients bound every centroid's distance from below;
the centroid with the least bound so far is measured in full, and centroids whose bound is
already greater than that are strictly worse and drop out. Those that are left get the next coefficients, and so
on; what survives has all of them, hence its exact distance, and the smaller number wins ties.

A round is one pass over the vectors: every task keeps the centroids (a few, so they travel with the job) and
adds up its own vectors by cluster, and Spark adds up the tasks' sums. Only k sums come to the driver.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.llm.common import stored

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, "2:"
ROWS = 4_096  # vectors that a task compares at a time
LARGEST = 1 << 27  # squared distances of components below this fit a long
EXACT = 1 << 24  # and below this also 64 times their sums


def usable(vector: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Whether a vector takes part: ``width`` components, none null, non-finite or beyond ``LARGEST`` when scaled."""
    value = lambda x: F.abs(x.cast("double"))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (value(x) < LARGEST / scale))
    return F.coalesce((F.size(vector) == width) & fits, F.lit(False))


def hadamard(width: int) -> np.ndarray:
    """Rows of the transform in the order of their sign changes."""
    if width & (width - 1) or width < 1:
        raise ValueError("the width must be a power of two")
    rows = np.ones((1, 1), dtype=np.int64)
    while len(rows) < width:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")]


def nearest(vectors: np.ndarray, centroids: np.ndarray):
    """Number of and squared distance to each vector's nearest centroid."""
    width = vectors.shape[1]
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    exact = np.int64 if largest < EXACT else object  # Python's integers where long ones would overflow
    transform = hadamard(width).T.astype(exact)
    v, c = vectors.astype(exact) @ transform, centroids.astype(exact) @ transform

    row, number = np.divmod(np.arange(len(v) * len(c)), len(c))
    bound, done = np.zeros(len(row), dtype=exact), 0
    while done < width:
        upto = min(width, max(4, done * 2))
        gap = v[row, done:upto] - c[number, done:upto]
        bound, done = bound + (gap * gap).sum(1), upto
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(bound, first)
        if done < width:
            # One full distance a vector: that of its most promising centroid.
            promising = np.flatnonzero(bound == least[row])
            promising = promising[np.append(True, np.diff(row[promising]) > 0)]
            gap = v - c[number[promising]]
            least = (gap * gap).sum(1)
        alive = np.asarray(bound <= least[row], dtype=bool)
        row, number, bound = row[alive], number[alive], bound[alive]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return number[first], (bound[first] // width).astype(np.int64)


def _blocks(batches, scale: int, width: int):
    """Blocks of vectors as integers with their ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part.column(0), np.floor(values * scale).astype(np.int64).reshape(-1, width)


def first_centroids(vectors: DataFrame, k: int, seed: str, scale: int) -> np.ndarray:
    """The vectors whose ids have the least hashes; rows that share an id are ordered by their components."""
    draw = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(draw.alias("draw"), "vector").orderBy("draw", "vector").limit(k).collect()
    return np.array([[int(np.floor(float(x) * scale)) for x in row["vector"]] for row in rows], dtype=np.int64)


def sums_by_cluster(vectors: DataFrame, centroids: np.ndarray, scale: int):
    """{cluster: (how many vectors, sums of their components)}, for clusters that have any."""
    k, width = centroids.shape

    def summed(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, block in _blocks(batches, scale, width):
            cluster, _ = nearest(block, centroids)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, block)
        have = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(have, pa.int32()), pa.array(count[have]), pa.array(total[have].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    rows = vectors.mapInArrow(summed, "cluster int, n bigint, total array<bigint>")
    rows = rows.select("cluster", "n", F.posexplode("total").alias("place", "total"))
    rows = rows.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = {}
    for row in rows.collect():
        sums.setdefault(row["cluster"], (row["n"], [0] * width))[1][row["place"]] = int(row["total"])
    return sums


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, width: int = WIDTH, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every usable vector.

    ``vectors`` has vec_id and vector; components count as floor(scale * x). ``rounds`` times vectors go to the
    nearest centroid and centroids to the floor of their vectors' mean; empty ones stay. Then vectors are assigned once more.

    Vectors that are null, of another width, or hold null, non-finite or enormous components (2^27 or more when
    scaled, whose distances are beyond a long) take no part; an inertia beyond a long is null. Null and repeated ids give a row each; with fewer vectors than
    ``k`` there are as many centroids as vectors. An empty table gives an empty result. Other columns are not read.
    """
    vectors = vectors.select(F.col("vec_id").cast("bigint"), "vector").where(usable(F.col("vector"), width, scale))
    centroids = first_centroids(vectors, k, seed, scale)
    names = "vec_id bigint, cluster int, distance bigint"
    if not len(centroids):
        schema = f"{names}, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        before = centroids.copy()
        for number, (count, total) in sums_by_cluster(vectors, before, scale).items():
            centroids[number] = [value // count for value in total]
        if (centroids == before).all():
            break  # further rounds would change nothing

    def assigned(batches):
        for ids, block in _blocks(batches, scale, width):
            number, distance = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = stored(vectors.mapInArrow(assigned, names), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fitting = lambda total: total if total < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    everything = fitting(sum(sums.values()))
    facts = [(i, fitting(sums.get(i, 0)), everything, digest(c.tolist()), c.tolist()) for i, c in enumerate(centroids)]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    table = vectors.sparkSession.createDataFrame(facts, schema)  # a row per centroid
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", *table.columns[1:])
