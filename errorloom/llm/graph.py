"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.llm.common import scratch, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), the component being its least node.

    Large-star and small-star steps in turn: each moves links to the least neighbour until all links of a
    component lead to its least node, in a number of rounds that grows with the logarithm of its size.
    Least neighbours are found with partial sums, and the joins on them can be split where a node is hot.
    """
    with scratch(links.sparkSession):
        edges = _stars(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
        seen = None
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
            large = _stars(
                both.join(stored(least, "least"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            )
            least = stored(large.groupBy("a").agg(F.min("b").alias("least")), "least")
            small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            edges = _stars(small.unionByName(least.select("a", F.col("least").alias("b"))))
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return stored(nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()), "components", kept=True)


def _stars(edges: DataFrame) -> DataFrame:
    return stored(edges.where("a <> b").distinct(), "edges")
