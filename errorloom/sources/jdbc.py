"""Reading and writing the tables in a relational database, over Spark's JDBC source.

Reads go to the replica and writes to the primary, each with its own URL. The database's driver
must be on Spark's class path; none comes with this package.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorloom.sources.tables import SCHEMAS


@dataclass(frozen=True)
class Database:
    read_url: str
    write_url: str
    properties: dict = field(default_factory=dict)


def range_options(lowest: int, highest: int, partitions: int) -> dict:
    """Options that let ``partitions`` tasks read disjoint ranges of ``id``."""
    return {
        "partitionColumn": "id",
        "lowerBound": str(lowest),
        "upperBound": str(highest + 1),
        "numPartitions": str(partitions),
    }


def read_table(spark: SparkSession, db: Database, name: str, partitions: int = 32) -> DataFrame:
    """One of the stored tables, read by ranges of ``id``; filters reach the database."""
    reader = spark.read.format("jdbc").option("url", db.read_url).options(**db.properties)
    span = f"(select min(id) as lo, max(id) as hi from {name}) as span"
    lowest, highest = reader.option("dbtable", span).load().first()
    if lowest is not None:
        reader = reader.options(**range_options(int(lowest), int(highest), partitions))
    rows = reader.option("dbtable", name).load()
    fields = [field for field in SCHEMAS[name].fields if field.name in rows.columns]
    return rows.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in fields])


def append_table(df: DataFrame, db: Database, name: str, connections: int = 32) -> None:
    """Appends the rows over at most ``connections`` connections. Not idempotent: append once."""
    (
        df.write.format("jdbc")
        .mode("append")
        .option("url", db.write_url)
        .option("dbtable", name)
        .option("numPartitions", connections)
        .option("batchsize", 10_000)
        .options(**db.properties)
        .save()
    )
