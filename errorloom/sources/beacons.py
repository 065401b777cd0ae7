"""Reading raw requests, at rest or on arrival."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorloom.schemas import RAW_BEACONS

FILE_FORMATS = ("parquet", "json", "csv", "orc")
KAFKA_PARTITION_BITS = 12


def read_beacons(spark: SparkSession, path: str, file_format: str = "parquet", **options) -> DataFrame:
    """All requests under the path."""
    return _reader(spark.read, file_format, options).load(path)


def stream_beacons(spark: SparkSession, path: str, file_format: str = "parquet", **options) -> DataFrame:
    """Requests as their files arrive under the path."""
    return _reader(spark.readStream, file_format, options).load(path)


def _reader(reader, file_format, options):
    if file_format not in FILE_FORMATS:
        raise ValueError(f"file_format must be one of {FILE_FORMATS}, not {file_format!r}")
    return reader.format(file_format).schema(RAW_BEACONS).options(**options)


def from_kafka(records: DataFrame) -> DataFrame:
    """Requests from Kafka records (batch or streaming) whose values are JSON objects.

    A record's offset and partition make up its id, for one topic of up to 4,096 partitions. A record that
    does not fit stops the query with an error, as its id could be another record's.
    """
    fields = ["query_string", "user_agent", "xff", "remote_addr", "received_at"]
    value = F.from_json(F.col("value").cast("string"), RAW_BEACONS)
    partition = F.col("partition").cast("bigint")
    fits = (partition < 1 << KAFKA_PARTITION_BITS) & (F.col("offset") < 1 << 63 - KAFKA_PARTITION_BITS)
    offset_id = F.when(
        fits, F.shiftleft(F.col("offset"), KAFKA_PARTITION_BITS).bitwiseOR(partition)
    ).otherwise(F.raise_error(F.lit(f"Kafka ids need partitions below {1 << KAFKA_PARTITION_BITS}")))
    return records.select(offset_id.alias("id"), value.alias("request")).select(
        "id", *[F.col(f"request.{name}") for name in fields]
    ).select(*RAW_BEACONS.fieldNames())
