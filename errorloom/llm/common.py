"""Helpers that the operators share."""

import ctypes
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom.config import shared_folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Open(threading.local):
    def __init__(self):
        self.scopes = []


_open = _Open()


class Scratch:
    """The tables that ``stored`` makes within a ``with`` of it, for removal once nothing reads them any more."""

    def __init__(self, spark, at_end: bool = False):
        self.spark, self.at_end, self.paths = spark, at_end, []

    def __enter__(self):
        _open.scopes.append(self)
        return self

    def __exit__(self, *failure):
        _open.scopes.remove(self)
        if self.at_end:
            self.remove()

    def remove(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(self.paths.pop()).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def scratch(spark) -> Scratch:
    """A ``with`` at whose end the tables stored within are gone, but for those that are ``kept``."""
    return Scratch(spark, at_end=True)


def stored(df: DataFrame, name: str, kept: int = 0, within: Scratch | None = None) -> DataFrame:
    """The rows written to the cluster's shared folder and read back: lineage ends here.

    Losing an executor afterwards loses nothing, and reading twice computes nothing twice. Shuffle files of the
    write go with its end. A table that is ``kept`` belongs to the scratch so many levels around the innermost, if there
    is one; ``within`` names its scratch.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    owners = [within] if within else _open.scopes[: max(0, len(_open.scopes) - kept)]
    if owners:
        owners[-1].paths.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(spark) -> int:
    """As many parts as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, modulus: int):
    """crc32 of a value as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows at a time, as rows are whole texts here: in Arrow batches, and in those that parquet is read in, whose buffers double.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.parquet.columnarReaderBatchSize": 512}
#: Reading all ranges of a file at once leaves every reading thread with direct buffers of whole column chunks.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def ship(spark) -> None:
    """Readies a session: sends this library to the executors, for jobs that were not submitted with it, and
    bounds what is read at a time (``BATCHES``, ``VECTORED``)."""
    context = spark.sparkContext
    for name, rows in BATCHES.items():
        if int(spark.conf.get(name)) > rows:
            spark.conf.set(name, str(rows))
    if spark.conf.get(VECTORED, None) is None:
        spark.conf.set(VECTORED, "false")
    if getattr(context, "_errorloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="errorloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(root.rglob("*.py")):
            files.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._errorloom_shipped = True


def give_back() -> None:
    """Returns memory that is free to the system. Arrow and the C library keep it else, for as long as the Python
    worker lives, which serves all later jobs too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(function):
    """A function over batches, for ``mapInArrow`` and the like, that gives memory back after each of them."""

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from function(each())

    return run


BITS = 23


def maybe_in(ids: DataFrame, column: str):
    """A test for values that are surely not in a column of ids, for skipping rows before a shuffle.

    Ids are hashed into a bitmap of 2^23 bits (1 MB, whatever their number), made on the executors. The
    test is never false for a value that occurs; with many ids it is true more often, which costs time only.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << BITS))
    parts = (
        ids.select(place.alias("at"))
        .groupBy(F.floor(F.col("at") / 32768).alias("part"))
        .agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
        .collect()
    )
    bitmap = np.zeros(1 << BITS >> 3, dtype=np.uint8)
    for row in parts:
        bitmap[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy(np.int64)
        return pd.Series(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return lambda value: test(F.pmod(F.xxhash64(value), F.lit(1 << BITS)))
