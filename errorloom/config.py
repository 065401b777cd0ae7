"""Where the tables live, and the sizes that steer the plans."""

import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """``write_uri`` receives ingested tables, ``read_uri`` (a replica, or the same) serves reports."""

    write_uri: str
    read_uri: str = ""
    multi_ip: str = "first"
    screen_keywords: bool = False
    require_signature: bool = False
    gather_days: bool = False
    # A user-agent dictionary up to this many bytes of text is broadcast; beyond it the rules
    # run on every row instead.
    max_dictionary_bytes: int = 64 * 1024 * 1024
    # More parts of a level than this are merged after a batch; 0 never merges.
    compact_at: int = 8

    @property
    def reports_from(self) -> str:
        return self.read_uri or self.write_uri


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is named, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="errorloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder
