"""Keeping the number of parts small, however long batches keep arriving.

Parts of a table have levels. Batches are level 0; once more than ``fan`` parts have a level, the oldest ``fan`` are
merged into one of the next level, so a table of n batches has at most ``fan`` parts on each of log(n) levels and every
row is rewritten once per level. Tallies merge by adding up: a level holds a row per error and not one
per error and batch. The newest batch is never merged, as a stream may run it again.

A merge is a commit of its own: readers see the parts or what they were merged into, with equal sums.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errorloom.operators.agents import rules_version
from errorloom.operators.tallies import KEYS, regroup
from errorloom.plans.resolving import resolved
from errorloom.sources.log import Log, Manifest
from errorloom.sources.tables import TABLES, read_parts, write_part

FAN = 8


def _agents(rows: DataFrame) -> DataFrame:
    """One row per agent, without the outcome of rules that have changed since."""
    rows = rows.where(F.col("rules") == rules_version())
    return rows.groupBy("user_agent").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "user_agent"]), "batch_id").alias("r")).select("user_agent", "r.*")


def _resolutions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash", "action").agg(F.max("through").alias("through"), F.max("date").alias("date"))


MERGES = {
    "tallies": lambda rows: regroup(rows, *KEYS),
    "reports": lambda rows: rows,
    "rejects": lambda rows: rows.hint("rebalance"),
    "browsers": lambda rows: rows.hint("rebalance"),
    "agents": _agents,
    "resolutions": _resolutions,
}


def crowded(manifest: Manifest, fan: int):
    """The parts to merge next: the oldest ``fan`` of a level that has more, or nothing."""
    for name in TABLES:
        parts = manifest.of(name)
        for level in sorted({part.level for part in parts}):
            same = [part for part in parts if part.level == level]
            if len(same) > fan:
                return sorted(same, key=lambda part: (part.batches or ((part.since, 0),), part.since))[:fan]
    return []


def compact(spark: SparkSession, uri: str, fan: int = FAN) -> Manifest:
    """Merges until no level is crowded. Killed half way, it leaves the tables as they were or with some merges done."""
    if fan < 2:
        raise ValueError("merging needs at least two parts")
    log = Log(spark, uri)
    manifest = log.latest()
    while parts := crowded(manifest, fan):
        name = parts[0].table
        rows = resolved(spark, uri, name, parts, manifest)
        merged = write_part(
            MERGES[name](rows), uri, name, [run for part in parts for run in part.batches],
            gather_days=TABLES[name].by_day, level=parts[0].level + 1,
        )
        manifest = log.commit(manifest, [merged], parts)
    return manifest
