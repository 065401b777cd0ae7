"""Ingesting a batch of raw requests."""

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from errorloom import schemas
from errorloom.config import Config
from errorloom.operators.agents import apply_rules, rules_version
from errorloom.operators.beacons import decode_requests, rejects, triage
from errorloom.operators.browsers import attach_browser_id, new_browsers
from errorloom.operators.feed import OPEN
from errorloom.operators.lookups import cut_lineage, measured_bytes
from errorloom.operators.tallies import tally
from errorloom.plans.compaction import compact
from errorloom.sources.log import Log
from errorloom.sources.tables import check_open, commit_batch, location, read_parts, read_table, write_part

STAGED = ["id", "received_at", "ip", "reject_reason", "user_agent", "message", "file", "line"]


def agents_seen(events: DataFrame) -> DataFrame:
    """Distinct user agents with the first event that showed each."""
    return events.groupBy(F.coalesce("user_agent", F.lit("")).alias("user_agent")).agg(
        F.min("id").alias("id"), F.min("received_at").alias("received_at")
    )


def with_outcome(agents: DataFrame, known: DataFrame) -> DataFrame:
    """Agents with type, version and platform, and whether they are ``fresh``: only those go through the rules.

    ``known`` is the stored dictionary, whose outcomes count if the same rules gave them.
    """
    names = ["type", "version", "platform"]
    dictionary = known.where(F.col("rules") == rules_version()).select("user_agent", F.struct(*names).alias("_known"))
    looked_up = cut_lineage(agents.join(dictionary, "user_agent", "left"))
    old = looked_up.where("_known is not null").select(*agents.columns, "_known.*", F.lit(False).alias("fresh"))
    unseen = looked_up.where("_known is null").drop("_known")
    if unseen.isEmpty():
        return old
    new = apply_rules(unseen).select(*agents.columns, *names, F.lit(True).alias("fresh"))
    return cut_lineage(old.unionByName(new))


def to_reports(
    events: DataFrame, agents: DataFrame, browsers: DataFrame, max_dictionary_bytes: int
) -> DataFrame:
    """Accepted events as rows of ``reports``.

    Browser id and platform come from the agent dictionary by broadcast while that measures up to
    the limit; beyond it every row goes through the rules and looks up its pair. Events are shuffled
    only if the browsers themselves outgrow the limit too.
    """
    if measured_bytes(agents) <= max_dictionary_bytes:
        pairs = agents.select(F.col("user_agent").alias("_agent"), "type", "version", "platform")
        known = attach_browser_id(pairs, browsers, max_dictionary_bytes)
        marked = events.withColumn("_agent", F.coalesce("user_agent", F.lit("")))
        enriched = marked.join(F.broadcast(known), "_agent")
    else:
        named = apply_rules(events).select(*events.columns, "type", "version", "platform")
        enriched = attach_browser_id(named, browsers, max_dictionary_bytes)
    return enriched.select(
        "id",
        "file",
        "line",
        "message",
        "browser",
        F.lit(OPEN).alias("status"),
        F.col("received_at").alias("date"),
        "ip",
        "platform",
    )


def stage(raw: DataFrame, config: Config, path: str) -> DataFrame:
    """Reads the raw requests, once: triaged and decoded they are written, narrow, for all tables to be made from."""
    triaged = triage(raw, config.multi_ip, config.screen_keywords, config.require_signature)
    decode_requests(triaged).select(*STAGED).write.parquet(path)
    return raw.sparkSession.read.schema(schemas.STAGED).parquet(path)


def run_batch(raw: DataFrame, config: Config, batch_id: int) -> None:
    """Writes the batch's new browsers and agents, its reports, rejects and tallies, and commits them together.

    Batches are numbered from 0, each number once, and have one writer at a time; streams number theirs
    from ``streaming.ingest.FIRST_BATCH`` on, so loads and a stream do not meet. Running a batch again, whole
    or after a failure half way, gives the same tables: it reads only browsers of earlier batches and
    replaces its own parts. Until the commit readers see the tables as they were. Afterwards parts that have become many are
    merged; a batch that was merged can't be run again.
    """
    spark, uri = raw.sparkSession, config.write_uri
    log = Log(spark, uri)
    base = log.latest()
    check_open(base, batch_id, ("browsers", "agents", "reports", "rejects", "tallies"))
    staging = f"batch-{uuid.uuid4().hex}"
    staged = stage(raw, config, f"{location(uri, '_staging')}/{staging}")
    events = staged.where("reject_reason is null")

    dictionary = read_table(spark, uri, "agents", before_batch=batch_id, missing_ok=True, manifest=base)
    agents = with_outcome(agents_seen(events), dictionary)
    known = read_table(spark, uri, "browsers", before_batch=batch_id, missing_ok=True, manifest=base)
    # Rows brought in from elsewhere sit under a negative batch; event ids start above theirs, so
    # the ids of all other rows are unique as the event ids are.
    imported = read_table(spark, uri, "browsers", before_batch=0, missing_ok=True, manifest=base)
    own = [batch_id]
    browsers = write_part(new_browsers(agents, known, above=imported), uri, "browsers", own)

    def write_reports():
        pairs = known.unionByName(read_parts(spark, uri, "browsers", [browsers]).select(*known.columns))
        reports = to_reports(events, agents, pairs, config.max_dictionary_bytes)
        part = write_part(reports, uri, "reports", own, config.gather_days)
        # Counted from the columns just written, not from the requests again.
        return part, write_part(tally(read_parts(spark, uri, "reports", [part])), uri, "tallies", own)

    def write_others():
        fresh = agents.where("fresh").withColumn("rules", F.lit(rules_version()))
        return write_part(fresh, uri, "agents", own), write_part(rejects(staged), uri, "rejects", own)

    # Neither reads what the other writes, so small batches need not wait twice.
    with ThreadPoolExecutor(2) as pool:
        writes = [pool.submit(inheritable_thread_target(spark)(write)) for write in (write_reports, write_others)]
        parts = [browsers, *(part for write in writes for part in write.result())]
    commit_batch(spark, uri, batch_id, parts)
    log.remove("_staging", staging)
    if config.compact_at:
        compact(spark, uri, config.compact_at)
