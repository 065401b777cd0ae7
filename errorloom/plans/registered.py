"""The registered queries: every operator over the driver's tables."""

import uuid

from pyspark.sql import functions as F

from errorloom import fixtures as fx
from errorloom.config import Config, shared_folder
from errorloom.functions import request, text, times, useragent
from errorloom.operators import agents, beacons, browsers, feed, geo, manage, summaries, templates
from errorloom.operators.tallies import tally
from errorloom.plans import compaction, ingest, reporting, resolving
from errorloom.sources.tables import location, read_table
from errorloom.streaming import live
from errorloom.streaming.ingest import start_stream

FILE = "http://cdn.example.com/js/error.js"


def _reports(spark, sf_dir):
    return fx.reports(fx.events(spark, sf_dir))


def _raw(spark, sf_dir):
    return fx.raw_beacons(fx.events(spark, sf_dir))


def _scratch(spark):
    return f"{shared_folder(spark).rstrip('/')}/errorloom-{uuid.uuid4().hex}"


def _plain_feed(spark, sf_dir):
    return feed.open_reports(_reports(spark, sf_dir), fx.browsers(spark))


# --- the feed ---------------------------------------------------------------------------------


def open_reports(spark, sf_dir):
    rows = _plain_feed(spark, sf_dir)
    return rows.select("*", "browser.type", "browser.version").drop("browser")


def feed_json(spark, sf_dir):
    return feed.feed_json(_plain_feed(spark, sf_dir))


def display_labels(spark, sf_dir):
    return feed.display_labels(_plain_feed(spark, sf_dir))


def report_count(spark, sf_dir):
    return feed.only_open(_reports(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


def epoch_times(spark, sf_dir):
    return _reports(spark, sf_dir).select("id", times.epoch_millis(F.col("date")).alias("millis"))


# --- reports ----------------------------------------------------------------------------------


def message_counts(spark, sf_dir):
    groups = summaries.message_groups(tally(_reports(spark, sf_dir)))
    return groups.select("hash", "times", "first_id", "first_report", "last_report")


def message_summary(spark, sf_dir):
    return summaries.message_summary(tally(_reports(spark, sf_dir)), fx.browsers(spark))


def message_age(spark, sf_dir):
    aged = summaries.with_age(message_summary(spark, sf_dir), fx.AS_OF)
    return aged.select("hash", "age_hours", "last_age_hours", "active_hours")


def browser_summary(spark, sf_dir):
    return summaries.browser_summary(tally(_reports(spark, sf_dir), "browser"), fx.browsers(spark))


def browser_display(spark, sf_dir):
    return browser_summary(spark, sf_dir).select(
        "first_id",
        text.icon_key(F.col("type")).alias("icon_key"),
        text.submissions_label(F.col("times"), F.col("versions")).alias("submissions"),
    )


def browser_summary_since_newest(spark, sf_dir):
    return summaries.browser_summary_since_newest_version(_reports(spark, sf_dir), fx.browsers(spark))


def browser_versions(spark, sf_dir):
    return summaries.browser_versions(tally(_reports(spark, sf_dir), "browser"), fx.browsers(spark))


def browser_versions_one(spark, sf_dir):
    tallies = tally(_reports(spark, sf_dir), "browser")
    return summaries.browser_versions(tallies, fx.browsers(spark), type="Chrome")


def browser_by_name(spark, sf_dir):
    rows = _plain_feed(spark, sf_dir)
    named = useragent.is_browser(F.col("browser.type"), "  internet EXPLORER ")
    return rows.where(named).select("id", F.col("browser.type").alias("type"), "hash")


def script_summary(spark, sf_dir):
    return summaries.script_summary(tally(_reports(spark, sf_dir), "file"))


def message_templates(spark, sf_dir):
    return templates.message_templates(tally(fx.varied_reports(fx.events(spark, sf_dir)), "message"))


def exported_feed(spark, sf_dir):
    path = _scratch(spark)
    feed.export_json(_plain_feed(spark, sf_dir), path)
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.col("value").alias("json"))


def script_details(spark, sf_dir):
    return summaries.script_details(_reports(spark, sf_dir), fx.browsers(spark), FILE)


# --- requests ---------------------------------------------------------------------------------


def decoded_beacons(spark, sf_dir):
    return beacons.decode_requests(_raw(spark, sf_dir)).select("id", "message", "file", "line")


def encoded_beacons(spark, sf_dir):
    rows = _reports(spark, sf_dir)
    return rows.select(
        "id",
        request.url_encode(F.col("message")).alias("message"),
        request.url_encode(F.col("file")).alias("url"),
    )


def client_ip(spark, sf_dir):
    return beacons.client_ip(_raw(spark, sf_dir)).select("id", "ip_text", "ip")


def client_ip_strict(spark, sf_dir):
    return beacons.client_ip(_raw(spark, sf_dir), multi_ip="reject").select("id", "ip")


def ingest_rejects(spark, sf_dir):
    return beacons.rejects(beacons.triage(_raw(spark, sf_dir)))


def screen_keywords(spark, sf_dir):
    rows = fx.untrusted_requests(fx.events(spark, sf_dir))
    return beacons.screen(rows).select("id", "verdict")


def range_check(spark, sf_dir):
    rows = fx.untrusted_requests(fx.events(spark, sf_dir))
    value = request.parameter(F.col("query_string"), "n")
    return rows.select("id", beacons.range_check(value, 10, 60).alias("verdict"))


def verify_signed(spark, sf_dir):
    rows = fx.signed_requests(fx.events(spark, sf_dir))
    return beacons.verify_signed(rows).select("id", "verdict")


# --- user agents and the browser dimension ----------------------------------------------------


def _enriched(spark, sf_dir):
    return agents.enrich_user_agents(_raw(spark, sf_dir)).withColumn("event_id", F.col("id") - 1)


def ua_type(spark, sf_dir):
    return _enriched(spark, sf_dir).select("event_id", "type", "version")


def ua_platform(spark, sf_dir):
    return _enriched(spark, sf_dir).select("event_id", "platform")


def ua_flags(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "event_id", "is_mobile", "is_robot", "is_aol", "aol_version", "is_chromeframe"
    )


def ua_rules_by_row(spark, sf_dir):
    rows = agents.apply_rules(_raw(spark, sf_dir))
    return rows.select((F.col("id") - 1).alias("event_id"), "type", "version", "platform")


def _events_with_browser(spark, sf_dir):
    events = beacons.accepted(beacons.triage(_raw(spark, sf_dir)))
    return agents.enrich_user_agents(events)


def new_browsers(spark, sf_dir):
    found = browsers.new_browsers(_events_with_browser(spark, sf_dir), fx.browsers(spark))
    return found.select("id", "type", "version", "date")


def facts_with_browser_id(spark, sf_dir):
    events = _events_with_browser(spark, sf_dir)
    known = fx.browsers(spark)
    every = known.unionByName(browsers.new_browsers(events, known))
    return browsers.attach_browser_id(events, every).select("id", "browser")


def geo_enriched(spark, sf_dir):
    located = geo.locate_ips(_reports(spark, sf_dir), fx.ip_ranges(spark, sf_dir))
    return located.select("id", "location")


def geo_enriched_nested(spark, sf_dir):
    located = geo.locate_ips(_reports(spark, sf_dir), fx.nested_ranges(spark, sf_dir))
    return located.select("id", "location")


def ua_chromeframe(spark, sf_dir):
    agent = F.when(F.col("id") % 5 == 0, F.concat("user_agent", F.lit(" chromeframe/1.0"))).otherwise(F.col("user_agent"))
    rows = agents.enrich_user_agents(_raw(spark, sf_dir).withColumn("user_agent", agent))
    return rows.select((F.col("id") - 1).alias("event_id"), "is_chromeframe")


# --- ingest, at rest and on arrival -----------------------------------------------------------


def _ingested(spark, sf_dir):
    config = Config(write_uri=_scratch(spark))
    ingest.run_batch(_raw(spark, sf_dir), config, batch_id=0)
    return config


def ingested_reports(spark, sf_dir):
    config = _ingested(spark, sf_dir)
    return read_table(spark, config.write_uri, "reports").drop("day", "batch_id")


def ingested_browsers(spark, sf_dir):
    return read_table(spark, _ingested(spark, sf_dir).write_uri, "browsers")


def written_reports(spark, sf_dir):
    config = _ingested(spark, sf_dir)
    out = _scratch(spark)
    reporting.write_reports(spark, config, out)
    return spark.read.parquet(location(out, "browser_versions"))


def stream_equals_batch(spark, sf_dir):
    config = Config(write_uri=_scratch(spark))
    raw = fx.raw_beacons(fx.stream_events(spark, sf_dir))
    start_stream(raw, config, _scratch(spark), {"availableNow": True}).awaitTermination()
    return reporting.running_summaries(spark, config)["message_summary"]


def _ingested_in_slices(spark, sf_dir, count, compact_at):
    config = Config(write_uri=_scratch(spark), compact_at=compact_at)
    for number, rows in enumerate(fx.event_slices(fx.events(spark, sf_dir), count)):
        ingest.run_batch(fx.raw_beacons(rows), config, number)
    return config


def compacted_summary(spark, sf_dir):
    config = _ingested_in_slices(spark, sf_dir, 4, compact_at=2)
    return reporting.running_summaries(spark, config)["message_summary"]


def compacted_reports(spark, sf_dir):
    config = _ingested_in_slices(spark, sf_dir, 3, compact_at=2)
    return read_table(spark, config.write_uri, "reports").drop("day", "batch_id")


def load_then_stream(spark, sf_dir):
    config = Config(write_uri=_scratch(spark), compact_at=2)
    first, *rest = fx.event_slices(fx.events(spark, sf_dir), 4)
    ingest.run_batch(fx.raw_beacons(first), config, 0)
    raw = fx.raw_beacons(fx.arriving_events(rest, _scratch(spark)))
    start_stream(raw, config, _scratch(spark), {"availableNow": True}).awaitTermination()
    return reporting.running_summaries(spark, config)["message_summary"]


def _live(spark, sf_dir, summarise, *keys, mode="update"):
    path = _scratch(spark)
    slices = fx.event_slices(fx.events(spark, sf_dir), 4)
    feed_rows = live.live_feed(fx.raw_beacons(fx.arriving_events(slices, _scratch(spark))))
    live.start_live(
        summarise(feed_rows), path, _scratch(spark), keys, {"availableNow": True}, mode, fan=2
    ).awaitTermination()
    return live.current(spark, path, *keys)


def live_messages(spark, sf_dir):
    return _live(spark, sf_dir, live.live_message_summary, "hash")


def live_browsers(spark, sf_dir):
    return live.browser_summary(_live(spark, sf_dir, live.live_browser_versions, "type", "version_key"))


def live_scripts(spark, sf_dir):
    return _live(spark, sf_dir, live.live_script_summary, "file", mode="complete")


def ingest_outcomes(spark, sf_dir):
    config = Config(write_uri=_scratch(spark), multi_ip="reject", screen_keywords=True, require_signature=True)
    ingest.run_batch(fx.outcome_requests(fx.events(spark, sf_dir)), config, batch_id=0)
    rejected = read_table(spark, config.write_uri, "rejects").select("id", F.col("reject_reason").alias("outcome"))
    return rejected.union(read_table(spark, config.write_uri, "reports").select("id", F.lit("accepted")))


def _partly_resolved(spark, sf_dir):
    """Errors fixed after half of the events came in, others deleted after all did, then parts merged."""
    config = Config(write_uri=_scratch(spark), compact_at=0)
    first, second = fx.event_slices(fx.events(spark, sf_dir), 2)
    ingest.run_batch(fx.raw_beacons(first), config, 0)
    known = resolving.stored(spark, config.write_uri, "reports")
    resolving.resolve_stored(spark, config, fx.fixed_hashes(known), fx.AS_OF)
    ingest.run_batch(fx.raw_beacons(second), config, 1)
    known = resolving.stored(spark, config.write_uri, "reports")
    resolving.resolve_stored(spark, config, fx.dropped_hashes(known), fx.AS_OF, resolving.DELETED)
    return config


def feed_after_resolve(spark, sf_dir):
    config = _partly_resolved(spark, sf_dir)
    return resolving.stored(spark, config.write_uri, "reports").select("id", "status")


def running_after_resolve(spark, sf_dir):
    config = _partly_resolved(spark, sf_dir)
    return reporting.running_summaries(spark, config)["message_summary"]


def compacted_after_resolve(spark, sf_dir):
    config = _partly_resolved(spark, sf_dir)
    compaction.compact(spark, _with_third_batch(spark, config).write_uri, fan=2)
    return reporting.running_summaries(spark, config)["script_summary"]


def _with_third_batch(spark, config):
    """An empty batch, which makes the two before it old enough to merge."""
    ingest.run_batch(fx.raw_beacons(spark.createDataFrame([], fx.EVENTS)), config, 2)
    return config


# --- looking after known errors ---------------------------------------------------------------


def resolve(spark, sf_dir):
    rows = _reports(spark, sf_dir)
    return manage.resolve(rows, fx.fixed_hashes(rows)).select("id", "status")


def delete(spark, sf_dir):
    rows = _reports(spark, sf_dir)
    return manage.delete(rows, fx.fixed_hashes(rows)).select("id", "status")


def affected(spark, sf_dir):
    return manage.affected(_reports(spark, sf_dir), fx.browsers(spark), browser="Firefox", file=FILE)


def affected_by_line(spark, sf_dir):
    return manage.affected(_reports(spark, sf_dir), fx.browsers(spark), line=42)


def affected_by_ip(spark, sf_dir):
    return manage.affected(_reports(spark, sf_dir), fx.browsers(spark), ip="10.0.0.7")


def daily_digest(spark, sf_dir):
    return manage.daily_digest(_reports(spark, sf_dir))


def message_browsers(spark, sf_dir):
    return manage.message_browsers(tally(_reports(spark, sf_dir), "message", "line", "browser"))


def message_browser_counts(spark, sf_dir):
    tallies = tally(_reports(spark, sf_dir), "message", "line", "browser")
    # Reports name a browser that the dimension does not have: it is numbered too.
    known = fx.browsers(spark).select("id").union(tallies.select("browser"))
    return manage.affected_counts(manage.affected_browsers(tallies, manage.number_browsers(known)))


def strict_fingerprint(spark, sf_dir):
    return manage.strict_messages(_reports(spark, sf_dir))


QUERIES = {
    query.__name__: query
    for query in (
        open_reports,
        feed_json,
        display_labels,
        report_count,
        epoch_times,
        message_counts,
        message_summary,
        message_age,
        browser_summary,
        browser_display,
        browser_summary_since_newest,
        browser_versions,
        browser_versions_one,
        browser_by_name,
        script_summary,
        script_details,
        message_templates,
        exported_feed,
        decoded_beacons,
        encoded_beacons,
        client_ip,
        client_ip_strict,
        ingest_rejects,
        screen_keywords,
        range_check,
        verify_signed,
        ua_type,
        ua_platform,
        ua_flags,
        ua_chromeframe,
        ua_rules_by_row,
        new_browsers,
        facts_with_browser_id,
        geo_enriched,
        geo_enriched_nested,
        ingested_reports,
        ingested_browsers,
        written_reports,
        stream_equals_batch,
        compacted_summary,
        compacted_reports,
        load_then_stream,
        ingest_outcomes,
        feed_after_resolve,
        running_after_resolve,
        compacted_after_resolve,
        live_messages,
        live_browsers,
        live_scripts,
        resolve,
        delete,
        affected,
        affected_by_line,
        affected_by_ip,
        daily_digest,
        message_browsers,
        message_browser_counts,
        strict_fingerprint,
    )
}
