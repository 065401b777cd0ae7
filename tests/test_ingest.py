import json
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from builders import START, dicts, raw
from errorloom import fixtures as fx
from errorloom import schemas
from errorloom.config import Config, shared_folder
from errorloom.golden_agents import GOLDEN_AGENTS
from errorloom.operators.lookups import cut_lineage
from errorloom.plans import ingest, reporting
from errorloom.sources import beacons as sources
from errorloom.sources import jdbc
from errorloom.sources.log import Log, runs
from errorloom.sources.tables import read_table, write_batch
from errorloom.streaming import live
from errorloom.streaming.ingest import start_stream

SF_DIR = "/root/testdata/sf0.001"
NOW = {"availableNow": True}


def tables(spark, uri):
    """Contents of all tables, browser ids resolved to pairs so that they compare across runs."""
    browsers = read_table(spark, uri, "browsers")
    pairs = browsers.select(F.col("id").alias("browser"), "type", "version")
    reports = read_table(spark, uri, "reports").join(pairs, "browser").drop("browser", "batch_id", "day")
    rejects = read_table(spark, uri, "rejects").drop("batch_id", "day")
    return (
        sorted(map(tuple, browsers.select("type", "version", "date").collect())),
        sorted(map(str, reports.select(*sorted(reports.columns)).collect())),
        sorted(map(str, rejects.collect())),
    )


def stored_rows(spark, uri, name):
    return sorted(map(str, read_table(spark, uri, name).collect()))


def batch_tables(spark, raw_df, uri, **options):
    ingest.run_batch(raw_df, Config(write_uri=uri, **options), 0)
    return tables(spark, uri)


@pytest.fixture(scope="module")
def requests(spark):
    return fx.raw_beacons(fx.events(spark, SF_DIR))


@pytest.fixture(scope="module")
def expected(spark, requests, tmp_path_factory):
    uri = str(tmp_path_factory.mktemp("batch"))
    return batch_tables(spark, requests, uri), uri


def test_every_request_is_kept_once(spark, requests, expected):
    _, uri = expected
    kept = read_table(spark, uri, "reports").select("id").union(read_table(spark, uri, "rejects").select("id"))
    assert kept.count() == kept.distinct().count() == requests.count()
    tallied = read_table(spark, uri, "tallies").agg(F.sum("times")).first()[0]
    assert tallied == read_table(spark, uri, "reports").count()


def test_dictionary_and_row_rules_agree(spark, requests, expected, tmp_path):
    assert batch_tables(spark, requests, str(tmp_path / "t"), max_dictionary_bytes=0) == expected[0]


def test_gathering_days_leaves_fewer_files(spark, requests, expected, tmp_path):
    scattered, gathered = str(tmp_path / "s"), str(tmp_path / "g")
    mixed = requests.repartition(8, F.col("id"))
    assert batch_tables(spark, mixed, scattered) == expected[0]
    assert batch_tables(spark, mixed, gathered, gather_days=True) == expected[0]

    def files(uri):
        return len(list(Path(uri, "reports").rglob("*.parquet")))

    assert files(gathered) < files(scattered)


def test_a_batch_run_again_replaces_itself(spark, requests, tmp_path):
    uri = str(tmp_path / "t")
    halves = [requests.where("id % 2 = 0"), requests.where("id % 2 = 1")]
    for batch_id, half in enumerate(halves):
        ingest.run_batch(half, Config(write_uri=uri), batch_id)
    names = ("browsers", "reports", "rejects", "tallies")
    before = [stored_rows(spark, uri, name) for name in names]
    ingest.run_batch(halves[1], Config(write_uri=uri), 1)
    ingest.run_batch(halves[0], Config(write_uri=uri), 0)
    assert [stored_rows(spark, uri, name) for name in names] == before


def test_new_browser_ids_start_above_imported_ones(spark, requests, tmp_path):
    uri = str(tmp_path / "t")
    imported = spark.createDataFrame([(5000, "Chrome", "26.0.1410.64", START)], schemas.BROWSERS)
    write_batch(imported, uri, "browsers", batch_id=-1)
    for batch_id, half in enumerate((requests.where("id <= 500"), requests.where("id > 500"))):
        ingest.run_batch(half, Config(write_uri=uri), batch_id)
    ids = [row.id for row in read_table(spark, uri, "browsers").orderBy("id").collect()]
    assert len(set(ids)) == len(ids) > 30
    assert ids[0] == 5000 and ids[-1] < 6100
    used = read_table(spark, uri, "reports").select("browser").distinct()
    assert used.where("browser = 5000").count() == 1


def test_options_reach_the_reject_log(spark, tmp_path):
    df = raw(spark, {"xff": "1.1.1.1, 2.2.2.2"}, {"query_string": "message=a%20b"}, {})
    uri = str(tmp_path / "t")
    config = Config(write_uri=uri, multi_ip="reject", screen_keywords=True)
    ingest.run_batch(df, config, 0)
    rows = dicts(read_table(spark, uri, "rejects"), "id")
    assert [(r["id"], r["reject_reason"], r["ip"], r["date"]) for r in rows] == [
        (1, "ip", None, START),
        (2, "keyword", 3221225985, START + timedelta(minutes=1)),
    ]
    assert [r["id"] for r in dicts(read_table(spark, uri, "reports"), "id")] == [3]


def test_a_batch_of_nothing(spark, tmp_path):
    uri = str(tmp_path / "t")
    ingest.run_batch(raw(spark, {}).where("false"), Config(write_uri=uri), 0)
    for name in ("browsers", "reports", "rejects", "tallies"):
        assert read_table(spark, uri, name).isEmpty()
    assert reporting.running_summaries(spark, Config(write_uri=uri))["script_summary"].isEmpty()


def test_a_missing_table_is_an_error_unless_expected(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, str(tmp_path), "reports")
    assert read_table(spark, str(tmp_path), "browsers", missing_ok=True).isEmpty()


def test_written_and_running_summaries_agree(spark, expected, tmp_path):
    config = Config(write_uri=expected[1], read_uri=expected[1])
    reporting.write_reports(spark, config, str(tmp_path))
    for name, running in reporting.running_summaries(spark, config).items():
        written = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(str, written.collect())) == sorted(map(str, running.select(*written.columns).collect()))


def write_files(requests, path, count):
    for number in range(count):
        requests.where(F.col("id") % count == number).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, requests, expected, tmp_path):
    source, uri = str(tmp_path / "in"), str(tmp_path / "t")
    write_files(requests, source, 4)
    stream = sources.stream_beacons(spark, source, maxFilesPerTrigger=1)
    query = start_stream(stream, Config(write_uri=uri), str(tmp_path / "cp"), NOW)
    query.awaitTermination()
    assert read_table(spark, uri, "tallies").count() > 0
    (browsers, reports, rejects), (all_browsers, all_reports, all_rejects) = tables(spark, uri), expected[0]
    # Files arrive out of id order, so a pair's first time may differ; the pairs may not.
    assert [b[:2] for b in browsers] == [b[:2] for b in all_browsers]
    assert (reports, rejects) == (all_reports, all_rejects)
    # Started again, the stream goes on where it stopped.
    write_files(requests.where("id <= 40").withColumn("id", F.col("id") + 1_000_000), source, 1)
    again = sources.stream_beacons(spark, source, maxFilesPerTrigger=1)
    start_stream(again, Config(write_uri=uri), str(tmp_path / "cp"), NOW).awaitTermination()
    added = read_table(spark, uri, "reports").where("id > 1000000").count()
    assert added == read_table(spark, uri, "reports").where("id <= 40").count() > 0
    assert [b[:2] for b in tables(spark, uri)[0]] == [b[:2] for b in all_browsers]


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_live_summaries_follow_the_files(spark, requests, expected, tmp_path, mode):
    source = str(tmp_path / "in")
    write_files(requests, source, 5)
    summaries = reporting.running_summaries(spark, Config(write_uri=expected[1]))
    for name, summarise, keys, roll_up in (
        ("message_summary", live.live_message_summary, ["hash"], lambda rows: rows),
        ("browser_summary", live.live_browser_versions, ["type", "version_key"], live.browser_summary),
        ("script_summary", live.live_script_summary, ["file"], lambda rows: rows),
    ):
        feed = live.live_feed(sources.stream_beacons(spark, source, maxFilesPerTrigger=1))
        out = str(tmp_path / name)
        live.start_live(summarise(feed), out, str(tmp_path / f"cp-{name}"), keys, NOW, mode, fan=2).awaitTermination()
        manifest = Log(spark, out).latest()
        assert runs(run for part in manifest.parts for run in part.batches) in ([((0, 4),)] if mode == "update" else [((4, 4),)])
        assert len(manifest.parts) <= 3
        got = roll_up(live.current(spark, out, *keys))
        batch = summaries[name].select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("file_format", ["parquet", "json", "csv", "orc"])
def test_file_formats(spark, tmp_path, file_format):
    df = raw(spark, {"xff": "1.2.3.4", "user_agent": 'quoted "agent", comma'}, {})
    df.write.format(file_format).save(str(tmp_path / "in"))
    back = sources.read_beacons(spark, str(tmp_path / "in"), file_format)
    assert [f.name for f in back.schema] == schemas.RAW_BEACONS.fieldNames()
    assert dicts(back, "id") == dicts(df, "id")


def test_unknown_file_format(spark):
    with pytest.raises(ValueError):
        sources.read_beacons(spark, "/nowhere", "exe")


def test_kafka_records(spark):
    value = {"query_string": "line=3", "user_agent": "x", "remote_addr": "1.2.3.4", "received_at": str(START)}
    records = spark.createDataFrame(
        [(json.dumps(value).encode(), 2, 7), (json.dumps(value).encode(), 3, 7), (b"not json", 2, 8)],
        "value binary, partition int, offset bigint",
    )
    rows = dicts(sources.from_kafka(records), "id")
    assert [row["id"] for row in rows] == [7 * 4096 + 2, 7 * 4096 + 3, 8 * 4096 + 2]
    assert rows[0] == {
        "id": 28674, "received_at": START, "query_string": "line=3", "user_agent": "x", "xff": None,
        "remote_addr": "1.2.3.4",
    }
    assert rows[2]["query_string"] is None


def test_kafka_records_that_do_not_fit_an_id_are_refused(spark):
    for partition, offset in ((4096, 0), (0, 1 << 51)):
        record = spark.createDataFrame([(b"{}", partition, offset)], "value binary, partition int, offset bigint")
        with pytest.raises(Exception, match="Kafka ids"):
            sources.from_kafka(record).collect()


def test_jdbc_ranges_cover_all_ids():
    options = jdbc.range_options(5, 104, 10)
    assert options["partitionColumn"] == "id"
    assert (int(options["lowerBound"]), int(options["upperBound"])) == (5, 105)


def test_fixture_agents_are_all_used(spark, requests):
    assert requests.select("user_agent").distinct().count() == len(GOLDEN_AGENTS)


def test_a_stricter_rerun_leaves_one_copy(spark, requests, tmp_path):
    uri = str(tmp_path / "t")
    some = requests.where("id <= 40")
    ingest.run_batch(some, Config(write_uri=uri), 0)
    ingest.run_batch(some.withColumn("query_string", F.lit("message=a%20b")), Config(write_uri=uri, screen_keywords=True), 0)
    assert read_table(spark, uri, "reports").isEmpty() and read_table(spark, uri, "tallies").isEmpty()
    assert read_table(spark, uri, "rejects").count() == 40


def test_a_stream_keeps_what_was_loaded_before(spark, requests, tmp_path):
    uri, arriving = str(tmp_path / "t"), str(tmp_path / "in")
    ingest.run_batch(requests.where("id <= 500"), Config(write_uri=uri), 0)
    requests.where("id > 500").write.parquet(arriving)
    stream = sources.stream_beacons(spark, arriving)
    start_stream(stream, Config(write_uri=uri), str(tmp_path / "c"), NOW).awaitTermination()
    whole = batch_tables(spark, requests, str(tmp_path / "whole"))
    assert tables(spark, uri) == whole


def test_reports_after_resolving_everything(spark, requests, tmp_path):
    uri, out = str(tmp_path / "t"), str(tmp_path / "out")
    config = Config(write_uri=uri)
    ingest.run_batch(requests.where("id <= 100"), config, 0)
    reporting.write_reports(spark, config, out)
    assert not spark.read.parquet(f"{out}/message_summary").isEmpty()
    resolved = cut_lineage(read_table(spark, uri, "reports").withColumn("status", F.lit(1)))
    write_batch(resolved, uri, "reports", 0)
    reporting.write_reports(spark, config, out)
    assert spark.read.parquet(f"{out}/message_summary").isEmpty()


def test_no_silent_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_arriving_slices_are_shared_by_all_cores(spark, tmp_path):
    rows = spark.range(4000).selectExpr(
        "id as event_id", "timestamp_ntz '2024-01-01' as ts", "id % 7 as user_id", "'click' as event_type",
        "0.5D as value", "'{}' as props")
    cores, seen = spark.sparkContext.defaultParallelism, []
    arriving = fx.arriving_events(fx.event_slices(rows, 4), str(tmp_path / "arriving"))

    def note(batch, _):
        seen.append((batch.selectExpr("input_file_name() as f").groupBy("f").count().collect(), {r[0] for r in batch.select("event_id").collect()}))

    query = arriving.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert [ids for _, ids in seen] == [set(range(at, at + 1000)) for at in range(0, 4000, 1000)]
    for files, _ in seen:
        assert len(files) == cores and max(row["count"] for row in files) <= 2 * 1000 // cores
