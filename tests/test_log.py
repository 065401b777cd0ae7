"""The commit log, merging of parts, and resolutions."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from builders import START, dicts, raw, reports
from errorloom import fixtures as fx
from errorloom import schemas
from errorloom.config import Config
from errorloom.operators import agents as agent_rules
from errorloom.operators.tallies import tally
from errorloom.plans import compaction, ingest, reporting, resolving
from errorloom.sources import tables
from errorloom.sources.log import KEEP, Conflict, Log, runs
from errorloom.sources.tables import SealedBatch, commit_batch, read_parts, read_table, write_batch, write_part

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("browsers", "reports", "rejects")


@pytest.fixture(scope="module")
def requests(spark):
    return fx.raw_beacons(fx.events(spark, SF_DIR))


def rows(df):
    return sorted(map(str, df.collect()))


def contents(spark, uri):
    return {name: rows(read_table(spark, uri, name)) for name in NAMES}


def folders(uri, name):
    return sorted(p.name[7:] for p in Path(uri, name).glob("folder=*"))


def summary(spark, uri, name="script_summary"):
    return rows(reporting.running_summaries(spark, Config(write_uri=uri))[name])


def test_runs():
    assert runs([3, 1, 2, 7]) == ((1, 3), (7, 7))
    assert runs([(1, 3), (4, 4), (9, 9), 10]) == ((1, 4), (9, 10))
    assert runs([]) == ()


def test_a_killed_write_changes_nothing(spark, requests, tmp_path, monkeypatch):
    uri = str(tmp_path)
    first, second = requests.where("id <= 300"), requests.where("id > 300")
    ingest.run_batch(first, Config(write_uri=uri), 0)
    ingest.run_batch(second, Config(write_uri=uri), 1)
    before, sums = contents(spark, uri), summary(spark, uri)

    def killed(*args, **kwargs):
        raise RuntimeError("killed")

    # Both a new batch and one that would replace another; half way, and just before it counts.
    for batch_id, some, step in ((2, second, "to_reports"), (1, first, "commit_batch")):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="killed"):
            patch.setattr(ingest, step, killed)
            ingest.run_batch(some, Config(write_uri=uri), batch_id)
        assert contents(spark, uri) == before and summary(spark, uri) == sums
    assert len(folders(uri, "browsers")) == 4
    assert len(Log(spark, uri).sweep(tables.TABLES)) >= 2
    assert len(folders(uri, "browsers")) == 2 and contents(spark, uri) == before
    ingest.run_batch(second, Config(write_uri=uri), 1)
    assert contents(spark, uri) == before


def test_a_second_writer_is_refused(spark, tmp_path):
    uri = str(tmp_path)
    write_batch(reports(spark, {}), uri, "reports", 0)
    base = Log(spark, uri).latest()
    parts = [write_part(reports(spark, {"id": n}), uri, "reports", [n]) for n in (1, 2)]
    Log(spark, uri).commit(base, parts[:1])
    with pytest.raises(Conflict):
        Log(spark, uri).commit(base, parts[1:])
    assert sorted(r["id"] for r in read_table(spark, uri, "reports").collect()) == [1, 1]
    commit_batch(spark, uri, 2, parts[1:])
    assert read_table(spark, uri, "reports").count() == 3


def test_a_batch_reads_its_own_files_only(spark, tmp_path):
    uri = str(tmp_path)
    for number in range(12):
        write_batch(reports(spark, {"id": number}), uri, "reports", number)
    one = read_table(spark, uri, "reports", batch=7)
    assert [r["id"] for r in one.collect()] == [7]
    assert len(one.inputFiles()) == 1
    paths = re.findall(r"Location: InMemoryFileIndex[^\n]*", one._jdf.queryExecution().executedPlan().toString())
    assert paths and all("(1 paths)" in path for path in paths)


def test_the_log_stays_short(spark, tmp_path):
    uri = str(tmp_path)
    for number in range(KEEP + 3):
        write_batch(reports(spark, {"id": number}), uri, "reports", number % 3)
    log = Log(spark, uri)
    assert len(log.versions()) == KEEP
    # Folders of versions that are gone are gone too.
    assert len(folders(uri, "reports")) <= KEEP + 3
    assert read_table(spark, uri, "reports").count() == 3


def some_tallies(spark, number):
    return tally(reports(spark, {"id": number, "message": f"m{number % 3}"}, {"id": number + 1000, "message": "every"}))


def test_many_batches_keep_few_parts(spark, tmp_path):
    uri, fan, count = str(tmp_path), 2, 30
    most = 0
    for number in range(count):
        write_batch(some_tallies(spark, number), uri, "tallies", number)
        manifest = compaction.compact(spark, uri, fan)
        most = max(most, len(manifest.of("tallies")))
    # Never more than ``fan`` parts a level, and log(30) levels.
    assert most <= fan * 5
    assert runs(run for part in manifest.of("tallies") for run in part.batches) == ((0, count - 1),)
    got = {r["message"]: (r["times"], r["first_id"]) for r in read_table(spark, uri, "tallies").groupBy("message").agg(
        F.sum("times").alias("times"), F.min("first_id").alias("first_id")).collect()}
    assert got == {"m0": (10, 0), "m1": (10, 1), "m2": (10, 2), "every": (30, 1000)}
    merged = [part for part in manifest.of("tallies") if part.level > 1]
    assert merged and read_parts(spark, uri, "tallies", merged[:1]).count() == 4


def test_readers_during_a_merge_see_the_same_sums(spark, requests, tmp_path, monkeypatch):
    uri = str(tmp_path)
    for number in range(4):
        ingest.run_batch(requests.where(F.col("id") % 4 == number), Config(write_uri=uri, compact_at=0), number)
    sums, seen = summary(spark, uri), []
    stored = contents(spark, uri)
    begun = reporting.running_summaries(spark, Config(write_uri=uri))["script_summary"]
    write = compaction.write_part

    def watched(*args, **kwargs):
        part = write(*args, **kwargs)
        seen.append(summary(spark, uri) == sums)
        return part

    monkeypatch.setattr(compaction, "write_part", watched)
    manifest = compaction.compact(spark, uri, 2)
    assert len(seen) >= 5 and all(seen)
    assert summary(spark, uri) == sums
    assert rows(begun) == sums  # a reader that began before the merge goes on
    after = contents(spark, uri)
    assert {n: after[n] for n in ("browsers", "rejects", "reports")} == {n: stored[n] for n in ("browsers", "rejects", "reports")}
    assert all(len(manifest.of(name)) <= 3 for name in tables.TABLES)
    # Merged batches can still be told apart, but no longer replaced.
    assert read_table(spark, uri, "reports", batch=0).where("batch_id <> 0").isEmpty()
    assert rows(read_table(spark, uri, "rejects", batch=1)) == rows(ingest.rejects(ingest.triage(requests.where("id % 4 = 1"))))
    with pytest.raises(SealedBatch):
        ingest.run_batch(requests, Config(write_uri=uri), 0)
    ingest.run_batch(requests.where("id % 4 = 3"), Config(write_uri=uri), 3)
    assert summary(spark, uri) == sums


def test_raw_requests_are_scanned_once(spark, requests, tmp_path):
    source = str(tmp_path / "in")
    requests.write.parquet(source)
    accumulator = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda text: (accumulator.add(1), text)[1], "string").asNondeterministic()
    counted = spark.read.schema(schemas.RAW_BEACONS).parquet(source).withColumn("query_string", seen("query_string"))
    ingest.run_batch(counted.select(*schemas.RAW_BEACONS.fieldNames()), Config(write_uri=str(tmp_path / "t")), 0)
    assert accumulator.value == requests.count()
    assert not Path(tmp_path, "t", "_staging").exists() or not list(Path(tmp_path, "t", "_staging").iterdir())


def test_rules_run_on_unseen_agents_only(spark, requests, tmp_path, monkeypatch):
    uri = str(tmp_path)
    ruled = []
    apply_rules = ingest.apply_rules

    def counted(df, *args):
        ruled.append(df.count())
        return apply_rules(df, *args)

    monkeypatch.setattr(ingest, "apply_rules", counted)
    first, second = requests.where("id <= 20"), requests.where("id > 20")
    ingest.run_batch(first, Config(write_uri=uri), 0)
    ingest.run_batch(second, Config(write_uri=uri), 1)
    ingest.run_batch(second.withColumn("id", F.col("id") + 10_000), Config(write_uri=uri), 2)
    accepted = ingest.triage(requests).where("reject_reason is null")
    seen = [accepted.where(f"id {sign} 20").select("user_agent").distinct() for sign in ("<=", ">")]
    assert ruled == [seen[0].count(), seen[1].subtract(seen[0]).count()]  # the third batch shows nothing new
    stored = read_table(spark, uri, "agents")
    assert stored.count() == stored.select("user_agent").distinct().count() == sum(ruled)
    # Other rules: everything is worked out again, and the old outcomes go when parts are merged.
    for module in (ingest, compaction):
        monkeypatch.setattr(module, "rules_version", lambda: "other")
    ingest.run_batch(first.withColumn("id", F.col("id") + 20_000), Config(write_uri=uri), 3)
    assert ruled[2] == seen[0].count()
    compaction.compact(spark, uri, 2)
    assert read_table(spark, uri, "agents", before_batch=3).where("rules <> 'other'").count() < sum(ruled[:2])
    assert agent_rules.rules_version() != "other"


def test_resolutions_cover_what_was_stored_before(spark, tmp_path):
    uri = str(tmp_path)
    config = Config(write_uri=uri, compact_at=0)
    line = lambda n: {"query_string": f"message=e{n}&url=u&line=1"}
    batch = lambda *numbers, at: raw(spark, *[{"id": at + i, **line(n)} for i, n in enumerate(numbers)])
    md5 = lambda n: spark.createDataFrame([(f"e{n}",)], "m string").select(F.md5(F.concat("m", F.lit("1"))).alias("hash"))
    open_now = lambda: {r["message"]: r["times"] for r in reporting.running_summaries(spark, config)["message_summary"].collect()}
    status = lambda: {r["id"]: r["status"] for r in resolving.stored(spark, uri, "reports").collect()}

    ingest.run_batch(batch(1, 1, 2, at=10), config, 0)
    resolving.resolve_stored(spark, config, md5(1), START)
    assert open_now() == {"e2": 1} and status() == {10: 1, 11: 1, 12: 0}
    ingest.run_batch(batch(1, 3, at=20), config, 1)  # reported again: open again
    assert open_now() == {"e1": 1, "e2": 1, "e3": 1} and status()[20] == 0
    # A batch that is run again keeps its age.
    ingest.run_batch(batch(1, 1, 2, at=10), config, 0)
    assert open_now() == {"e1": 1, "e2": 1, "e3": 1} and status() == {10: 1, 11: 1, 12: 0, 20: 0, 21: 0}
    resolving.resolve_stored(spark, config, md5(3), START, resolving.DELETED)
    resolving.resolve_stored(spark, config, md5(3).union(md5(3)).union(md5(9)), START, resolving.DELETED)
    assert open_now() == {"e1": 1, "e2": 1} and set(status()) == {10, 11, 12, 20}
    ingest.run_batch(batch(3, 3, at=30), config, 2)
    expected = ({"e1": 1, "e2": 1, "e3": 2}, {10: 1, 11: 1, 12: 0, 20: 0, 30: 0, 31: 0})
    assert (open_now(), status()) == expected
    # Merging applies them for good, and none twice.
    compaction.compact(spark, uri, 2)
    assert (open_now(), status()) == expected
    assert {r["id"]: r["status"] for r in read_table(spark, uri, "reports", before_batch=2).collect()} == {10: 1, 11: 1, 12: 0, 20: 0}
    resolving.resolve_stored(spark, config, md5(2), START)
    assert open_now() == {"e1": 1, "e3": 2} and status()[12] == 1
    out = str(tmp_path / "out")
    reporting.write_reports(spark, config, out)
    assert {r["message"]: r["times"] for r in spark.read.parquet(f"{out}/message_summary").collect()} == open_now()


def test_resolving_nothing_and_unknown_actions(spark, tmp_path):
    config = Config(write_uri=str(tmp_path))
    ingest.run_batch(raw(spark, {}), config, 0)
    before = dicts(resolving.stored(spark, str(tmp_path), "reports"))
    resolving.resolve_stored(spark, config, spark.createDataFrame([(None,)], "hash string"), START)
    assert dicts(resolving.stored(spark, str(tmp_path), "reports")) == before
    with pytest.raises(ValueError):
        resolving.resolve_stored(spark, config, spark.createDataFrame([], "hash string"), START, "ignored")


def test_reads_and_writes_in_two_places(spark, requests, tmp_path):
    """Reports come from the replica: what is written after it was made is not in them yet."""
    import shutil

    write, read = str(tmp_path / "primary"), str(tmp_path / "replica")
    config = Config(write_uri=write, read_uri=read)
    ingest.run_batch(requests.where("id <= 200"), config, 0)
    shutil.copytree(write, read)
    before = rows(reporting.running_summaries(spark, config)["script_summary"])
    ingest.run_batch(requests.where("id > 200"), config, 1)
    assert rows(reporting.running_summaries(spark, config)["script_summary"]) == before
    assert summary(spark, write) != before
    assert [p.name for p in Path(read, "_log").glob("*.json")] == ["000000000001.json"]
