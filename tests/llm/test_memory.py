"""What an executor and its Python workers hold: bounded while texts are read, given back between batches."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from errorloom.llm import toxicity, wordscan
from errorloom.llm.common import ship


def held():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.fixture
def texts():
    rng = np.random.default_rng(5)
    words = np.array([f"word{i}" for i in range(5000)])
    return pa.array([" ".join(rng.choice(words, 400)) for _ in range(2000)], pa.large_string())


def test_scores_of_many_bytes_need_few_more(texts):
    assert texts.nbytes > 6 << 20
    machine = toxicity.Machine(np.arange(1024), np.ones(1024))
    wordscan._tables.clear()
    tracemalloc.start()
    for part in wordscan.chunks(texts, toxicity.CHUNK):
        machine.scores(part)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 32 << 20


def test_fitting_needs_little_beside_its_table():
    rng = np.random.default_rng(7)
    bins = [np.unique(rng.integers(0, 3000, 400)).astype(np.int32) for _ in range(4000)]
    labels = [int(10 in own or 77 in own) for own in bins]
    tracemalloc.start()
    toxicity.fit(bins, labels, epochs=1)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < (4 * len(bins) * toxicity.TERMS + 32 * sum(map(len, bins)))


def test_words_do_not_depend_on_the_stretch(texts, monkeypatch):
    whole, bounds = wordscan.words(texts.slice(0, 200))
    monkeypatch.setattr(wordscan, "STRETCH", 100)
    cut, same = wordscan.words(texts.slice(0, 200))
    assert (whole == cut).all() and (bounds == same).all()


def test_memory_goes_back_after_every_batch():
    from errorloom.llm.common import lean

    kept, seen = [], []

    def function(batches):
        for _ in batches:
            seen.append(held())
            blocks = [bytes(50_000) + b"x" for _ in range(2000)]
            kept.append(bytes(50_000) + b"y")  # above the blocks, so that their place isn't the heap's end
            yield len(blocks)
            del blocks

    before = held()
    assert list(lean(function)(range(3))) == [2000] * 3
    assert max(*seen, held()) < before + 60


def test_stages_read_few_rows_at_a_time(spark, tmp_path):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = {name: spark.conf.get(name, None) for name in [*names, "parquet.hadoop.vectored.io.enabled"]}
    try:
        for name in before:
            spark.conf.unset(name)
        rows = [(i, None if i == 7 else f"text {i % 900}") for i in range(1500)]
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        kept = dict(corpus_pipeline.STAGES)["exact dedup"](spark, docs, str(tmp_path))
        assert sorted(r["doc_id"] for r in kept.collect()) == [7, *range(600, 1500)]
        assert [int(spark.conf.get(name)) for name in names] == [2000, 512]
        assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "false"
        # What the user has chosen stays, or the smaller.
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "true")
        spark.conf.set(names[1], "100")
        ship(spark)
        assert spark.conf.get("parquet.hadoop.vectored.io.enabled") == "true"
        assert spark.conf.get(names[1]) == "100"
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
