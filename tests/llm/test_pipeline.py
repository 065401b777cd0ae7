"""Each stage of the pipeline against plain Python, and what it leaves behind."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from errorloom.config import shared_folder
from errorloom.llm import mixing
from errorloom.llm.common import Scratch, scratch, stored
from tests.llm.test_families import by_brute_force, drifting

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `own.name` string, score string, offset string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = drifting(5, families=4, members=12)
    texts += texts[:10] + ["", None, "one", "one", " ", "x " * 5000]
    return [(i, x, "en", rng.choice(("a", "b", "b", "b", None)), i, "o", "mine", "own") for i, x in enumerate(texts)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup_keeps_the_greatest_id(spark, docs, rows):
    got = STAGES["exact dedup"](spark, docs, None)
    last = {text or "": i for i, text, *_ in rows}
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {*last.values()}


def test_near_copies_leave_one_a_group(spark, docs, rows):
    got = STAGES["n-gram Jaccard join"](spark, docs, None)
    texts = [x for _, x, *_ in rows if x and len(x.split()) > 4]
    places = [i for i, x, *_ in rows if x and len(x.split()) > 4]
    leaders = {places[c] for _, _, c in by_brute_force(texts)}
    short = [i for i, x, *_ in rows if i not in places]
    least = {}
    for i in short:
        text = " ".join((rows[i][1] or "").split())
        least.setdefault(text or i, i)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(leaders | {*least.values()})


def test_mixing_takes_what_mix_says(spark, docs):
    got = STAGES["mixing sources to target weights"] if "mixing sources to target weights" in STAGES else STAGES["mixing sources"]
    taken = got(spark, docs, None)
    assert taken.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, mixing.words(F.col("text"))).collect()}
    counted = {r["doc_id"]: r["n"] for r in taken.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: n for i, n in copies.items() if n}


def test_packing_leaves_no_gap(spark, docs, rows):
    packed = STAGES["best-fit packing"](spark, docs, None).collect()
    by_sequence, by_doc = {}, {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts in (*by_sequence.values(), *by_doc.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) <= 2048 for x in by_sequence.values())
    assert by_doc.keys() == {i for i, *_ in rows}


def test_the_whole_run_leaves_the_last_tables_only(spark):
    folder = Path(urlparse(shared_folder(spark)).path)
    before = {x for x in folder.glob("llm-*") if any(x.iterdir())}
    sf_dir = "/root/testdata/sf0.001"
    first = corpus_pipeline.run(spark, sf_dir)
    left = {x for x in folder.glob("llm-*") if any(x.iterdir())} - before
    assert {p.name for x in left for p in x.iterdir()} <= {"pieces", "lengths"}
    again = corpus_pipeline.run(spark, sf_dir)
    same = [c for c in first.columns if c not in ("sequence_id", "offset")]
    assert first.count() > 0
    assert first.select(same).exceptAll(again.select(same)).isEmpty()


def test_each_stage_takes_no_rows(spark, docs):
    for name in list(STAGES)[1:]:
        assert STAGES[name](spark, docs.limit(0), None).count() == 0


def test_scratch_keeps_what_it_is_told_to(spark):
    with Scratch(spark) as outer:
        with scratch(spark):
            gone = stored(spark.range(3), "gone")
            kept = stored(gone.groupBy("id").count(), "kept", kept=True)
        assert kept.count() == 3
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            gone.collect()
    assert kept.count() == 3
    outer.remove()
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        kept.collect()
