"""Documents whose columns have the operators' own names, more texts than a batch has room for, and SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from errorloom.llm import jaccard, mixing, packing, quality, toxicity
from errorloom.llm.common import ship
from errorloom.llm.registered import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("label", "score", "predicted", "offset", "sequence_id", "_suspect", "_id", "bins", "a.b", "size", "copies", "gone")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return rows.select("*", *[F.concat(F.lit("mine "), F.col("doc_id")).alias(name) for name in NAMES])


def own_columns_kept(rows):
    return all(row[name] == f"mine {row['doc_id']}" for row in rows for name in NAMES)


def test_models_are_trained_beside_clashing_names(spark, docs):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    plain = docs.select("doc_id", "text")
    for module in (toxicity, quality):
        model = module.train(docs, labels, F.lit(True))
        same = module.train(plain, labels, F.lit(True))
        scores = [module.score(plain, m).orderBy("doc_id").select("score").toPandas() for m in (model, same)]
        assert scores[0].equals(scores[1])


def test_stages_keep_the_documents_own_columns(spark, docs):
    kept = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert 0 < len(rows) < docs.count() and own_columns_kept(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs.drop(*NAMES), SF_DIR).collect()}
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and own_columns_kept(rows)


def test_packing_replaces_its_own_names_only(spark):
    pieces = spark.createDataFrame([(n, 0, 100 + n, 9.5, "x", "y") for n in range(40)],
                                   "doc_id bigint, piece int, length int, offset double, sequence_id string, `a.b` string")
    packed = packing.pack(pieces)
    assert packed.columns == ["doc_id", "piece", "length", "a.b", "sequence_id", "offset"]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed.collect())
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
    assert packing.pack(pieces.limit(0)).count() == 0


def test_mixing_takes_dotted_names(docs):
    taken = mixing.take(docs, mixing.words(F.col("text")))
    assert taken.columns == docs.columns and own_columns_kept(taken.collect())


def test_more_texts_than_a_batch_has_numbers_for(spark):
    texts = [f"w{n % 700} x{n % 300} y z{n} a b c{n}" for n in range(20_000)]
    hashes, ends = jaccard.shingle_sets(pa.array(texts))
    assert len(ends) == len(texts) + 1 and ends[-1] == len(hashes)
    for n in [*range(0, 20_000, 997), 8_191, 8_192, 16_383, 16_384, 19_999]:
        alone, _ = jaccard.shingle_sets(pa.array([texts[n]]))
        assert np.array_equal(hashes[int(ends[n]) : int(ends[n + 1])], alone)
    # End to end, in one Arrow batch.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
        sizes = {r["n_shingles"] for r in jaccard.groups(rows).select("n_shingles").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sizes == {3}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_chat_format", "op7_top_k"])
def test_equal_to_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    names = ", ".join(found.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, db.execute(f"select {names} from ({ORACLE[name]})").fetchall()))
