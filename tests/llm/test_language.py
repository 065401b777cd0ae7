"""Language identification: paths against all paths, mixed texts, scripts, awkward rows, held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from errorloom.llm import language
from errorloom.llm.registered import op11

LANGS = {
    "en": "the house and the river with water under a stone light from seven green paper that this was".split(),
    "de": "das haus und der fluss mit wasser unter einem stein licht von sieben papier nicht über die schöne".split(),
    "ru": "дом и река вода под камнем свет семь бумага это было не который зелёный".split(),
    "uk": "дім і річка вода під каменем світло сім папір це було не який її зелений".split(),
    "ja": "日本語の文章です 漢字とかな 水の下の石 これは本です".split(),
}


def prose(lang, words, seed):
    random = np.random.default_rng(seed)
    return " ".join(random.choice(LANGS[lang], words))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, prose(lang, 40, i), lang) for i, lang in enumerate(sorted(LANGS) * 20)]
    return language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_viterbi_against_all_paths():
    random = np.random.default_rng(3)
    for _ in range(60):
        sizes = random.integers(0, 6, 4)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        scores = np.round(random.normal(0, 3, (bounds[-1], 3)), 3)
        path = language.viterbi(scores, bounds, 2.5)
        for i, size in enumerate(sizes):
            part = scores[bounds[i] : bounds[i + 1]]

            def total(p):
                return sum(part[t, s] for t, s in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))

            best = max((total(p) for p in itertools.product(range(3), repeat=size)), default=0)
            assert total(list(path[bounds[i] : bounds[i + 1]])) == pytest.approx(best)


def test_spans_of_a_mixed_text(spark, model):
    text = prose("en", 30, 1) + ". " + prose("de", 30, 2) + " — " + prose("ru", 20, 3)
    row = language.label(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    for span, (lang, count) in zip(row["spans"], [("en", 30), ("de", 30), ("ru", 20)]):
        assert abs(len(text[span["start"] : span["end"]].split()) - count) <= 2
        assert span["letters"] == sum(c.isalpha() for c in text[span["start"] : span["end"]])
    assert 0 < row["score"] < 1


def test_a_stray_word_makes_no_span(spark, model):
    text = prose("de", 10, 1) + " the " + prose("de", 10, 2)
    row = language.label(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["de"]


def test_scripts_narrow_candidates(model):
    number = {name: i for i, (name, _) in enumerate(language.SCRIPTS, 3)}
    can = lambda script: {model.langs[i] for i in np.flatnonzero(model.allowed[number[script]])}
    assert can("latin") == {"en", "de"} and can("cyrillic") == {"ru", "uk"} and can("kana") == {"ja"}
    assert can("greek") == set(model.langs)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 -- !!"), (5, "das haus"), (5, "das haus"), (None, "die schöne"),
           (6, "́́"), (7, "х" * 300_000), (8, "wasser " * 90_000), (9, "\U0001F600 stein licht"), (10, "İ nicht über")]


def test_awkward_rows(spark, model):
    docs = spark.createDataFrame([(i, t, "x", "y", 1.5) for i, t in AWKWARD], "doc_id bigint, text string, lang string, spans string, score double")
    rows = language.label(docs, model).collect()
    assert len(rows) == len(AWKWARD)
    by = {(r["doc_id"]): r for r in rows}
    for i in (1, 2, 3, 4, 6):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["spans"] == []
    assert by[5]["lang_pred"] == by[None]["lang_pred"] == by[8]["lang_pred"] == by[9]["lang_pred"] == by[10]["lang_pred"] == "de"
    assert by[7]["lang_pred"] in ("ru", "uk") and all(0 <= r["score"] <= 1 for r in rows)
    assert language.label(docs.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.label(docs, nothing).collect()} == {"und"}


def test_cutting_does_not_change_words(model):
    text = prose("en", 5000, 5) + " " + prose("de", 5000, 6)
    points, _ = language._points(pa.array([text]))
    whole = language._words(points)
    parts = [language._words(part)[2:4] for _, part in language._stretches(points, 700)]
    assert np.concatenate([p[1] for p in parts]).tolist() == whole[3].tolist()


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = op11(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where(
        "held_out and text rlike '[A-Za-z]{3}'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 20 and right >= 0.95 * len(rows)
