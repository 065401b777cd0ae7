"""Toxicity by a factorization machine over hashed terms.

A term is a run of letters and digits, A-Z in lower case, or its first four or five bytes (so that endings
do not hide a stem), hashed into ``BINS`` bins; a document shows a bin or does not. The machine adds a weight per bin and, for every pair of bins that a document shows, the
product of their factors, so an insult next to the mention of a group can weigh more than both alone.

It is fitted in the driver on a bounded sample of labelled documents: at most ``SAMPLE`` of them, those
with the least hash of their id, and the ``TERMS`` bins that set labels apart most. All documents are
scored in Arrow batches; nothing is shuffled.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.llm.common import give_back, lean
from errorloom.llm.wordscan import MARKS, chunks, words

BINS = 1 << 18
BEGINNINGS = (4, 5)
SAMPLE = 12_000
CHUNK = 1 << 19  # bytes of text looked at together
TERMS = 1024
LEAST_DOCUMENTS = 3
FACTORS = 8
SEED = 11


def shown_bins(texts: pa.Array):
    """The distinct bins of each text in order, and how many precede each text, with the total last."""
    hashes, bounds = words(texts, MARKS, BEGINNINGS)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keys = np.unique(doc[:, None] * BINS + (hashes % np.uint64(BINS)).astype(np.int64))
    return keys % BINS, np.searchsorted(keys, np.arange(len(texts) + 1) * BINS)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str, label_column: str,
                  most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled documents as (text, label), one label per id.

    Ids or labels that are null teach nothing; of contradicting labels the greatest holds. The ids and labels
    chosen are at most ``most`` rows, which bounds what is broadcast.
    """
    chosen = (
        labels.where(learn & F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.max(label_column).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    return docs.join(F.broadcast(chosen), F.col(f"`{id_column}`") == F.col("_id"))


class Machine:
    """Weights of the chosen bins. ``prior`` is the score, as log odds, of a document that shows none."""

    def __init__(self, bins=(), weights=(), factors=None, prior=0.0):
        self.index = np.full(BINS, -1, dtype=np.int32)
        self.index[np.asarray(bins, dtype=np.int64)] = np.arange(len(bins))
        self.weights = np.asarray(weights, dtype=np.float64)
        self.factors = np.zeros((len(bins), FACTORS)) if factors is None else factors
        self.prior = prior

    def scores(self, texts: pa.Array) -> np.ndarray:
        hashes, bounds = words(texts, MARKS, BEGINNINGS)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        term = self.index[hashes % np.uint64(BINS)]
        size = max(1, len(self.weights))
        keys = np.unique((doc[:, None] * size + term)[term >= 0])  # only chosen bins, each once
        doc, term = keys // size, keys % size
        raw = self.prior + np.bincount(doc, self.weights[term], minlength=len(texts))
        for k in range(FACTORS):
            v = self.factors[term, k]
            raw += 0.5 * (np.bincount(doc, v, minlength=len(texts)) ** 2 - np.bincount(doc, v * v, minlength=len(texts)))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(bins: list, labels: list, epochs: int = 30, rate: float = 0.05, shrink: float = 1e-3) -> Machine:
    """A machine for documents given by the bins they show. Without both labels it only has a prior."""
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Machine(prior=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    shown = np.concatenate([np.asarray(b, dtype=np.int32) for b in bins])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(b) for b in bins])
    ones, all_ = np.bincount(shown, y[doc], minlength=BINS), np.bincount(shown, minlength=BINS)
    n1, n0 = y.sum(), len(y) - y.sum()
    spread = np.sqrt(np.maximum(all_ / len(y) * (1 - all_ / len(y)), 1 / len(y)) * (1 / n1 + 1 / n0))
    lift = np.where(all_ >= LEAST_DOCUMENTS, np.abs(ones / n1 - (all_ - ones) / n0) / spread, 0)
    chosen = np.sort(np.argsort(-lift, kind="stable")[:TERMS])
    chosen = chosen[lift[chosen] > 0]
    index = np.full(BINS, -1, dtype=np.int32)
    index[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), dtype=np.float32)
    term = index[shown]
    x[doc[term >= 0], term[term >= 0]] = 1
    del shown, doc, term

    random = np.random.default_rng(SEED)
    state = [np.zeros(1), np.zeros(len(chosen)), random.normal(0, 0.01, (len(chosen), FACTORS))]
    seen = [np.full_like(s, 1e-8) for s in state]
    state[0][0] = np.log(share / (1 - share))
    for _ in range(epochs):
        order = random.permutation(len(y))
        for start in range(0, len(y), 256):
            rows = order[start : start + 256]
            xb = x[rows].astype(np.float64)
            xv = xb @ state[2]
            raw = state[0][0] + xb @ state[1] + 0.5 * ((xv**2).sum(1) - (xb @ (state[2] ** 2)).sum(1))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            by_term = xb.T @ error
            slopes = [
                np.array([error.sum()]),
                by_term + shrink * state[1],
                xb.T @ (error[:, None] * xv) - by_term[:, None] * state[2] + shrink * state[2],
            ]
            for s, g, total in zip(state, slopes, seen):
                total += g * g
                s -= rate * g / np.sqrt(total)
    return Machine(chosen, state[1], state[2], float(state[0][0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "toxic", most: int = SAMPLE) -> Machine:
    """Fits on labelled documents for which ``learn`` holds, a condition on rows of ``labels``."""

    def seen(batches):
        for batch in batches:
            bins, bounds = shown_bins(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bins, pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], ["bins", "label", "order"])

    docs = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text_column}`").alias("_text"))  # names may clash
    rows = (
        training_rows(docs, labels, learn, id_column, label_column, most)
        .select(F.col("_text").cast("string"), "label", F.xxhash64("_id").alias("order"))
        .mapInArrow(lean(seen), "bins array<int>, label int, order bigint")
        .toArrow()
        .sort_by([("order", "ascending")])
    )
    bins = rows["bins"].combine_chunks()
    bounds, flat = bins.offsets.to_numpy(), bins.values.to_numpy()
    machine = fit([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])], rows["label"].to_pylist())
    del rows, bins, bounds, flat
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, text_column: str = "text") -> DataFrame:
    """All columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text has the score of a document without terms. Repeated rows score alike. Columns named like
    the added ones are replaced. An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        column = pa.Array.from_pandas(texts, type=pa.large_string())
        scores = [np.zeros(0), *(machine.scores(part) for part in chunks(column, CHUNK))]
        del column
        give_back()
        return pd.Series(np.concatenate(scores))

    return docs.withColumn("score", scored(F.col(f"`{text_column}`").cast("string"))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
