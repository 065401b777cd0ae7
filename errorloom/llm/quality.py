"""Quality by a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and so has every chosen pair of features. The
tables are sums of shallow trees, boosted feature by feature in turn: three leaves over one feature, four
quadrants over a pair. A score is the sum of the entries that a document's bins select.

The model is fitted in the driver on the features of at most ``SAMPLE`` labelled documents, those with the
least hash of their id. All documents are scored in Arrow batches; nothing is shuffled.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.llm.toxicity import training_rows
from errorloom.llm.wordscan import STRETCH, buffers, chunks, mix64, words

SAMPLE = 12_000
CHUNK = 2 << 20  # bytes of text looked at together
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 80, 40, 6
RATE, SHRINK, LEAST = 0.2, 5.0, 20

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digits", "ends", "symbols", "pipes", "newlines",
    "beyond_ascii", "distinct_words", "distinct_pairs", "stutter", "most_common",
)
CLASSES = 9


def _class(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 0
    if c.isupper():
        return 1
    if c.islower():
        return 2
    if c.isdigit():
        return 3
    if c in ".,;:?'\"-()":
        return 4
    if c == "|":
        return 5
    if c == "\n":
        return 6
    return 7 if c.isspace() or b < 32 else 8


_CLASS = np.array([_class(b) for b in range(256)], dtype=np.int64)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text. A null text counts as empty; of an empty one all are 0."""
    data, offsets = buffers(texts)
    n, size = len(texts), np.diff(offsets)
    kinds = np.zeros(n * CLASSES)
    for at in range(0, len(data), STRETCH):
        part = data[at : at + STRETCH]
        inside = np.diff(np.clip(offsets, at, at + len(part)))
        kinds += np.bincount(np.repeat(np.arange(n) * CLASSES, inside) + _CLASS[part], minlength=n * CLASSES)
    kinds = kinds.reshape(n, CLASSES) / np.maximum(size, 1)[:, None]

    hashes, bounds = words(texts)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    with np.errstate(over="ignore"):
        following = mix64(hashes[:-1] * np.uint64(3) + hashes[1:])
    together = doc[1:] == doc[:-1]
    distinct, most = _distinct(doc, hashes, n)
    pairs, _ = _distinct(doc[1:][together], following[together], n)
    same = together & (hashes[1:] == hashes[:-1])
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(count),
        "word_bytes": size * (1 - kinds[:, 6] - kinds[:, 7]) / per,
        "upper": kinds[:, 1], "lower": kinds[:, 2], "digits": kinds[:, 3], "ends": kinds[:, 4],
        "pipes": kinds[:, 5], "newlines": kinds[:, 6], "symbols": kinds[:, 8], "beyond_ascii": kinds[:, 0],
        "distinct_words": distinct / per, "distinct_pairs": pairs / np.maximum(count - 1, 1),
        "stutter": np.bincount(doc[1:][same], minlength=n) / per, "most_common": most / per,
    }
    return np.stack([columns[name] for name in FEATURES], 1)


def _distinct(doc: np.ndarray, values: np.ndarray, n: int):
    """How many distinct values each document has, and how often its most frequent one occurs."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    runs = np.diff(np.append(np.flatnonzero(first), len(d)))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, d[first], runs)
    return np.bincount(d[first], minlength=n), most


@dataclass
class Model:
    prior: float = 0.0
    edges: list = field(default_factory=list)  # per feature
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, table)

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.prior)
        if self.edges:
            bins = binned(x, self.edges)
            for i, table in enumerate(self.tables):
                raw += table[bins[:, i]]
            for i, j, table in self.pairs:
                raw += table[bins[:, i] * PAIR_BINS // BINS, bins[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def binned(x: np.ndarray, edges: list) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], 1)


def _value(g, h):
    return -g / (h + SHRINK)


def _gain(g, h, n):
    return np.where(n >= LEAST, g * g / (h + SHRINK), -np.inf)


def _line_tree(bins, g, h):
    """A tree of up to three leaves over one feature's bins, as a table."""
    sums = [np.bincount(bins, w, minlength=BINS) for w in (g, h, np.ones(len(g)))]
    leaves = [(0, BINS)]
    for _ in range(2):
        best = (0.0, None)
        for leaf in leaves:
            left = [np.cumsum(s[leaf[0] : leaf[1]])[:-1] for s in sums]
            total = [s[leaf[0] : leaf[1]].sum() for s in sums]
            if len(left[0]):
                gain = _gain(*left) + _gain(*(t - p for t, p in zip(total, left))) - total[0] ** 2 / (total[1] + SHRINK)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (leaf, leaf[0] + at + 1))
        if best[1] is None:
            break
        leaf, at = best[1]
        leaves.remove(leaf)
        leaves += [(leaf[0], at), (at, leaf[1])]
    table = np.zeros(BINS)
    for a, b in leaves:
        table[a:b] = _value(sums[0][a:b].sum(), sums[1][a:b].sum())
    return table


def _quadrants(a, b, g, h):
    """The best cut of two features into four quadrants: (gain, table)."""
    cell = a * PAIR_BINS + b
    sums = [np.bincount(cell, w, minlength=PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (g, h, np.ones(len(g)))]
    low = [np.cumsum(np.cumsum(s, 0), 1) for s in sums]
    parts = [
        (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1],
         c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
        for c in low
    ]
    gain = sum(np.where(n > 0, G * G / (H + SHRINK), 0) for G, H, n in zip(*parts))
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    table = np.zeros((PAIR_BINS, PAIR_BINS))
    i, j = at[0] + 1, at[1] + 1
    values = [_value(G[at], H[at]) for G, H in zip(parts[0], parts[1])]
    table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = values
    return float(gain[at]), table


def fit(x: np.ndarray, labels) -> Model:
    """A model for rows of features. Without both labels it only has a prior."""
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(prior=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, i], cuts)) for i in range(x.shape[1])]
    bins = binned(x, model.edges)
    coarse = bins * PAIR_BINS // BINS
    raw = np.full(len(y), model.prior)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    model.tables = [np.zeros(BINS) for _ in range(x.shape[1])]
    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            step = RATE * _line_tree(bins[:, i], *slopes())
            table += step
            raw += step[bins[:, i]]
    g, h = slopes()
    ranked = sorted(
        ((_quadrants(coarse[:, i], coarse[:, j], g, h)[0], i, j) for i in range(x.shape[1]) for j in range(i)),
        reverse=True,
    )
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _quadrants(coarse[:, i], coarse[:, j], *slopes())[1]
            table += step
            raw += step[coarse[:, i], coarse[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "quality", most: int = SAMPLE) -> Model:
    """Fits on labelled documents for which ``learn`` holds, a condition on rows of ``labels``."""

    def measured(batches):
        for batch in batches:
            rows = pa.FixedSizeListArray.from_arrays(pa.array(features(batch.column(0)).ravel()), len(FEATURES))
            yield pa.RecordBatch.from_arrays([rows.cast(pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                                             ["features", "label", "order"])

    docs = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text_column}`").alias("_text"))  # names may clash
    rows = (
        training_rows(docs, labels, learn, id_column, label_column, most)
        .select(F.col("_text").cast("string"), "label", F.xxhash64("_id").alias("order"))
        .mapInArrow(measured, "features array<double>, label int, order bigint")
        .toArrow()
        .sort_by([("order", "ascending")])
    )
    x = rows["features"].combine_chunks().values.to_numpy().reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_pylist())


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts have the score of a text without words. Repeated rows score alike. Columns named like the
    added ones are replaced. An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        column = pa.Array.from_pandas(texts, type=pa.large_string())
        return pd.Series(np.concatenate([np.zeros(0), *(model.scores(features(part)) for part in chunks(column, CHUNK))]))

    return docs.withColumn("score", scored(F.col(f"`{text_column}`").cast("string"))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
