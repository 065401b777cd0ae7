"""Languages of texts, also of texts that mix several.

A text's words are runs of letters of one script. The script of a word narrows down which languages it can be
in: those that wrote at least ``RARE`` of their training letters in that script, or all if none did. Each
candidate's score of the word adds up, letter by letter, the logarithms of how often the language has the two and
the three letters around it (beginnings and ends of words count as letters); scores are made posteriors of
the word and cut off at ``-SURE``, so that no single word decides. Viterbi's algorithm then finds the sequence of
languages with the greatest sum, where every change of language costs ``SWITCH``: neighbours in one
language make a span, and a stray foreign word does not break it.

Training counts letters in the tasks that read the text and brings a table of fixed size to the driver: at
most ``MOST_LANGUAGES`` (the most frequent) times 2^17 counts, of about ``SAMPLE`` documents a
language, chosen by a hash of id and text. All texts are labelled whole.
"""

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errorloom.llm.wordscan import chunks

SAMPLE = 4_000
MOST_LANGUAGES = 128
BUCKET_BITS = 16
RARE = 0.01
SURE = 6.0
SWITCH = 12.0
CHUNK = 1 << 22  # bytes of texts whose paths are found together
UNKNOWN = "und"

# Where the blocks of scripts lie in Unicode. Letters elsewhere share the script "other".
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F), (0xFB13, 0xFB17)]),
    ("hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)]),
    ("devanagari", [(0x900, 0x97F), (0xA8E0, 0xA8FF)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("gurmukhi", [(0xA00, 0xA7F)]),
    ("gujarati", [(0xA80, 0xAFF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("telugu", [(0xC00, 0xC7F)]),
    ("kannada", [(0xC80, 0xCFF)]),
    ("malayalam", [(0xD00, 0xD7F)]),
    ("sinhala", [(0xD80, 0xDFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("lao", [(0xE80, 0xEFF)]),
    ("tibetan", [(0xF00, 0xFFF)]),
    ("burmese", [(0x1000, 0x109F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("ethiopic", [(0x1200, 0x139F)]),
    ("khmer", [(0x1780, 0x17FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("han", [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]),
]
NO_LETTER, MARK, OTHER = 0, 1, 2  # before the scripts' numbers, which start at 3
SCRIPT_COUNT = 3 + len(SCRIPTS)
_LAST = 0x323B0  # no letters from here on
WORD_LETTERS = 24  # scripts without spaces: a longer run is cut into words of so many letters

BUCKETS = 2 << BUCKET_BITS  # pairs, then triples
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("letters", pa.int32()), ("confidence", pa.float64())])
LABELLED = (
    "doc_id bigint, lang_pred string, score double, "
    "spans array<struct<start int, end int, lang string, letters int, confidence double>>"
)
_tables: list = []


def _letters():
    """By code point: the script's number, whether it is a letter proper, and its lower case if that is one code point."""
    if not _tables:
        script, letter = np.zeros(_LAST + 1, np.uint8), np.zeros(_LAST + 1, bool)
        lower = np.arange(_LAST + 1, dtype=np.uint32)
        named = np.full(_LAST + 1, OTHER, np.uint8)
        for number, (_, blocks) in enumerate(SCRIPTS, 3):
            for first, last in blocks:
                named[first : last + 1] = number
        for point in range(_LAST):
            char = chr(point)
            if (kind := unicodedata.category(char)[0]) == "L":
                script[point], letter[point] = named[point], True
                if len(low := char.lower()) == 1:
                    lower[point] = ord(low)
            elif kind == "M":
                script[point] = named[point] if named[point] > OTHER else MARK
        _tables.extend((script, letter, lower))
    return _tables


def _words(points: np.ndarray):
    """Words of a stretch of code points: where each starts and ends, its script, its letters, and by letter the buckets
    of the pair and the triple that it ends or is the middle of."""
    script_of, letter_of, lower = _letters()
    points = np.minimum(points, _LAST)
    script, letter = script_of[points], letter_of[points]
    if (marks := np.flatnonzero(script == MARK)).size:  # a mark belongs to what it stands on
        owner = np.maximum.accumulate(np.where(script == MARK, 0, np.arange(len(script))))
        script[marks] = np.where(script[owner[marks]] > MARK, script[owner[marks]], OTHER)
    inside = script > 0
    before = np.concatenate([np.zeros(1, np.uint8), script[:-1]])
    starts = np.flatnonzero(inside & (script != before))
    after = np.concatenate([script[1:], np.zeros(1, np.uint8)])
    ends = np.flatnonzero(inside & (script != after)) + 1
    if (long := ends - starts > WORD_LETTERS).any():
        pieces = np.where(long, -(-(ends - starts) // WORD_LETTERS), 1)
        first = np.repeat(starts, pieces)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, last = first + nth * WORD_LETTERS, np.repeat(ends, pieces)
        ends = np.minimum(starts + WORD_LETTERS, last)
    counts = np.concatenate([np.zeros(1, np.int64), np.cumsum(letter)])
    letters = counts[ends] - counts[starts]
    if (letters == 0).any():
        starts, ends, letters = starts[letters > 0], ends[letters > 0], letters[letters > 0]
    at = np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts) + np.arange((ends - starts).sum())
    low = lower[points].astype(np.uint64)
    here = low[at]
    is_start, is_end = np.zeros(len(points), bool), np.zeros(len(points), bool)
    is_start[starts], is_end[ends - 1] = True, True
    ahead = np.where(is_end[at], np.uint64(0), low[np.minimum(at + 1, len(points) - 1)])
    behind = np.where(is_start[at], np.uint64(0), low[at - 1])
    pair = (here * np.uint64(0x9E3779B97F4A7C15) + ahead * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BUCKET_BITS)
    both = here * np.uint64(0x9E3779B97F4A7C15) + ahead * np.uint64(0xC2B2AE3D27D4EB4F) + behind * np.uint64(0x165667B19E3779F9)
    triple = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)
    return starts, ends, script[starts], letters, pair.astype(np.int64), triple.astype(np.int64) + (1 << BUCKET_BITS)


def _stretches(points: np.ndarray, size: int):
    """Cuts of about ``size`` code points, between words where there is a place within ``size`` more."""
    script = _letters()[0]
    at = 0
    while at < len(points):
        end = min(len(points), at + size)
        if end < len(points):
            gap = np.flatnonzero(script[np.minimum(points[end : end + size], _LAST)] == NO_LETTER)
            end = end + int(gap[0]) if len(gap) else min(len(points), end + size)
        yield at, points[at:end]
        at = end


def _points(texts: pa.Array):
    """The code points of all texts with a line end after each, and where each text begins, the total last."""
    strings = [t or "" for t in texts.to_pylist()]
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(s) + 1 for s in strings])])
    joined = "\n".join([*strings, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), begin


class Model:
    """Log frequencies of pairs and triples of letters by language, and which languages use a script."""

    def __init__(self, langs: list, counts: np.ndarray):
        self.langs = langs
        shown, scripts = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:]
        half = BUCKETS // 2
        logs = [np.log(part + 0.05) - np.log(part.sum(1, keepdims=True) + 0.05 * half) for part in (shown[:, :half], shown[:, half:])]
        self.table = np.ascontiguousarray(np.concatenate(logs, 1).T / 2, dtype=np.float32)
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.allowed = (share >= RARE).T
        self.allowed[~self.allowed.any(1)] = True

    def word_scores(self, points: np.ndarray):
        """(starts, ends, letters, log posteriors by language) of all words."""
        out = []
        if not self.langs:
            points = points[:0]
        for at, part in _stretches(points, max(1 << 14, (1 << 21) // max(1, len(self.langs)))):
            starts, ends, script, letters, pair, triple = _words(part)
            if not len(starts):
                continue
            first = np.cumsum(ends - starts) - (ends - starts)
            scores = np.full((len(starts), len(self.langs)), -np.inf)
            for s in np.unique(script):
                can, rows = np.flatnonzero(self.allowed[s]), script == s
                if rows.all():
                    summed = np.add.reduceat(self.table[:, can][pair] + self.table[:, can][triple], first, dtype=np.float64)
                else:
                    these = np.repeat(rows, ends - starts)
                    size = (ends - starts)[rows]
                    table = self.table[:, can]
                    summed = np.add.reduceat(table[pair[these]] + table[triple[these]], np.cumsum(size) - size, dtype=np.float64)
                summed -= summed.max(1, keepdims=True)
                scores[np.ix_(rows, can)] = summed - np.log(np.exp(summed).sum(1, keepdims=True))
            out.append((starts + at, ends + at, letters, np.maximum(scores, -SURE)))
        if not out:
            return [np.zeros(0, np.int64)] * 3 + [np.zeros((0, len(self.langs)))]
        return [np.concatenate(parts) for parts in zip(*out)]


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: text i has the words from ``bounds[i]`` to ``bounds[i + 1]``.

    All texts go forward together, word by word. A change pays if the best other language is ahead by more than
    ``switch``; of equal paths the one that stays longer, then the earlier language, is taken.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, left = bounds[:-1][order], np.sort(sizes)
    steps = int(sizes.max()) if len(scores) else 0
    if not steps:
        return np.zeros(0, np.int16)
    changed, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    state = np.zeros((len(sizes), scores.shape[1]))
    for t in range(steps):
        active = len(sizes) - int(np.searchsorted(left, t, "right"))
        at, now = first[:active] + t, state[:active]
        if t:
            best = now.argmax(1)
            leap = now[np.arange(active), best][:, None] - switch
            source[at], changed[at] = best, now < leap
            np.maximum(now, leap, out=now)
        now += scores[at]
    path, now = np.zeros(len(scores), np.int16), state.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        active = len(sizes) - int(np.searchsorted(left, t, "right"))
        at, here = first[:active] + t, now[:active]
        path[at] = here
        now[:active] = np.where(changed[at, here], source[at], here)
    return path


def count_letters(batches, size: int):
    """Counts by (language number, bucket or script) of one task's texts."""
    counts = np.zeros((size, BUCKETS + SCRIPT_COUNT), np.int64)
    for batch in batches:
        numbers = batch.column(1).to_numpy(zero_copy_only=False)
        for begin, texts in chunks(batch.column(0), CHUNK, places=True):
            points, bounds = _points(texts)
            for at, part in _stretches(points, 1 << 19):
                starts, ends, script, _, pair, triple = _words(part)
                text = np.searchsorted(bounds, starts + at, "right") - 1
                lang = numbers[begin + text]
                for number in np.unique(lang):
                    rows = np.repeat(lang == number, ends - starts)
                    counts[number, :BUCKETS] += np.bincount(pair[rows], minlength=BUCKETS)[:BUCKETS]
                    counts[number, :BUCKETS] += np.bincount(triple[rows], minlength=BUCKETS)[:BUCKETS]
                    words = lang == number
                    counts[number, BUCKETS:] += np.bincount(script[words], (ends - starts)[words], SCRIPT_COUNT).astype(np.int64)
    lang, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": counts[lang, bucket]})


def train(docs: DataFrame, lang: str = "lang", where: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model of the languages that column ``lang`` names, of rows that satisfy ``where``.

    Rows with a null text or language are not learned from; empty texts teach nothing. About ``sample`` documents a
    language are read, all if there are fewer. An empty table gives a model without languages, which
    labels everything ``und``. Other columns are not read.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("text").isNotNull() & F.col(f"`{lang}`").isNotNull() & (F.lit(True) if where is None else where))
    known = known.select("doc_id", "text", F.col(f"`{lang}`").cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    langs = sorted(row["lang"] for row in sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS + SCRIPT_COUNT), np.int64))
    shares = spark.createDataFrame(
        [(row["lang"], langs.index(row["lang"]), min(1.0, sample / row["count"])) for row in sizes], "lang string, number int, share double"
    )
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("text", "number")
    size = len(langs)
    counted = chosen.mapInArrow(lambda batches: count_letters(batches, size), "lang int, bucket int, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((size, BUCKETS + SCRIPT_COUNT), np.int64)
    counts[rows["lang"], rows["bucket"]] = rows["n"]
    return Model(langs, counts)


def label_texts(texts: pa.Array, model: Model):
    """Per text: language, score and spans, as Arrow arrays."""
    points, begin = _points(texts)
    starts, ends, letters, scores = model.word_scores(points)
    text = np.searchsorted(begin, starts, "right") - 1
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    path = viterbi(scores, bounds)
    cut = np.ones(len(path), bool)
    cut[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(path))[: len(first)] - 1
    spoken, owner = path[first].astype(np.int64), text[first]
    size, sure = np.zeros(0, np.int64), np.zeros(0)
    if len(first):
        size = np.add.reduceat(letters, first)
        sums = np.add.reduceat(scores, first, axis=0)
        sure = 1 / np.exp(sums - sums[np.arange(len(first)), spoken][:, None]).clip(max=1e300).sum(1)
    names = pa.array(model.langs, pa.string())
    spans = pa.StructArray.from_arrays(
        [pa.array(starts[first] - begin[owner], pa.int32()), pa.array(ends[last] - begin[owner], pa.int32()),
         names.take(pa.array(spoken)), pa.array(size, pa.int32()), pa.array(sure)],
        fields=list(SPAN),
    )
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    # By text and language: letters, and letters weighed by confidence.
    width = max(1, len(model.langs))
    total = np.bincount(owner * width + spoken, size, len(texts) * width).reshape(-1, width)
    weighed = np.bincount(owner * width + spoken, size * sure, len(texts) * width).reshape(-1, width)
    best, rows = total.argmax(1), np.arange(len(texts))
    found = total.sum(1) > 0
    score = np.where(found, weighed[rows, best] / np.maximum(1, total.sum(1)), 0.0).clip(0, 1)
    lang = names.take(pa.array(best, mask=~found)) if len(names) else pa.nulls(len(texts), pa.string())
    return lang.fill_null(UNKNOWN), pa.array(np.round(score, 9)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, the language of most letters, a score and the spans of languages.

    A span has its start and end (code points of the text), language, letters, and confidence: the probability of the
    language, given the span's words. The score of a text is the share of its letters that are in spans of its language,
    weighed by confidence; of languages with equally many letters the first by name counts. Texts that are null, empty or
    without a letter are ``und`` with score 0 and no spans. Repeated rows and null ids give a row each, an
    empty table an empty one. Other columns are not read, so their names may clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column(1), CHUNK, places=True):
                lang, score, spans = label_texts(texts, shared.value)
                ids = batch.column(0).slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([ids, lang, score, spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(labelled, LABELLED)
