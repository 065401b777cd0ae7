"""Words of whole Arrow string columns as 64-bit hashes, without making a Python string of any.

Letters A-Z count as lower case. Texts are scanned in stretches of bounded length that end between
words, so memory does not grow with the longest text.
"""

import numpy as np
import pyarrow as pa

STRETCH = 1 << 18
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# For terms: every ASCII character but letters and digits parts words.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)[_LOWER]
_BASE = 0xD1342543DE82EF95


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict = {}


def power_tables(count: int):
    """Powers of the base and of its inverse modulo 2^64, long enough for ``count`` bytes."""
    if _tables.get("count", 0) < count:
        _tables["up"] = _powers(_BASE, count)
        _tables["down"] = _powers(pow(_BASE, -1, 1 << 64), count)
        _tables["count"] = count
    return _tables["up"], _tables["down"]


def buffers(texts: pa.Array):
    """The bytes of all texts and where each begins, with the end last. Null counts as empty."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def words(texts: pa.Array, separators: np.ndarray = SPACES, beginnings: tuple = ()):
    """Hashes of all words in order, and the number of words before each text, with the total last.

    With ``beginnings`` a row per word: its hash, and those of its first so many bytes (of all, if fewer).
    """
    data, offsets = buffers(texts)
    hashes, places, at = [np.zeros((0, 1 + len(beginnings)), np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        while end < len(data) and not separators[data[end]]:
            ahead = np.flatnonzero(separators[data[end : end + 65536]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + 65536)
        part = data[at:end]
        starts, ends = _bounds(part, offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at, separators)
        if len(starts):
            up, down = power_tables(len(part))
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[part] * up[: len(part)], dtype=np.uint64)])
                stops = [ends, *(np.minimum(starts + size, ends) for size in beginnings)]
                hashes.append(np.stack([mix64((sums[to] - sums[starts]) * down[starts] + _ODD) for to in stops], 1))
            places.append(starts + at)
        at = end
    places = np.concatenate(places)
    hashes = np.concatenate(hashes)
    return hashes if beginnings else hashes[:, 0], np.searchsorted(places, offsets)


def _bounds(part: np.ndarray, text_starts: np.ndarray, separators: np.ndarray):
    """Where words start and end. Words end with their text too."""
    inside = ~separators[part]
    cut = np.ones(len(part) + 1, dtype=bool)
    cut[1:-1] = ~inside[:-1]
    cut[text_starts] = True
    starts = np.flatnonzero(inside & cut[:-1])
    after = np.ones(len(part) + 1, dtype=bool)
    after[:-1] = ~inside
    after[text_starts] = True
    ends = np.flatnonzero(inside & after[1:]) + 1
    return starts, ends


def chunks(texts: pa.Array, most: int, places: bool = False):
    """Slices of a column with about ``most`` bytes each, or one text; with ``places``, where each begins."""
    _, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        part = texts.slice(first, last - first)
        yield (first, part) if places else part
        first = last
