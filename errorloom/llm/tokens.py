"""Byte-level token ids of whole texts, as little-endian unsigned 32-bit integers.

The vocabulary file is a parameter. Ids are those of the ``tokenizers`` library with the file's own
special strings recognised in texts; tests compare the two.
"""

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 0
SPECIAL = "<|endoftext|>"
CHUNK_BYTES = 8 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _coder(path: str):
    """The encoding, and for each id whether its bytes begin with a space. Kept by the Python worker."""
    import public_tokenizers
    import tiktoken

    ranks = _ranks(path)
    coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={SPECIAL: len(ranks)})
    spaced = np.zeros(len(ranks) + 1, dtype=bool)
    spaced[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True
    return coder, spaced


def _ranks(path: str) -> dict:
    """Byte sequences by id, from a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # Printable Latin-1 characters stand for their own byte, the others for 256 and up in order.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if token != SPECIAL}


def _bytes(ids: list) -> bytes:
    return array("I", ids).tobytes()


def encode_all(texts: pa.Array, path: str) -> Iterator[bytes]:
    """The ids of each text; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + CHUNK_BYTES, "right")))
        yield from _encode_chunk(texts.slice(first, last - first), path)
        first = last


def _encode_chunk(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Encodes each distinct word once.

    Ids never reach over a space that stands alone between other characters, so texts can be cut there.
    Texts with other white space around a space, or with a special string, are encoded whole.
    """
    coder, spaced = _coder(path)
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds, values = bounds - bounds[0], lists.flatten()
    coded = values.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy()
    words = distinct.to_numpy(zero_copy_only=False)
    trimmed = pc.and_(pc.not_equal(distinct, ""), pc.equal(pc.utf8_trim_whitespace(distinct), distinct))
    special = pc.match_substring(distinct, SPECIAL)
    alone = pc.and_not(trimmed, special).to_numpy(zero_copy_only=False)

    ids = np.array(array("I", coder.encode_ordinary(" ".join(["", *words[alone]]))), dtype="<u4")
    begins = np.flatnonzero(spaced[ids])
    if len(begins) != alone.sum():
        alone[:] = False
        begins = begins[:0]
    at, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    at[alone], lengths[alone] = begins, np.diff(np.append(begins, len(ids)))

    fine, counts = alone[codes], lengths[codes]
    opening = bounds[:-1]
    counts[opening] = 0  # the first word has no space before it
    ends = np.cumsum(counts)
    flat = ids[np.repeat(at[codes] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
    whole = np.add.reduceat(~fine, opening) > 0 if len(codes) else np.zeros(0, bool)
    for doc, (start, stop) in enumerate(zip(bounds[:-1], bounds[1:])):
        if whole[doc]:
            yield _bytes(coder.encode(texts[doc].as_py(), allowed_special="all"))
        else:
            head = _bytes(coder.encode_ordinary(words[codes[start]]))
            yield head + flat[ends[start] : ends[stop - 1]].tobytes()
