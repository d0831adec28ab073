"""Vectorised words and word n-grams of Arrow text batches.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of
the lower-cased text.  Words get a 64-bit polynomial hash from prefix sums over
the bytes of a whole chunk of texts, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one round of numpy calls.
CHUNK = 1 << 20
#: Bits of an n-gram's hash.
GRAM_BITS = 45
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, row offsets into them) for runs of rows of about CHUNK bytes; null is an empty text."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        last = min(last, len(texts), first + 0xFFFF)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, its hash)."""
    rows = np.arange(len(offsets) - 1)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over the end of a text is cut there
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]) if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return np.repeat(rows, np.diff(np.searchsorted(starts, offsets))), hashes


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, grams): row first + i has the sorted distinct n-gram hashes grams[bounds[i]:bounds[i + 1]].

    A text of fewer than n words has one gram, made of all of them; a text without words has none.
    """
    for first, data, offsets in text_chunks(texts):
        row, word = words(data, offsets)
        count = np.bincount(row, minlength=len(offsets) - 1)
        begin = np.concatenate([[0], np.cumsum(count)])
        padded = np.concatenate([word, np.zeros(n, np.uint64)])
        position = np.arange(len(word)) - begin[row]
        left = count[row] - position
        gram = np.zeros(len(word), np.uint64)
        for k in range(n):
            here = padded[k : k + len(word)] * np.uint64(2 * k + 3)
            gram = mix(gram + np.where(left > k, here, np.uint64(0))) if k else here
        keep = (left >= n) | (position == 0)
        key = (row[keep].astype(np.uint64) << np.uint64(48)) | (mix(gram[keep]) >> np.uint64(64 - GRAM_BITS))
        key = np.sort(key)
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        bounds = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(48))
        yield first, bounds, key & np.uint64((1 << 48) - 1)
