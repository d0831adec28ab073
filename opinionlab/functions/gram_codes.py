"""Character n-grams of Arrow texts as integers: what Spark's explode and groupBy would count row by row, by sorting in numpy.

A piece of texts has codes for its own characters, so that a gram and the group
it is counted for fit 64 bits.  Pieces hold about 2^20 bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_TOP = 0x110000


def _string_offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


def points(grams: list[str], n: int) -> np.ndarray:
    """Code points of grams of n characters, a row each."""
    return np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, n)


def strings(matrix: np.ndarray) -> pa.Array:
    """The grams of rows of code points."""
    n = matrix.shape[1]
    flat = matrix.astype(np.uint32).ravel()
    sizes = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(sizes.reshape(-1, n).sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(matrix), pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes().decode("utf-32-le").encode("utf-8")))


def runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of own, in order, and how often each occurs."""
    own = np.sort(own)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[starts], np.diff(np.concatenate([starts, [len(own)]])).astype(np.int64)


class Piece:
    """Texts (no nulls) and the group that each one's grams are counted for."""

    def __init__(self, texts: pa.Array, groups: np.ndarray, high: int):
        at = _string_offsets(texts)
        data = bytes(texts.buffers()[2][int(at[0]) : int(at[-1])]) if at[-1] > at[0] else b""
        self.points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts, self.groups = texts, groups
        self.own = np.repeat(np.arange(len(texts)), sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.points))
        seen = np.zeros(_TOP, bool)
        seen[self.points] = True
        self.chars = np.flatnonzero(seen)
        self.place = np.full(_TOP, -1, np.int32)
        self.place[self.chars] = np.arange(len(self.chars))
        self.codes = self.place[self.points].astype(np.uint64)
        self.bits = max(1, (len(self.chars) - 1).bit_length())
        self.group_bits = int(groups.max()).bit_length() if len(groups) else 0
        self.fits = high * self.bits + self.group_bits <= 63
        self.names: dict[int, dict[str, int]] = {}  # of a text with too many different characters for packed codes

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The place and the code of each gram of n characters."""
        k = max(0, len(self.codes) - n + 1)
        ok = self.left[:k] >= n
        if not self.fits:
            text, names = self.texts[0].as_py(), self.names.setdefault(n, {})
            return np.arange(k), np.fromiter((names.setdefault(text[i : i + n], len(names)) for i in range(k)), np.uint64, k)
        ids = self.codes[:k]
        for j in range(1, n):
            ids = (ids << np.uint64(self.bits)) | self.codes[j : j + k]
        return np.flatnonzero(ok), ids[ok]

    def width(self, n: int) -> int:
        return n * self.bits if self.fits else len(self.points).bit_length()

    def decode(self, ids: np.ndarray, n: int) -> pa.Array:
        if not self.fits:
            names = list(self.names[n])
            return pa.array([names[i] for i in ids], pa.string())
        low = np.uint64((1 << self.bits) - 1)
        return strings(np.stack([self.chars[((ids >> np.uint64(self.bits * (n - 1 - j))) & low).astype(np.int64)] for j in range(n)], axis=1) if len(ids) else np.zeros((0, n), np.uint32))

    def tally(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, gram's code, how often) of grams of n characters."""
        at, ids = self.grams(n)
        width = np.uint64(self.width(n))
        keys, counts = runs((self.groups[self.own[at]].astype(np.uint64) << width) | ids)
        return (keys >> width).astype(np.int64), keys & np.uint64((1 << int(width)) - 1), counts

    def find(self, vocabulary: Vocabulary, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The text and the place in the vocabulary of each gram of n characters that is in it."""
        at, ids = self.grams(n)
        matrix, places = vocabulary.by_size.get(n, (np.zeros((0, n), np.uint32), np.zeros(0, np.int64)))
        if not self.fits:
            known = {vocabulary.grams[p]: p for p in places}
            found = np.array([known.get(g, -1) for g in self.names[n]], np.int64)[ids.astype(np.int64)] if len(ids) else np.zeros(0, np.int64)
        else:
            codes = self.place[matrix]
            there = (codes >= 0).all(axis=1)
            own = np.zeros(int(there.sum()), np.uint64)
            for j in range(n):
                own = (own << np.uint64(self.bits)) | codes[there, j].astype(np.uint64)
            places = places[there]
            if n * self.bits <= 20:
                table = np.full(1 << (n * self.bits), -1, np.int64)
                table[own.astype(np.int64)] = places
                found = table[ids.astype(np.int64)]
            else:
                mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
                maybe = np.zeros(1 << 20, bool)
                maybe[mixed(own)] = True
                keep = maybe[mixed(ids)]
                at, ids = at[keep], ids[keep]
                order = np.argsort(own)
                own, places = own[order], places[order]
                near = np.minimum(np.searchsorted(own, ids), max(0, len(own) - 1))
                found = np.where(own[near] == ids, places[near], -1) if len(own) else np.full(len(ids), -1, np.int64)
        hit = found >= 0
        return self.own[at[hit]], found[hit]


class Vocabulary:
    """Grams, by their size."""

    def __init__(self, grams: list[str]):
        self.grams = grams
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(g) for g in grams}:
            places = np.array([i for i, g in enumerate(grams) if len(g) == n], np.int64)
            self.by_size[n] = (points([grams[i] for i in places], n), places)


def pieces(texts: pa.Array, groups: np.ndarray, high: int) -> Iterator[tuple[int, Piece]]:
    """The number of texts before it, and each piece; groups are small integers."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    at, start = _string_offsets(texts), 0
    waiting: list[tuple[int, int]] = []
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + PIECE, side="right")) - 1)
        waiting.append((start, end))
        while waiting:
            a, b = waiting.pop()
            # groups from 0, so that they need few bits
            own = groups[a:b] - groups[a:b].min()
            piece = Piece(texts.slice(a, b - a), own, high)
            if not piece.fits and b - a > 1:
                waiting += [((a + b) // 2, b), (a, (a + b) // 2)]
                continue
            piece.groups, piece.base = own, int(groups[a:b].min())
            yield a, piece
        start = end


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts of an array of lists of texts, and the row of each."""
    return column.flatten(), np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
