"""Operator 10, SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

An automaton over all pieces reads a segment of text once; at each position its
output links give every piece that ends there, and each of them relaxes the
best entry of that position.

* Unigram models: the entry is the best sum of scores; a character that is no
  piece costs the least score minus 10.
* BPE models: the entry is the last token of the prefix's encoding.  Maximising
  summed scores would not give what BPE's merges give, so a piece relaxes a
  position only if it and the last token before it are what merging their joined
  text gives (kept in a table).  Exactly one piece passes, which makes the pass
  exact: a token sequence is BPE's own if and only if all its neighbours agree.

Text is cut only where no piece can span: before each "▁" that follows another
character (checked when the model is read) and around characters that occur in
no piece.  Of a few megabytes of texts the distinct words are encoded once, all
of them in step, a character at a time: one table of transitions (the
automaton's, with its failure links resolved) and one round for each output
link.  Words of over ``LONGEST`` characters, or with characters outside the
table's ``CLASSES`` commonest, go through the same pass one by one.  Nothing
about words outlives its batch.

Defined results: a null text has null ids, n_ids 0 and null round_trip; an empty
text has no ids; texts of any length are encoded whole, a run without a cut as
one word; characters outside the vocabulary become byte pieces, or the unknown
id (one for a run of them) where the model has none; where unigram sums are
equal, the piece that ends first in the automaton's order, the longest, stays; a
text with U+2581 decodes to spaces there, so its round_trip is false; a null
doc_id stays null; repeated rows give repeated rows; an empty table gives an
empty result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Of the words taken one by one, and of neighbours met there, what a worker remembers; beyond them nothing more is.
REMEMBERED = 50_000
#: Characters of words taken in step, columns of the table of transitions, words in a step, bytes of texts in a batch.
LONGEST, CLASSES, IN_STEP, BATCH = 48, 160, 40_000, 8 << 20
#: Words whose ids are gathered at once, and ids that are decoded at once (those of one text at least): index arrays have 8 bytes for each.
AT_ONCE = 1 << 18
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            raise ValueError(f"wire type {kind} in a model")


class Encoder:
    """A model file's pieces, its automaton and what this worker remembers."""

    def __init__(self, data: bytes) -> None:
        self.pieces, self.scores, self.kinds = [], [], []
        self.mode, self.dummy_prefix, fallback = UNIGRAM, True, False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(own.get(2, 0.0))
                self.kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.mode, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("only models without normalisation rules can be read")
                self.dummy_prefix = bool(own.get(3, 1))
        if self.mode not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.mode} is neither unigram nor BPE")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE} if fallback else {}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (_NORMAL, _USER)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.letters = {c for p in self.ids for c in p}
        self.single = {c for c in self.letters if c in self.ids}
        spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        alone = "".join(c for c in "\n\r\t" if c not in self.letters)
        self.cut = None if spans else re.compile(f"[{re.escape(alone)}]|{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.alone = [ord(c) for c in alone]
        self.words: dict[str, bytes] = {}
        self.agreed: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.table: Table | None = None
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.decoded = [b"" if k not in (_NORMAL, _USER, _BYTE, _UNKNOWN) else bytes([int(p[1:-1], 16)]) if k == _BYTE else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.spelled, self.widths = pa.array(self.decoded, pa.large_binary()), np.array([len(x) for x in self.decoded], np.int64)

    def merged(self, text: str) -> list[int]:
        """BPE by its definition: merge the neighbours whose joined text has the best score, the leftmost first."""
        parts = list(text)
        while True:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces that merging joins last to piece i, (-1, -1) for a character, None where merging its text gives others."""
        if i not in self.halves:
            parts, two = [*self.pieces[i]], (-1, -1)
            while len(parts) > 1:
                best = max(((self.scores[x], -k) for k in range(len(parts) - 1) if (x := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = -best[1]
                two = self.ids.get(parts[k], -1), self.ids.get(parts[k + 1], -1)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[i] = two if len(parts) == 1 and (len(self.pieces[i]) == 1 or min(two) >= 0) else None
        return self.halves[i]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two; with nothing before it (left unknown), whether it gives the one.

        Both are taken apart again, the one merged last first.  They are not
        what merging gives if a merge across their border would have come before.
        """
        if left == self.unknown:
            return self._halves(right) is not None
        if self._halves(left) is None or self._halves(right) is None:
            return False
        limit, strict = -np.inf, True  # a merge across the border comes first if its score is above limit, or equal where not strict
        while True:
            across = self.ids.get(self.pieces[left] + self.pieces[right])
            if across is not None and (self.scores[across] > limit or not strict and self.scores[across] == limit):
                return False
            l, r = self._halves(left), self._halves(right)
            if l[0] < 0 and r[0] < 0:
                return True
            if r[0] < 0 or l[0] >= 0 and self.scores[left] < self.scores[right]:
                limit, strict, left = self.scores[left], True, l[1]
            else:
                limit, strict, right = self.scores[right], False, r[0]

    def _agree(self, left: int, right: int) -> bool:
        key = left * len(self.pieces) + right
        known = self.agreed.get(key)
        if known is None:
            known = self.neighbours(left, right)
            if len(self.agreed) < REMEMBERED:
                self.agreed[key] = known
        return known

    def segment(self, text: str) -> list[int]:
        """The ids of text, taken as one run; a character that is no piece has -1 - its code."""
        n, bpe, scores, unknown, agree = len(text), self.mode == BPE, self.scores, self.unknown, self.agreed
        size = len(self.pieces)
        last = [unknown] * (n + 1)  # at a start, and after a character that is no piece, nothing precedes
        back = [0] * (n + 1)
        best = [0.0] + [-np.inf] * n
        reached = [True] + [False] * n
        upto = 0
        for end, (i, length) in self.automaton.iter(text):
            end += 1
            while upto < end:
                upto += 1
                if text[upto - 1] not in self.single and reached[upto - 1]:
                    last[upto], back[upto], best[upto], reached[upto] = -1, upto - 1, best[upto - 1] + self.least, True
            start = end - length
            if not reached[start]:
                continue
            if bpe:
                before = last[start] if last[start] >= 0 else unknown
                ok = agree.get(before * size + i)
                if ok is None:
                    ok = self._agree(before, i)
                if ok:
                    last[end], back[end], reached[end] = i, start, True
            elif (value := best[start] + scores[i]) > best[end]:
                last[end], back[end], best[end], reached[end] = i, start, value, True
        for k in range(upto, n):
            if text[k] not in self.single and reached[k]:
                last[k + 1], back[k + 1], best[k + 1], reached[k + 1] = -1, k, best[k] + self.least, True
        out = []
        at = n
        while at:
            out.append(last[at] if last[at] >= 0 else -1 - ord(text[at - 1]))
            at = back[at]
        return out[::-1]

    def _pack(self, text: str) -> bytes:
        known = self.words.get(text)
        if known is None:
            # a piece with a character that is no piece itself is out of the automaton's reach for BPE
            ids = [x if x >= 0 else -1 - ord(c) for x, c in zip(m, _split(text, m, self.pieces), strict=True)] if self.mode == BPE and any(c in self.letters and c not in self.single for c in text) and (m := self.merged(text)) else self.segment(text)
            flat = []
            for i in ids:
                flat.extend([i] if i >= 0 else [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "replace")] if self.bytes else [self.unknown])
            known = np.array(flat, np.int32).tobytes()
            if len(self.words) < REMEMBERED and len(text) < 64:
                self.words[text] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids as packed int32."""
        if not text:
            return b""
        words = self.words
        if self.cut and self.dummy_prefix and text[0] != " " and "  " not in text and SPACE not in text and "\n" not in self.letters:
            parts = []
            for k, line in enumerate(text.split("\n")):
                if k:
                    parts.append(self._pack("\n"))
                    first, *rest = line.split(" ")
                    if first:
                        parts.append(words.get(first) or self._pieces(first))
                else:
                    rest = line.split(" ")
                for word in rest:
                    word = SPACE + word
                    parts.append(words.get(word) or self._pieces(word))
            packed = b"".join(parts)
        else:
            packed = self._pieces((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))
        if not self.bytes:
            ids = np.frombuffer(packed, np.int32)
            run = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            packed = ids[np.concatenate([[True], ~run])].tobytes() if len(ids) else packed
        return packed

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._pack, self.cut.findall(text))) if self.cut else self._pack(text)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i, null or empty ones included, has ids[bounds[i]:bounds[i + 1]]."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(plain):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        odd = pc.match_substring(plain, SPACE).to_numpy(False) if self.cut and self.dummy_prefix and self.bytes else np.ones(len(plain), bool)
        odd &= (pc.binary_length(plain).to_numpy(False) > 0)
        given = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), plain) if odd.any() else plain
        ids, bounds = self._in_step(given)
        if not odd.any():
            return ids, bounds
        own = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            own[k] = np.frombuffer(self.encode(plain[k].as_py()), np.int32)
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])

    def _in_step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        full = pc.binary_length(texts).to_numpy(False) > 0
        none = np.zeros(len(texts) + 1, np.int64)
        if not full.any():
            return np.zeros(0, np.int32), none
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(pa.array(full)), pa.scalar("", pa.large_string()))
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        space, cut = data == 32, np.zeros(len(data), bool)
        for c in self.alone:
            cut |= data == c
        cut[1:] |= cut[:-1].copy()
        cut[1:] |= space[1:] & ~space[:-1]
        cut[ends[:-1]] = True
        begin = np.append(np.flatnonzero(cut), len(data))
        del space, cut
        runs = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int64, copy=False)), pa.py_buffer(data)).dictionary_encode()
        borders = np.searchsorted(begin, ends)
        del begin, data, texts
        ids, bounds = self._distinct(runs.dictionary)
        code = runs.indices.to_numpy()
        del runs
        upto = np.zeros(len(code) + 1, np.int64)
        np.cumsum(np.diff(bounds)[code], out=upto[1:])
        flat = np.empty(upto[-1], np.int32)
        for k in range(0, len(code), AT_ONCE):
            own, to = code[k : k + AT_ONCE], upto[k : k + AT_ONCE + 1]
            flat[to[0] : to[-1]] = ids[np.repeat(bounds[own] - to[:-1], np.diff(to)) + np.arange(to[0], to[-1])]
        none[1:][full] = np.diff(upto[borders])
        return flat, np.cumsum(none)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of distinct words, spaces standing for "▁"."""
        if self.table is None:
            self.table = Table(self)
        table = self.table
        size = pc.utf8_length(words).to_numpy(False).astype(np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        letters = np.frombuffer(words.buffers()[2][ends[0] : ends[-1]].to_pybytes().decode().encode("utf-32-le"), np.uint32)
        kind = table.kind_of[np.minimum(letters, len(table.kind_of) - 1)]
        del letters
        begin = np.concatenate([[0], np.cumsum(size)])
        usual = (size <= LONGEST) & (np.add.reduceat(kind < 0, begin[:-1]) == 0)
        own, count = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        at = np.flatnonzero(usual)
        at = at[np.argsort(size[at], kind="stable")]
        for k in range(0, len(at), IN_STEP):
            part = at[k : k + IN_STEP]
            ids, count[part] = table.viterbi(kind, begin[part], size[part])
            own.append(ids)
        rest = np.flatnonzero(~usual)
        for k, word in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            own.append(np.frombuffer(self._pack(word.replace(" ", SPACE)), np.int32))
            count[k] = len(own[-1])
        order = np.concatenate([at, rest])
        flat, upto = np.concatenate(own), np.concatenate([[0], np.cumsum(count[order])])
        first = np.zeros(len(words), np.int64)
        first[order] = upto[:-1]
        bounds = np.concatenate([[0], np.cumsum(count)])
        return flat[np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])], bounds

    def same(self, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether each text is what its ids decode to."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        out, at = np.ones(len(plain), bool), 0
        while at < len(plain):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
            out[at:end] = self._same(plain.slice(at, end - at), ids[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
            at = end
        return out

    def _same(self, plain: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        size = np.diff(np.concatenate([[0], np.cumsum(self.widths[ids])])[bounds])
        same = size == pc.binary_length(plain).to_numpy(False) + ((size > 0) & self.dummy_prefix)
        held = same & (size > 0)  # of one length, which is not 0
        if held.any():
            back = np.frombuffer(pc.take(self.spelled, pa.array(ids)).buffers()[2], np.uint8)[: size.sum()]
            if not held.all():
                back, plain = back[np.repeat(held, size)], plain.filter(pa.array(held))
            if self.dummy_prefix:
                plain = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), plain, pa.scalar("", pa.large_string()))
            ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
            wrong = back != np.frombuffer(plain.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            same[held] = ~np.logical_or.reduceat(wrong, ends[:-1] - ends[0])
        return same

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Table:
    """The automaton as arrays, for many words in step."""

    def __init__(self, own: Encoder) -> None:
        self.own, self.size, self.bpe = own, len(own.pieces), own.mode == BPE
        uses: Counter = Counter(c for p in own.ids for c in set(p) if c in own.single)
        uses[SPACE] = len(own.ids) if SPACE in own.single else 0
        kinds = {c: k for k, (c, n) in enumerate(uses.most_common(CLASSES)) if n and ord(c) < 0x3000}
        self.kind_of = np.full(0x3001, -1, np.int16)
        for c, k in kinds.items():
            self.kind_of[ord(c)] = k
        if SPACE in kinds:
            self.kind_of[32], self.kind_of[ord(SPACE)] = kinds[SPACE], -1
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for p, i in own.ids.items():
            if all(c in kinds for c in p):
                at = 0
                for c in p:
                    at = children[at].get(kinds[c]) or self._grow(children, piece, at, kinds[c])
                piece[at] = i
        self.step = np.zeros((len(children), len(kinds)), np.int32)
        self.piece, self.link = np.array(piece, np.int32), np.zeros(len(children), np.int32)  # link: the next shorter suffix that is a piece, 0: none
        fail, queue = [0] * len(children), []
        for c, x in children[0].items():
            self.step[0, c] = x
            queue.append(x)
        for at in queue:
            back = fail[at]
            self.link[at] = back if piece[back] >= 0 else self.link[back]
            self.step[at] = self.step[back]
            for c, x in children[at].items():
                fail[x] = int(self.step[back, c])
                self.step[at, c] = x
                queue.append(x)
        self.length, self.scores = np.array([len(p) for p in own.pieces], np.int64), np.array(own.scores, np.float64)
        # neighbours known to agree or not, by two hashes of left * size + right
        self.bits = 20
        self.keys, self.answers = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, bool)

    @staticmethod
    def _grow(children: list[dict[int, int]], piece: list[int], at: int, c: int) -> int:
        children[at][c] = new = len(piece)
        children.append({})
        piece.append(-1)
        return new

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((keys.astype(np.uint64) * np.uint64(m)) >> np.uint64(64 - self.bits)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        one, two = self._slots(keys)
        in_one, in_two = self.keys[one] == keys, self.keys[two] == keys
        out = np.where(in_one, self.answers[one], self.answers[two])
        lost = np.flatnonzero(~in_one & ~in_two)
        if len(lost):
            new, back = np.unique(keys[lost], return_inverse=True)
            answers = np.array([self.own.neighbours(k // self.size, k % self.size) for k in new.tolist()], bool)
            out[lost] = answers[back]
            one, two = self._slots(new)
            slot = np.where(self.keys[one] < 0, one, two)
            # of new keys for one slot the last is kept, key and answer alike
            self.keys[slot] = new
            self.answers[slot] = answers
        return out

    def viterbi(self, kind: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's) of words sorted by size, which are runs of kind."""
        n, most = len(size), int(size[-1])
        last, back = np.full((most + 1, n), self.own.unknown, np.int32), np.zeros((most + 1, n), np.int16)
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0  # for BPE: 0 where reached
        state = np.zeros(n, np.int32)
        for end in range(1, most + 1):
            first = int(np.searchsorted(size, end))
            word = np.arange(first, n)
            state = state[len(state) - len(word) :]
            state = self.step[state, kind[begin[first:] + end - 1]]
            at = np.where(self.piece[state] >= 0, state, self.link[state])
            while True:
                live = at > 0
                if not live.all():
                    word, at = word[live], at[live]
                if not len(word):
                    break
                piece = self.piece[at]
                start = end - self.length[piece]
                before = best[start, word]
                if self.bpe:
                    good = before == 0
                    good[good] = self.agree(last[start[good], word[good]], piece[good])
                    value = np.zeros(len(word))
                else:
                    value = before + self.scores[piece]
                    good = value > best[end, word]
                won = word[good]
                last[end, won], back[end, won], best[end, won] = piece[good], start[good], value[good]
                at = self.link[at]
        # back from the ends
        out, word, at = [], np.arange(n), size.astype(np.int64)
        count = np.zeros(n, np.int64)
        while len(word):
            out.append((word, last[at, word]))
            count[word] += 1
            at = back[at, word].astype(np.int64)
            word, at = word[at > 0], at[at > 0]
        upto = np.cumsum(count)
        ids = np.empty(int(upto[-1]), np.int32)
        for k, (word, piece) in enumerate(out):
            ids[upto[word] - 1 - k] = piece
        return ids, count


def _split(text: str, ids: list[int], pieces: list[str]) -> list[str]:
    out, at = [], 0
    for i in ids:
        size = len(pieces[i]) if i >= 0 else 1
        out.append(text[at : at + size])
        at += size
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    with open(path, "rb") as f:
        return Encoder(f.read())


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BATCH bytes of a column of texts or binaries, one row at least."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False).astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + BATCH, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): round_trip tells whether decoding the ids gives the text again."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for part in parts(batches, 1):
            texts = part.column(1)
            ids, bounds = own.encode_batch(texts)
            null = np.array(texts.is_null())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=pa.array(null)) if len(texts) else pa.array([], pa.list_(pa.int32()))
            same = pa.array(own.same(texts, ids, bounds), mask=null)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists, pa.array(np.diff(bounds)), same], names=["doc_id", "ids", "n_ids", "round_trip"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(apply, "doc_id long, text string")
