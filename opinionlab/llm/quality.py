"""Operator 8, quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are the documents labelled quality 1; unlabelled are all
documents without a label (labels of quality 0 are never trained on, they only
measure the result in tests).  Each text is described by shares of byte classes
and by statistics of its words, and these by ``UNITS`` seeded random tanh units,
themselves and a constant.  A function g, linear in these, minimises

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),  l(z) = (1 - z)^2 / 4

plus ``DECAY`` |w|^2 / 4, over every positive and every unlabelled document: with
this loss the risk depends on the rows only by their number, mean and second
moments, which Spark sums.  It equals the greatest value over 0 <= c <= 1 of
prior * E_P[l(g)] + c * (E_U[l(-g)] - prior * E_P[l(-g)]), which is convex in w for
each c, so its least value is where the best w for c = 1 keeps the second term at
0 or above, or else at the c that brings it to 0, found by bisection.

The class prior is estimated from a positive-against-unlabelled discriminator:
the least ratio of the share of unlabelled to the share of positive documents
above a score.  A document is kept where g >= threshold; the threshold is 0 or,
if lower, the score that ``keep_rate`` of held-out trusted positives reach.  A
fifth of the documents, by a hash of doc_id, is held out for both; their scores
are counted in ``BINS`` bins.

Defined results: a null text or one without words has score 0 and is not kept;
texts are described whole, however long; without any positive or any unlabelled
document with words there is no model, score is 0 and every document with words
is kept; a null doc_id is scored but never used in fitting; repeated rows count
each and get equal results; a document labelled both 1 and 0 counts as
positive; equal scores are kept or not alike; an empty table gives an empty
result; further columns are passed on by ``filter_quality`` and ignored by
``quality_scores``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .tables import discard, give_back, stored

CLASSES = ["upper", "lower", "digit", "high", "space", "newline", "stop", "comma", "bang", "mark", "bar", "other"]
FEATURES = [*CLASSES, "log_words", "word_length", "distinct", "repeated", "line_words", "caps_words", "long_words"]
_CLASS = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _bytes in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "space": [32, 9], "newline": [10, 13], "stop": [46, 58, 59, 63], "comma": [44], "bang": [33], "mark": b"#$%&*@^~<>{}[]=+_\\/", "bar": [124]}.items():
    _CLASS[list(_bytes)] = CLASSES.index(_name)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; a text without words has zeros only."""
    plain = texts.cast(pa.large_string()).fill_null("")
    out = np.zeros((len(plain), len(FEATURES)), np.float32)
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    data = np.frombuffer(plain.buffers()[2], np.uint8) if plain.buffers()[2] is not None and plain.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(plain):
        last = min(len(plain), max(first + 1, int(np.searchsorted(offsets, offsets[first] + grams.CHUNK, "right")) - 1))
        raw, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        out[first:last] = _chunk(raw, bounds)
        first = last
    return out


def _chunk(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n, size = len(bounds) - 1, np.diff(bounds)
    row = np.repeat(np.arange(n), size)
    kinds = len(CLASSES)
    counts = np.bincount(row * kinds + _CLASS[raw], minlength=n * kinds).reshape(n, kinds).astype(np.float64)
    lowered = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * 32
    owner, word = grams.words(lowered, bounds)
    total = np.bincount(owner, minlength=n).astype(np.float64)
    least = np.maximum(total, 1)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (word >> np.uint64(20)))
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1]))
    repeated = np.bincount(owner[again], minlength=n)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 2] + counts[:, 3]
    shares = counts / np.maximum(size, 1)[:, None]
    more = np.stack([np.log1p(total), letters / least, distinct / least**0.8, repeated / least, np.log1p(total / (counts[:, 5] + 1)), counts[:, 0] / least, letters / (counts[:, 4] + counts[:, 5] + 1)], 1)
    return (np.concatenate([shares, more], 1) * (total > 0)[:, None]).astype(np.float32)


#: Random units, their seed, weight decay, bins of held-out scores, and where those end.
UNITS, SEED, DECAY, BINS, ENDS = 128, 3, 1e-3, 8192, 4.0
WORDS = FEATURES.index("log_words")


@dataclass
class Model:
    """g(x) = w . units(x)."""

    centre: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float = 0.0
    prior: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        # row by row the same sum, whatever the batch
        return np.einsum("ij,j->i", units(x, self.centre, self.scale), self.w)


def units(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What g is linear in: a constant, the standardised and clipped features, and random tanh units of them."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(0, 1 / np.sqrt(len(FEATURES)), (len(FEATURES), UNITS)), rng.normal(0, 1, UNITS)
    z = np.clip((x.astype(np.float64) - centre) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z / 3, np.tanh(np.einsum("ij,jk->ik", z, a) + b)], 1)


@dataclass
class Moments:
    """Number, sum and sum of outer products of rows."""

    n: float
    one: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        return cls(float(len(rows)), rows.sum(0), rows.T @ rows)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.one + other.one, self.two + other.two)

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        return self.one / self.n, self.two / self.n


def risks(w: np.ndarray, p: Moments, u: Moments, prior: float) -> tuple[float, float]:
    """(prior * E_P[l(g)], E_U[l(-g)] - prior * E_P[l(-g)]) of g = w . units."""
    (p1, p2), (u1, u2) = p.mean(), u.mean()
    loss = lambda sign, one, two: (1 - 2 * sign * w @ one + w @ two @ w) / 4
    return prior * loss(1, p1, p2), loss(-1, u1, u2) - prior * loss(-1, p1, p2)


def least_risk(p: Moments, u: Moments, prior: float) -> np.ndarray:
    """The w of least non-negative risk, decay included."""
    (p1, p2), (u1, u2) = p.mean(), u.mean()
    decay = DECAY * np.eye(len(p1))

    def best(c: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - c) * p2 + c * u2 + decay, prior * (1 + c) * p1 - c * u1)

    if risks(best(1.0), p, u, prior)[1] >= 0:
        return best(1.0)
    low, high = 0.0, 1.0
    for _ in range(50):
        c = (low + high) / 2
        low, high = (c, high) if risks(best(c), p, u, prior)[1] >= 0 else (low, c)
    return best(low)


def discriminator(p: Moments, u: Moments) -> np.ndarray:
    """The w that tells positive from unlabelled rows with the least mean squared loss, both kinds counting alike."""
    (p1, p2), (u1, u2) = p.mean(), u.mean()
    return np.linalg.solve((p2 + u2) / 2 + DECAY * np.eye(len(p1)), (p1 - u1) / 2)


def _ratio(above_p: np.ndarray, above_u: np.ndarray, n_p: float, n_u: float) -> float:
    slack = (np.sqrt(above_u / n_u) + np.sqrt(above_p / n_p)) / 4
    return float(np.clip(((above_u + slack) / above_p).min(), 0.05, 0.99))


def estimate_prior(sp: np.ndarray, su: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among unlabelled: min over scores t of P_U(score >= t) / P_P(score >= t), where at least ``least`` of P lie above t."""
    edges = np.linspace(min(sp.min(), su.min()), max(sp.max(), su.max()) + 1e-9, BINS + 1)
    return _prior(np.histogram(sp, edges)[0], np.histogram(su, edges)[0], least)


def _prior(p: np.ndarray, u: np.ndarray, least: float = 0.1) -> float:
    """estimate_prior of counts by ascending bins of scores."""
    above_p, above_u = p[::-1].cumsum()[::-1] / p.sum(), u[::-1].cumsum()[::-1] / u.sum()
    good = above_p >= least
    return _ratio(above_p[good], above_u[good], p.sum(), u.sum())


def _bins(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + ENDS) * (BINS / (2 * ENDS))).astype(np.int64), 0, BINS - 1)


def _summed(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of make(role, x), an array of that width, over rows(role, x): by partition, then by ``SUMS`` tasks, then here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += make(batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                total += np.frombuffer(own, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = rows.select("role", "x").mapInArrow(part, "total binary").repartition(SUMS).mapInArrow(whole, "total binary")
    return sum((np.frombuffer(r[0], np.float64) for r in parts.collect()), np.zeros(width))


#: Tasks that add up the partitions' sums; each gives the driver one row of at most a few hundred kilobytes.
SUMS = 8
#: A row's role: positive or unlabelled, fitted on or held out.
_P, _U, _HELD_P, _HELD_U = range(4)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row: its features as packed floats."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 4 * len(FEATURES)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "x"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, x binary")


def train(known: DataFrame, labels: DataFrame, keep_rate: float = 0.99, prior: float | None = None) -> Model | None:
    """The model of known(doc_id, x), as ``described`` gives it, and labels(doc_id, quality), or None where there is nothing to fit."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    # labelled, but not 1: no part in it
    role = F.when(F.col("id").isNull(), F.when(held, _HELD_U).otherwise(_U)).when(F.col("good"), F.when(held, _HELD_P).otherwise(_P))
    rows = stored(known.filter("doc_id is not null").join(marks, F.col("doc_id") == F.col("id"), "left").select(role.cast("int").alias("role"), "x").filter("role is not null"))
    d = len(FEATURES)

    def scales(role: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = x[x[:, WORDS] > 0].astype(np.float64)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    first = _summed(rows, scales, 2 * d + 1)
    if not first[0]:
        return None
    centre = first[1 : d + 1] / first[0]
    scale = np.sqrt(np.maximum(0, first[d + 1 :] / first[0] - centre**2)) + 1e-6
    m = 1 + d + UNITS

    def moments(role: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = []
        for k in range(4):
            own = Moments.of(units(x[(role == k) & (x[:, WORDS] > 0)], centre, scale))
            out += [[own.n], own.one, own.two.ravel()]
        return np.concatenate(out)

    total = _summed(rows, moments, 4 * (1 + m + m * m)).reshape(4, -1)
    by = [Moments(r[0], r[1 : m + 1], r[m + 1 :].reshape(m, m)) for r in total]
    for kind, spare in ((_P, _HELD_P), (_U, _HELD_U)):  # tiny tables: what is held out is fitted on, or the other way round
        if not by[kind].n + by[spare].n:
            discard(rows)
            return None
        by[kind] = by[kind] if by[kind].n else by[spare]
    spare = {k for k in (_HELD_P, _HELD_U) if by[k].n}

    def counted(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def counts(role: np.ndarray, x: np.ndarray) -> np.ndarray:
            good = x[:, WORDS] > 0
            at = _bins(Model(centre, scale, w).score(x))
            return np.concatenate([np.bincount(at[good & ((role == k) | (k not in spare) & (role == k - 2))], minlength=BINS) for k in (_HELD_P, _HELD_U)]).astype(np.float64)

        return tuple(_summed(rows, counts, 2 * BINS).reshape(2, -1))

    if prior is None:
        prior = _prior(*counted(np.round(discriminator(by[_P], by[_U]), 9)))
    w = np.round(least_risk(by[_P], by[_U], prior), 9)
    p, _ = counted(w)
    discard(rows)
    low = int(np.searchsorted(p.cumsum(), (1 - keep_rate) * p.sum(), "right"))
    return Model(centre, scale, w, min(0.0, low * (2 * ENDS / BINS) - ENDS), prior)


def judge(x: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(score rounded to 6 digits, kept) of each row of features."""
    full = x[:, WORDS] > 0
    score = np.where(full, np.round(model.score(x), 6) + 0.0, 0.0) if model else np.zeros(len(x))
    return score, full & (score >= model.threshold) if model else full


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, score, kept) of each row of docs."""
    known = stored(described(docs))
    model = train(known, labels, **how)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, kept = judge(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, len(FEATURES)), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(kept)], names=["doc_id", "score", "kept"])

    return known.mapInArrow(apply, "doc_id long, score double, kept boolean")


def filter_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    known = stored(described(docs))
    model = train(known, labels, **how)
    discard(known)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out = pa.array(judge(features(texts), model)[1])
        give_back()
        return out

    return docs.filter(kept(docs["text"]))
