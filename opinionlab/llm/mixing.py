"""Operator 4, mixing sources to target weights by subset-sum budget fitting.

A document's length is its number of tokens, runs of characters other than
white space.  Documents are counted by source and exact length; each source's
budget is its weight's share of the total budget, which is, where not given,
the largest that every weighted source can fill.  For each source the counts by
length are then fitted: first the same share of every length, rounded down, then
one more of the longest lengths while they fit, then a bounded-knapsack dynamic
programme over the unused counts for what remains.  Where those cannot meet the
budget, documents are handed back to the programme until it is met or all are
back, so that it is missed by the least that any choice allows (a budget of over
``CELLS`` tokens that cannot be met is left at the programme's best).
Within a source and length, documents are taken in the order of a seeded hash
of doc_id and text.

The documents' rows are not moved: of each source and length only the hash of
the last document taken is found, on rows of a few bytes, and the documents are
kept by comparing with it.  These cuts have at most one row for each source and
length; they are broadcast up to ``broadcast_rows`` and joined by key beyond.

Defined results: null, empty and blank texts have length 0 and are never taken;
a source (null included) without a weight, or with weight 0 or less, is left
out; rows that repeat a doc_id and text have equal hashes and are taken all or,
where the cut falls among them, none, so a budget may be missed by their
lengths but is never exceeded; a null doc_id is hashed as such; a weighted
source without documents makes the default budget 0 only if it is named with
``require_all``, else it is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import give_back, stored

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Tokens up to which documents are handed back to a programme that misses its budget.
CELLS = 4_000_000
#: Weights of the tables' sources: src0 .. src19.
WEIGHTS = {f"src{i}": 2.0 + i % 2 for i in range(20)}


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space (space, tab, line breaks, form feed); 0 for null.

    Declared non-deterministic: else a filter or join by it is pushed below and
    counts again, in a Python worker of its own beside the task's other one.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        plain = texts.cast(pa.large_string()).fill_null("")
        out = np.zeros(len(plain), np.int64)
        if len(plain) and plain.buffers()[2] is not None:
            offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
            data = np.frombuffer(plain.buffers()[2], np.uint8)
            first = 0
            while first < len(plain):  # about a megabyte at a time
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 20), "right")) - 1)
                raw, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                inside = ~_BLANK[raw]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                heads = bounds[:-1][bounds[:-1] < len(raw)]
                begins[heads] = inside[heads]
                sums = np.concatenate([[0], np.cumsum(begins)])
                out[first:last] = sums[bounds[1:]] - sums[bounds[:-1]]
                first = last
        del plain
        give_back()
        return pa.array(out)

    return count.asNondeterministic()(text)


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is budget, or as little less as any choice allows."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((lengths * counts).sum())
    gap = total - budget
    if gap <= 0:
        taken = counts.copy()
    elif gap <= 4 * int(lengths[0]):  # nearly all: choose what to leave out instead, the least sum from gap on
        taken = counts - _knapsack(lengths[::-1], counts[::-1], gap, gap + int(lengths[0]))[::-1]
    else:
        taken = counts * budget // total if total * max(1, int(counts.max(initial=0))) < 1 << 62 else (counts * (budget / total)).astype(np.int64)
        rest = budget - int((lengths * taken).sum())
        while rest < 0:  # only after the rounded division
            k = int(np.flatnonzero(taken)[-1])
            taken[k] -= 1
            rest += int(lengths[k])
        free = counts - taken
        for k in range(len(lengths)):  # keep some of the rest for the programme, which then meets it nearly always
            more = min(int(free[k]), max(0, rest - 4 * int(lengths[0])) // int(lengths[k]))
            taken[k] += more
            rest -= more * int(lengths[k])
        fitted = _knapsack(lengths, counts - taken, rest)
        back = 64
        while int((lengths * fitted).sum()) < rest and taken.any() and rest <= CELLS:
            # nothing unused fits: hand some of what is taken back to the programme, the shortest first, at last all of it
            before = np.concatenate([np.cumsum(taken[::-1])[::-1][1:], [0]])  # documents taken of shorter lengths
            given = np.clip(back - before, 0, taken)
            taken, rest, back = taken - given, rest + int((lengths * given).sum()), back * 4
            fitted = _knapsack(lengths, counts - taken, rest)
        taken += fitted
    out = np.empty_like(taken)
    out[order] = taken
    return out


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int, upto: int | None = None) -> np.ndarray:
    """Bounded knapsack: counts within free whose lengths sum to the largest reachable value up to budget, or with upto the least from budget to upto."""
    most = budget if upto is None else upto
    by = np.full(most + 1, -1, np.int64)  # the item that first reached a sum
    by[0] = -2
    items: list[tuple[int, int]] = []
    for k, (length, n) in enumerate(zip(lengths.tolist(), free.tolist(), strict=True)):
        n, part = min(n, most // length), 1
        while n > 0 and by[budget] == -1:  # binary parts of the count
            size = min(part, n)
            step = size * length
            fresh = np.flatnonzero((by[step:] == -1) & (by[: len(by) - step] != -1)) + step
            by[fresh] = len(items)
            items.append((k, size))
            n -= size
            part *= 2
        if by[budget] != -1:
            break
    reached = np.flatnonzero(by != -1)
    at, out = int(reached[-1] if upto is None else reached[reached >= budget][0]), np.zeros(len(lengths), np.int64)
    # an item reaches new sums only from sums that earlier items reached, so going back never meets it twice
    while at:
        k, size = items[by[at]]
        out[k] += size
        at -= size * int(lengths[k])
    return out


def budgets(histogram: DataFrame, weights: dict[str, float], budget: int | None, require_all: bool) -> dict[str, int]:
    """Tokens to take of each weighted source."""
    have = {r["source"]: int(r["tokens"]) for r in histogram.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("tokens")).filter(F.col("source").isin([w for w in weights])).collect()}
    own = {s: float(w) for s, w in weights.items() if w > 0 and (s in have or require_all)}
    if not own:
        return {}
    whole = sum(own.values())
    if budget is None:
        budget = int(min(have.get(s, 0) * whole / w for s, w in own.items()))
    return {s: min(have.get(s, 0), int(budget * (w / whole))) for s, w in own.items()}


def _counted(docs: DataFrame, weights: dict[str, float], seed: int) -> DataFrame:
    """(source, length, h) of the weighted sources' documents that have tokens."""
    own = docs.filter(F.col("source").isin(list(weights)))
    return own.select("source", n_tokens(F.col("text")).alias("length"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")).filter(F.col("length") > 0)


def plan(docs: DataFrame, weights: dict[str, float], budget: int | None = None, seed: int = 11, require_all: bool = False) -> DataFrame:
    """(source, length, cut): of a source's documents of that length those with a hash up to cut are taken."""
    slim = stored(_counted(docs, weights, seed))  # 8 bytes a document and more: texts are read once
    histogram = stored(slim.groupBy("source", "length").agg(F.count("*").alias("n")))
    target = budgets(histogram, weights, budget, require_all)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("length", ignore_index=True)
        take = fit_lengths(rows["length"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), target.get(rows["source"].iloc[0], 0))
        return rows[["source", "length"]].assign(take=take)[take > 0]

    takes = histogram.filter(F.col("source").isin(list(target))).groupBy("source").applyInPandas(fitted, "source string, length long, take long")
    group = Window.partitionBy("source", "length")
    # of equal hashes all get the number of the last, so that a cut never falls among them
    ranked = slim.withColumn("rank", F.count("*").over(group.orderBy("h").rangeBetween(Window.unboundedPreceding, 0)))
    return ranked.join(takes, ["source", "length"]).filter("rank <= take").groupBy("source", "length").agg(F.max("h").alias("cut"))


def _taken(docs: DataFrame, weights: dict[str, float], budget: int | None, seed: int, require_all: bool, broadcast_rows: int) -> tuple[DataFrame, str, str]:
    """The rows taken, with two more columns of fresh names: length and cut."""
    cuts = stored(plan(docs.select("doc_id", "text", "source"), weights, budget, seed, require_all))
    length, cut, source = (_fresh(docs, x) for x in ("length", "cut", "cut_source"))
    cuts = cuts.select(F.col("source").alias(source), F.col("length").alias(f"{length}_"), F.col("cut").alias(cut))
    cuts = F.broadcast(cuts) if cuts.limit(broadcast_rows + 1).count() <= broadcast_rows else cuts
    with_length = docs.withColumn(length, n_tokens(docs["text"]))
    joined = with_length.join(cuts, (with_length["source"] == cuts[source]) & (with_length[length] == cuts[f"{length}_"]))
    return joined.filter(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")) <= F.col(cut)), length, cut


def _fresh(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name = f"_{name}"
    return name


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, budget: int | None = None, seed: int = 11, require_all: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents taken."""
    rows, length, _ = _taken(docs.select("doc_id", "text", "source"), weights, budget, seed, require_all, broadcast_rows)
    return rows.select("doc_id", "source", F.col(length).alias("n_tokens"))


def mix_rows(docs: DataFrame, weights: dict[str, float] = WEIGHTS, budget: int | None = None, seed: int = 11, require_all: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents taken, with all their columns."""
    rows, _, _ = _taken(docs, weights, budget, seed, require_all, broadcast_rows)
    return rows.select([rows[f"`{c}`"] for c in docs.columns])
