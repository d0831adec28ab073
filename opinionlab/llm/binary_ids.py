"""Operator 9, token ids as binary: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Texts are encoded by a public vocabulary (operator 10's model file, by operator
10).  Ids are counted over all
documents and ranked, the commonest first, ties by id; the vocabulary is fixed,
so the ranking has at most as many rows as it has pieces.  A document's ranks
are written with one to four bytes each, least significant first; two bits for
each rank's length go to control bytes of their own, four ranks to a byte.
Decoding looks the four lengths of a control byte up in a numpy table, sums
them to offsets and gathers the data bytes, without a loop over tokens.

Texts are encoded once: their raw ids are written to the shared folder, counted
there and recoded from there.

Defined results: texts are coded whole, however long; of ids that are equally
common the lesser one gets the lower rank; a null text has null control and data and n_tokens 0, an empty
text empty ones; a null doc_id stays null; repeated rows give repeated rows; an
empty table gives an empty result and no ranks; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .tables import give_back, stored

#: The byte lengths of the four values under each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def _binaries(data: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    """data[bounds[i]:bounds[i + 1]] as binary i, null where said."""
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(null), [valid, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(int32 values, bounds) of a column of packed ids; a null has none."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(np.int32) if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.int32), (bounds - bounds[0]) // 4


def _coded(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control, its bounds, data, its bounds) of consecutive runs of values (sizes[i] each)."""
    values = np.ascontiguousarray(values, "<u4")
    length = np.ones(len(values), np.uint8)
    for k in range(1, 4):
        length += values >= 1 << 8 * k
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < length[:, None]]
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])]
    groups = (sizes + 3) // 4
    first = np.concatenate([[0], np.cumsum(groups)])
    used = np.ones(int(first[-1]) * 4, bool)
    for k in range(3):  # a run's last control byte has up to three values unused
        used[(first[:-1] * 4 + sizes + k)[sizes + k < groups * 4]] = False
    codes = np.zeros(len(used), np.uint8)
    codes[used] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control, first, data, ends


def compress(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of consecutive runs of values (sizes[i] each)."""
    control, by_control, data, by_data = _coded(values, sizes)
    cut = lambda x, at: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return cut(control, by_control), cut(data, by_data)


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of one run."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(length)
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(length > k, padded[ends - length + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def token_ids(docs: DataFrame, model: str = pieces.MODEL) -> DataFrame:
    """(doc_id, raw): packed int32 ids of each text, null for a null text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.encoder(model)
        for part in pieces.parts(batches, 1):
            ids, bounds = own.encode_batch(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _binaries(ids.astype(np.int32).view(np.uint8), bounds * 4, np.array(part.column(1).is_null()))], names=["doc_id", "raw"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, raw binary")


def ranks(raw: DataFrame) -> DataFrame:
    """(rank, id, n) of the ids in raw, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(_values(batch.column(0))[0])
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["id", "n"])

    counts = raw.select("raw").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row for each piece of the vocabulary
    return counts.selectExpr("row_number() OVER (ORDER BY n DESC, id) - 1 AS rank", "id", "n").selectExpr("cast(rank AS long) rank", "id", "n")


def write_binary(docs: DataFrame, model: str = pieces.MODEL) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_tokens, control, data) of each row, (rank, id, n) to decode them with)."""
    raw = stored(token_ids(docs, model))
    table = stored(ranks(raw))
    known = table.toPandas()
    rank_of = np.zeros(int(known["id"].max()) + 1 if len(known) else 1, np.uint32)
    rank_of[known["id"].to_numpy(np.int64)] = known["rank"].to_numpy(np.uint32)

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces.parts(batches, 1):
            values, bounds = _values(part.column(1))
            sizes, null = np.diff(bounds), np.array(part.column(1).is_null())
            control, by_control, data, by_data = _coded(rank_of[values], sizes)
            columns = [_binaries(control, by_control, null), _binaries(data, by_data, null)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *columns], names=["doc_id", "n_tokens", "control", "data"])
        give_back()

    return raw.mapInArrow(recode, "doc_id long, n_tokens long, control binary, data binary"), table


def read_binary(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, ids) of what write_binary gives; the table is as large as the vocabulary."""
    known = table.orderBy("rank").toPandas()
    id_of = known["id"].to_numpy(np.int32)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, n, control, data = (batch.column(k) for k in range(4))
            ids = [None if c is None else id_of[expand(c, x, k)].tolist() for k, c, x in zip(n.to_pylist(), control.to_pylist(), data.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encoded.select("doc_id", "n_tokens", "control", "data").mapInArrow(apply, "doc_id long, ids array<int>")
