"""Operator 2, n-gram Jaccard join by prefix trees, exact.

A text's set holds the hashes of its distinct word n-grams.  Two sets join if
their Jaccard similarity is at least t.  No pair is left to chance:

1. **Shared n-grams.**  One pass over the texts writes chunks: of each chunk the
   distinct n-grams, cut into buckets by hash range, about four bytes each, and a
   directory of its documents.  A bucket finds which of its n-grams occur
   anywhere else and answers each chunk with the documents that hold them.  A
   set can only join if at least t of its n-grams are shared; the others end
   here.  An n-gram goes once for each chunk, however many documents hold it, so
   one that a third of all documents have is no hot key.
2. **One global order.**  The sets left, one for all texts that have it, are
   counted again in the same way; n-grams are ordered by the number of sets that
   hold them (255 and more count as 255), then by hash.
3. **Prefixes.**  In the order from the rarest, two sets that join share an
   n-gram in the first |s| - ceil(t |s|) + 1 of the larger and the first
   |s| - ceil(2 t / (1 + t) |s|) + 1 of the smaller.  Of the sets that have an
   n-gram in their prefix, neighbours by size are linked where their sizes allow a
   join, and where only two meet, where what follows in both allows it.  The
   links' connected components are blocks; every pair that joins lies within one.
4. **Tries.**  Each block's sets are stored in a trie in the global order, the
   commonest n-gram first, so that similar sets share long paths.  A set goes
   down the trie level by level with the overlap it has had on the way, which all
   sets below a node share.  A subtree is left as soon as that overlap and the
   most that can still follow - what is left of the set, or of the longest set
   below - is less than the least set below would need.  A block of more than
   ``BLOCK_SETS`` sets is cut into shards of at most about that many, of similar
   sizes; a set visits the earlier shards of possible sizes with which it shares a
   prefix n-gram, and the shards' parts are added up.

A worker holds a chunk of ``CHUNK_GRAMS`` n-grams, a bucket of about
``BUCKET_GRAMS`` entries or a shard's sets, whatever the size of the tables.
Pairs are counted where they are found and never written.

Result: a row for each text (doc_id and n-gram set): doc_id; class_id, the least
doc_id of its class, the texts connected by joins; n_links, the number of other
texts it joins itself, those with an equal set included.

Defined results: null, empty and word-free texts have no n-grams, join nothing
and are classes of their own; a text of fewer than n words has one n-gram, all
its words; texts of any length are read whole; texts under one doc_id with
different sets are rows of their own and can join; rows that repeat a doc_id and
a set are one text in ``join``, and ``deduplicate`` keeps one of them; texts with
a null doc_id of equal sets are one text, which counts as the greatest doc_id,
so class_id is null only where all of a class are; equal similarities need no
rule, as nothing is ranked; an empty table gives an empty result; further
columns are passed on by ``deduplicate``, whatever their names, and ignored by
``join``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .tables import discard, give_back, stored

N, T = 3, 0.5
#: Rows up to which a table of ids (16 to 24 bytes a row) is broadcast; beyond, tables are joined by key.
BROADCAST_ROWS = 500_000
#: n-grams of a chunk, and of a chunk of sets; entries that a bucket should have; sets of a shard; documents of a chunk (numbered by 16 bits).
CHUNK_GRAMS, SET_GRAMS, BUCKET_GRAMS, BLOCK_SETS, CHUNK_DOCS = 2_000_000, 500_000, 1_000_000, 1024, 60_000
#: n-grams of a chunk that are computed with at once.
AT_ONCE = 1 << 18
#: Least number of buckets is this many times the shuffle partitions.
BUCKETS_EACH = 2
#: Bits of an n-gram that stand for it within a bucket.  Two of a bucket's n-grams that have the same only count as shared.
BITS = 28
#: Sizes of a shard's sets lie within this factor.
STEP = 1.25
_SEVERAL = 0xFFFF
_CHUNKS = "chunk long, bucket int, n int, body binary"
_LOW = np.uint64((1 << grams.GRAM_BITS) - 1)


def _signatures(bounds: np.ndarray, own: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams.mix(own + np.uint64(1)), dtype=np.uint64)])
    return (sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _least(t: float, size: np.ndarray) -> np.ndarray:
    """The least whole number of at least t * size."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


# ---- chunks, buckets and answers


def _planes(x: np.ndarray) -> bytes:
    """Numbers as differences, byte by byte of significance: of ascending ones the shuffle's compression then leaves little more than the bytes that differ."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(body: bytes, n: int, kind: type = np.uint32, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(body, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel(), dtype=kind)


def _slices(own: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets that have any, bounds of each, BITS bits) of ascending n-gram hashes."""
    # a bucket begins at the least hash that, times buckets, reaches its number's high bits
    least = ((np.arange(buckets + 1, dtype=np.uint64) << np.uint64(grams.GRAM_BITS)) + np.uint64(buckets - 1)) // np.uint64(buckets)
    at = np.searchsorted(own, least)
    bucket = np.flatnonzero(np.diff(at))
    bits = np.empty(len(own), np.uint32)
    for k in range(0, len(own), AT_ONCE):
        bits[k : k + AT_ONCE] = ((own[k : k + AT_ONCE] * np.uint64(buckets)) & _LOW) >> np.uint64(grams.GRAM_BITS - BITS)
    return bucket, np.append(at[bucket], len(own)), bits


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "n", "body"])


def _buckets_for(entries: float, parts: int) -> int:
    return int(min(1 << 18, max(BUCKETS_EACH * parts, entries / BUCKET_GRAMS + 1)))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("sig", "<i8"), ("size", "<i4"), ("shared", "<i4")])


def _written(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Chunks of the texts: for each bucket its n-grams and the documents that hold them (or that several do), in bucket -1 the directory."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # ids, nulls, n-grams and documents in one number, signatures, sizes
        count = [0, 0, TaskContext.get().partitionId() << 32]

        def flush() -> pa.RecordBatch:
            docs = np.zeros(count[1], _DOC)
            docs["id"], docs["null"], docs["sig"], docs["size"] = (np.concatenate([x[k] for x in held]) for k in (0, 1, 3, 4))
            gram = np.concatenate([x[2] for x in held])
            held.clear()
            # one array of the chunk's n-grams at a time: it is sorted and shifted where it lies
            gram.sort()
            doc = np.ascontiguousarray(gram.astype("<u8", copy=False).view("<u2")[::4])
            gram >>= np.uint64(16)
            fresh = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
            alone = fresh & np.append(fresh[1:], True)[: len(fresh)]
            for k in range(0, len(doc), AT_ONCE):
                docs["shared"] += np.bincount(doc[k : k + AT_ONCE][~alone[k : k + AT_ONCE]], minlength=count[1]).astype(np.int32)
            doc[~alone] = _SEVERAL
            who, gram = doc[fresh], gram[fresh]
            del doc, fresh, alone
            own_buckets, at, bits = _slices(gram, buckets)
            del gram
            rows = [(count[2], -1, count[1], docs.tobytes())]
            rows += [(count[2], b, z - a, _planes(bits[a:z]) + who[a:z].tobytes()) for b, a, z in zip(own_buckets.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            count[:] = [0, 0, count[2] + 1]
            return _rows(rows)

        for batch in batches:
            for first, bounds, own in grams.gram_sets(batch.column(1), n):
                ids = batch.column(0).slice(first, len(bounds) - 1)
                sig, size = np.where(np.diff(bounds) > 0, _signatures(bounds, own), 0), np.diff(bounds)
                # a run of texts has about a megabyte or a single text, and at most 65,535 rows
                for a in range(0, len(ids), CHUNK_DOCS):
                    z = min(len(ids), a + CHUNK_DOCS)
                    if held and (count[0] + bounds[z] - bounds[a] > CHUNK_GRAMS or count[1] + z - a > CHUNK_DOCS):
                        yield flush()
                    part = ids.slice(a, z - a)
                    key = (own[bounds[a] : bounds[z]] << np.uint64(16)) | np.repeat(np.arange(count[1], count[1] + z - a, dtype=np.uint64), size[a:z])
                    held.append((part.fill_null(0).to_numpy(), np.array(part.is_null()), key, sig[a:z], size[a:z]))
                    count[0], count[1] = count[0] + int(bounds[z] - bounds[a]), count[1] + z - a
        if held:
            yield flush()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, _CHUNKS)


def _by(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in a column."""
    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and own[-1][column] != row[column]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _answers(chunks: DataFrame, counted: bool) -> DataFrame:
    """A row for each chunk and bucket: the documents with n-grams that occur elsewhere or, counted, the count of each n-gram, up to 255."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, 1):
            bits = [_numbers(body, n) for _, _, n, body in rows]
            tails = [np.frombuffer(body, np.uint16, n, 4 * n) for _, _, n, body in rows]
            every = np.concatenate(bits)
            out = []
            if counted:
                values, back = np.unique(every, return_inverse=True)
                total = np.minimum(np.bincount(back, np.concatenate(tails)), 255).astype(np.uint8)[back]
                for row, a in zip(rows, np.cumsum([0, *(len(x) for x in bits[:-1])]).tolist(), strict=True):
                    out.append((row[0], row[1], row[2], total[a : a + row[2]].tobytes()))
            else:
                order = np.sort(every)
                again = order[1:][order[1:] == order[:-1]]
                again = again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again
                for row, own, who in zip(rows, bits, tails, strict=True):
                    place = np.minimum(np.searchsorted(again, own), max(0, len(again) - 1))
                    found = who[(again[place] == own) & (who != _SEVERAL)] if len(again) else who[:0]
                    if len(found):
                        out.append((row[0], row[1], len(found), found.tobytes()))
            yield _rows(out)
        give_back()

    return chunks.filter("bucket >= 0").repartition(_parts(chunks), "bucket").sortWithinPartitions("bucket").mapInArrow(apply, _CHUNKS)


def _described(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(doc_id, sig, size, shared) of each row of docs: its set's signature and size, and whether enough of it is shared to join anything."""
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = stored(_written(docs, n, _buckets_for(length / 7, _parts(docs))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, 0):
            docs = np.frombuffer(rows[0][3], _DOC)
            shared = docs["shared"] + np.bincount(np.frombuffer(b"".join(r[3] for r in rows[1:]), np.uint16), minlength=len(docs))
            good = (docs["size"] > 0) & (shared >= _least(t, docs["size"]))
            yield pa.RecordBatch.from_arrays([pa.array(docs["id"].copy(), mask=docs["null"] > 0), pa.array(docs["sig"].copy()), pa.array(docs["size"].astype(np.int64)), pa.array(good)], names=["doc_id", "sig", "size", "shared"])
        give_back()

    both = chunks.filter("bucket < 0").union(_answers(chunks, False)).repartition(_parts(docs), "chunk").sortWithinPartitions("chunk", "bucket")
    out = stored(both.mapInArrow(apply, "doc_id long, sig long, size long, shared boolean"))
    discard(chunks)
    return out


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _joinable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _few(df) else df.hint("shuffle_hash")


_SET = np.dtype([("sig", "<i8"), ("size", "<i4")])


def _ordered(docs: DataFrame, carriers: DataFrame, n: int, t: float) -> DataFrame:
    """(sig, size, path, prefix, left, index) of each carrier's set.

    path: its shared n-grams as numbers that ascend in the global order, the
    commonest first; prefix: those of them a larger set must share one of, the
    rarest first, of which a smaller one needs the first ``index``; left: the
    length of path.
    """
    parts = _parts(docs)
    total = carriers.agg(F.sum("size")).first()[0] or 0
    buckets = _buckets_for(total, parts)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = carriers.select(F.col("doc_id").alias("carrier")).distinct()
    found = texts.join(_joinable(ids.filter("carrier is not null")), F.col("doc_id") == F.col("carrier"), "left_semi")
    if ids.filter("carrier is null").count():
        found = found.union(texts.filter("doc_id is null"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bounds, own in grams.gram_sets(batch.column(0), n):
                packed = pa.array([_planes(own[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_signatures(bounds, own)), packed], names=["sig", "grams"])

    # rows that repeat a carrier's doc_id can have other sets; those of a null doc_id, the same again
    own = found.select("text").mapInArrow(sets, "sig long, grams binary").join(_joinable(carriers.select("sig")), "sig", "left_semi")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        count, chunk, last = 0, TaskContext.get().partitionId() << 32, None
        for batch in batches:
            for sig, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sig == last:
                    continue
                last = sig
                if held and (count + len(packed) // 8 > SET_GRAMS or len(held) >= CHUNK_DOCS):
                    yield flush(chunk, held)
                    held, count, chunk = [], 0, chunk + 1
                held.append((sig, packed))
                count += len(packed) // 8
        if held:
            yield flush(chunk, held)
        give_back()

    def flush(chunk: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        head = np.array([(sig, len(x) // 8) for sig, x in held], _SET)
        own = np.concatenate([_numbers(x, len(x) // 8, np.uint64) for _, x in held])
        return _rows([(chunk, -1, len(held), head.tobytes() + _planes(own))])

    def opened(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        head = np.frombuffer(body, _SET, n)
        return head, _numbers(body, int(head["size"].sum()), np.uint64, head.nbytes)

    whole = stored(own.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(chunked, _CHUNKS))

    def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                gram, times = np.unique(opened(body, n)[1], return_counts=True)
                own, at, bits = _slices(gram, buckets)
                times = times.astype(np.uint16)
                yield _rows([(chunk, b, z - a, _planes(bits[a:z]) + times[a:z].tobytes()) for b, a, z in zip(own.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, 0):
            n = rows[0][2]
            head, own = opened(rows[0][3], n)
            size = head["size"].astype(np.int64)
            _, back = np.unique(own, return_inverse=True)
            times = np.frombuffer(b"".join(r[3] for r in rows[1:]), np.uint8)[back]
            key = (np.uint64(255) - times.astype(np.uint64) << np.uint64(grams.GRAM_BITS)) | own
            doc = np.repeat(np.arange(n), size)
            many = times > 1
            key, doc = key[many], doc[many]
            key = key[np.lexsort((key, doc))]
            long = np.bincount(doc, minlength=n)
            ends = np.cumsum(long)
            # from the rarest: n-grams that no other set has come first and are in no path
            alone = size - long
            probe = np.clip(size - _least(t, size) + 1 - alone, 0, long)
            index = np.clip(size - _least(2 * t / (1 + t), size) + 1 - alone, 0, long)
            paths = [key[e - k : e] for e, k in zip(ends.tolist(), long.tolist(), strict=True)]
            prefix = pa.array([p[::-1][:k].tobytes() for p, k in zip(paths, probe.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(head["sig"].copy()), pa.array(size), pa.array([_planes(p) for p in paths], pa.binary()), prefix, pa.array(long), pa.array(index)], names=["sig", "size", "path", "prefix", "left", "index"])
        give_back()

    answers = _answers(whole.mapInArrow(scattered, _CHUNKS), True)
    both = whole.union(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket")
    out = stored(both.mapInArrow(ordered, "sig long, size long, path binary, prefix binary, left long, index long"))
    discard(whole)
    return out


# ---- links of prefixes, and blocks

#: An n-gram in a set's prefix: its hash, the set, its size, how many n-grams of it are left from this one on, whether it is in its index.
_ENTRY = np.dtype([("gram", "<u4"), ("sig", "<i8"), ("size", "<u4"), ("left", "<u4"), ("index", "u1")])


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The least node of each node's component under the links a - b."""
    root = np.arange(nodes)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _entries(bodies: list[bytes], field: str) -> np.ndarray:
    """A field of entries that were packed as columns of bytes."""
    kind, at = _ENTRY.fields[field]
    columns = (np.frombuffer(body, np.uint8).reshape(_ENTRY.itemsize, -1)[at : at + kind.itemsize] for body in bodies)
    return np.concatenate([np.ascontiguousarray(c.T).view(kind).ravel() for c in columns])


def _met(gram: np.ndarray, size: np.ndarray, left: np.ndarray, index: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of entries to link, so that all pairs that may join are connected; sizes are below 2 ** 31."""
    key = gram.astype(np.uint64)
    key <<= np.uint64(32)
    key |= size.astype(np.uint32) << np.uint32(1) | (index == 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    index, size = (key & np.uint64(1)) == 0, (key.astype(np.uint32) >> np.uint32(1)).astype(np.int32)
    key >>= np.uint64(32)
    # runs of one n-gram, cut where a size and the next rule each other out
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (size[:-1] < t * size[1:] - 1e-9)])
    del key
    run = np.cumsum(head, dtype=np.int32)
    run -= 1
    # of a pair the smaller has it in its index: sets before the first such have no larger one to join
    first = np.full(run[-1] + 1, len(run), np.int32)
    np.minimum.at(first, run[index], np.flatnonzero(index).astype(np.int32))
    good = np.arange(len(run), dtype=np.int32) >= first[run]
    link = np.flatnonzero(good[:-1] & good[1:] & (run[1:] == run[:-1]))
    alone = np.bincount(run[good], minlength=run[-1] + 1)[run[link]] == 2
    a, b = order[link], order[link + 1]
    enough = np.minimum(left[a], left[b]) >= t / (1 + t) * (size[link].astype(np.int64) + size[link + 1]) - 1e-9
    return a[~alone | enough], b[~alone | enough]


def _links(sets: DataFrame, t: float) -> DataFrame:
    """(a, b): signatures, linked so that all sets that may join by their prefixes are connected."""
    entries = sets.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    buckets = int(max(1, min(1 << 18, entries / BUCKET_GRAMS + 1)))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, full, left, index = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
            prefix = batch.column(1).to_pylist()
            size = np.array([len(p) // 8 for p in prefix], np.int64)
            gram = grams.mix(np.frombuffer(b"".join(prefix), np.uint64))
            bucket = (gram >> np.uint64(32)).astype(np.int64) % buckets
            own = np.zeros(len(gram), _ENTRY)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
            own["gram"], own["sig"], own["size"] = gram.astype(np.uint32), np.repeat(sig, size), np.repeat(full, size)
            own["left"], own["index"] = np.repeat(left, size) - place, place < np.repeat(index, size)
            order = np.argsort(bucket, kind="stable")
            own, at = own[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            # columns of bytes, for the compression's sake
            yield _rows([(0, b, int(at[b + 1] - at[b]), np.ascontiguousarray(own[at[b] : at[b + 1]].view(np.uint8).reshape(-1, _ENTRY.itemsize).T).tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, 1):
            bodies = [r[3] for r in rows]
            rows.clear()
            gram, size, left, index = (_entries(bodies, x) for x in ("gram", "size", "left", "index"))
            a, b = _met(gram, size, left, index, t)
            del gram, size, left, index
            sig = _entries(bodies, "sig")
            del bodies
            names, node = np.unique(sig, return_inverse=True)
            del sig
            root = _forest(node[a], node[b], len(names))
            child = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[root[child]]), pa.array(names[child])], names=["a", "b"])
        give_back()

    scattered = sets.select("sig", "prefix", "size", "left", "index").mapInArrow(scatter, _CHUNKS)
    return scattered.repartition(min(buckets, _parts(sets)), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "a long, b long").distinct()


class Trie:
    """Sets in a trie; sets: ascending numbers, whose order is that of the levels, commonest first.

    size: of the whole sets, which may have more n-grams than those given here.
    Unless others are to be matched as well, n-grams of a single set are left out.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, t: float, others: bool = False) -> None:
        m = len(sets)
        self.t, self.size = t, size
        long = np.array([len(s) for s in sets], np.int64)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        if not others:
            common = counts > 1
            rank = np.where(common, np.cumsum(common) - 1, -1)
            values, ranks = values[common], rank[inverse]
        else:
            ranks = inverse
        self.values, begin = values, np.concatenate([[0], np.cumsum(long)])
        self.paths = [r[r >= 0] for r in (ranks[begin[k] : begin[k + 1]] for k in range(m))]
        paths = self.paths
        # built from the paths in order and the length of each one's prefix shared with the one before
        order = sorted(range(m), key=lambda k: paths[k].astype(">u4").tobytes())
        parent, low, owner, ends_at = [-1], [0], [0], np.zeros(m, np.int64)  # a node's n-grams: paths[owner][low:high]
        high, stack = [0], [0]
        before: np.ndarray | None = None
        for k in order:
            path = paths[k]
            shared = 0
            if before is not None:
                short = min(len(path), len(before))
                differ = np.flatnonzero(path[:short] != before[:short])
                shared = int(differ[0]) if len(differ) else short
                while high[stack[-1]] > shared:
                    node = stack.pop()
                    if high[stack[-1]] < shared:  # split node: its upper part becomes a node of its own
                        parent.append(stack[-1])
                        low.append(low[node])
                        high.append(shared)
                        owner.append(owner[node])
                        parent[node], low[node] = len(parent) - 1, shared
                        stack.append(len(parent) - 1)
                        break
            if len(path) > shared:
                parent.append(stack[-1])
                low.append(shared)
                high.append(len(path))
                owner.append(k)
                stack.append(len(parent) - 1)
            ends_at[k] = stack[-1]
            before = path
        nodes = len(parent)
        parents, lows, self.highs = np.array(parent), np.array(low), np.array(high)
        least, longest = np.full(nodes, 1 << 60), np.zeros(nodes, np.int64)
        np.minimum.at(least, ends_at, size)
        np.maximum.at(longest, ends_at, np.array([len(p) for p in paths]))
        least, longest = least.tolist(), longest.tolist()
        for node in np.argsort(lows, kind="stable")[::-1].tolist():  # children before parents, by their depth in n-grams
            up = parent[node]
            if up >= 0:
                least[up], longest[up] = min(least[up], least[node]), max(longest[up], longest[node])
        self.least, self.longest = np.array(least), np.array(longest)
        self.children = np.argsort(parents, kind="stable")
        self.child_at = np.searchsorted(parents[self.children], np.arange(nodes + 1))
        self.held = np.argsort(ends_at, kind="stable")
        self.held_at = np.searchsorted(ends_at[self.held], np.arange(nodes + 1))
        self.long = self.highs - lows
        self.flat = np.concatenate([paths[owner[x]][lows[x] : self.highs[x]] for x in range(nodes)])
        self.flat_at = np.concatenate([[0], np.cumsum(self.long)])
        self.final = np.array([paths[owner[x]][high[x] - 1] if high[x] else -1 for x in range(nodes)])  # a node's last n-gram
        self.has = np.zeros(len(values) + 1, np.int64)

    def matches(self, path: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps): those with a Jaccard similarity of at least t to a set of that size with that path, itself included."""
        spread = lambda starts, sizes: np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        share, found = self.t / (1 + self.t), ([], [])
        self.has[path] = 1
        frontier, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(frontier):
            n = self.held_at[frontier + 1] - self.held_at[frontier]
            if n.any():  # sets that end here
                j, o = self.held[spread(self.held_at[frontier], n)], np.repeat(overlap, n)
                good = o >= self.t * (size + self.size[j] - o) - 1e-9
                found[0].append(j[good])
                found[1].append(o[good])
            n = self.child_at[frontier + 1] - self.child_at[frontier]
            below = self.children[spread(self.child_at[frontier], n)]
            if not len(below):
                break
            sizes = self.long[below]
            hits = self.has[self.flat[spread(self.flat_at[below], sizes)]]
            overlap = np.repeat(overlap, n) + np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            left = len(path) - np.searchsorted(path, self.final[below], "right")
            most = overlap + np.minimum(left, self.longest[below] - self.highs[below])
            alive = most >= share * (size + self.least[below]) - 1e-9
            frontier, overlap = below[alive], overlap[alive]
        self.has[path] = 0
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)

    def path_of(self, own: np.ndarray) -> np.ndarray:
        """The path of a set that isn't in the trie."""
        at = np.searchsorted(self.values, own)
        at = at[at < len(self.values)]
        return at[self.values[at] == own[: len(at)]]


def trie_join(sets: list[np.ndarray], t: float) -> list[tuple[int, int, int]]:
    """(i, j, overlap), i < j, of the sets (ascending distinct numbers) with a Jaccard similarity of at least t."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    trie, out = Trie(sets, size, t), []
    for i, path in enumerate(trie.paths):
        j, o = trie.matches(path, int(size[i]))
        out.extend((i, b, n) for b, n in zip(j.tolist(), o.tolist(), strict=True) if b > i)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links(a, b) with its component's least node."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other"))
    roots = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        near = both.join(roots.toDF("other", "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = stored(step.join(jump, "new").select("node", "root", F.least("new", "far").alias("new")))
        moved = step.filter("root <> new").limit(1).count()
        roots = step.select("node", F.col("new").alias("root"))
        if not moved:
            discard(both)
            return roots


def _tasks(sets: DataFrame, roots: DataFrame, t: float) -> tuple[DataFrame, bool]:
    """((block, shard, visits, sig), whether any block has several shards): each set in its shard, and in the earlier shards it visits."""
    blocks = roots.groupBy("block").agg((F.count("*") > BLOCK_SETS).alias("large"))
    placed = roots.join(blocks, "block").join(sets.select("sig", "size"), "sig")
    placed = placed.withColumn("step", F.when(F.col("large"), F.floor(F.log("size") / float(np.log(STEP)))).otherwise(0).cast("int"))
    each = placed.groupBy("block", "step").agg(F.count("*").alias("n"))
    placed = placed.join(each, ["block", "step"]).select("block", "step", F.pmod(F.xxhash64("sig"), F.ceil(F.col("n") / BLOCK_SETS)).cast("int").alias("part"), "sig", "large")
    placed = stored(placed.select("block", (F.col("step") * (1 << 24) + F.col("part")).cast("long").alias("shard"), "step", "sig", "large"))
    home = placed.select("block", "shard", F.lit(False).alias("visits"), "sig")
    if not placed.filter("large").limit(1).count():
        return home, False

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                gram = np.frombuffer(batch.column(3)[r].as_py(), np.int64)
                if len(gram):
                    yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(c)[r].as_py()] * len(gram), k) for c, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()))), pa.array(gram)], names=["block", "shard", "sig", "gram"])

    grams_of = placed.filter("large").select("block", "shard", "sig").join(sets.select("sig", "prefix"), "sig").select("block", "shard", "sig", "prefix")
    grams_of = stored(grams_of.mapInArrow(unpacked, "block long, shard long, sig long, gram long"))
    there = grams_of.select("block", F.col("shard").alias("other"), "gram").distinct()
    far = int(np.ceil(np.log(1 / t) / np.log(STEP))) + 1  # steps between sizes that can join
    near = (F.col("other") < F.col("shard")) & (F.shiftright("shard", 24) - F.shiftright("other", 24) <= far)
    visits = grams_of.join(there, ["block", "gram"]).filter(near).select("block", F.col("other").alias("shard"), F.lit(True).alias("visits"), "sig").distinct()
    return home.union(visits), True


def _matched(sets: DataFrame, copies: DataFrame, t: float) -> DataFrame:
    """(sig, class, links): of each set that joins others its class and the number of texts in those others; copies: (sig, copies)."""
    roots = stored(components(_links(sets, t)).toDF("sig", "block"))
    tasks, several = _tasks(sets, roots, t)
    rows = tasks.join(sets.select("sig", "size", "path"), "sig").join(copies.select("sig", "copies"), "sig").select("block", "shard", "visits", "sig", "size", "copies", "path")
    rows = rows.repartition(_parts(sets), "block", "shard").sortWithinPartitions("block", "shard", "visits", "sig")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _tasks_of(batches):
            home = [r for r in own if not r[2]]
            guests = own[len(home) :]
            if len(home) + len(guests) < 2 or not home:
                continue
            read = lambda r: _numbers(r[6], len(r[6]) // 8, np.uint64)
            size, many = np.array([r[4] for r in own], np.int64), np.array([r[5] for r in own], np.int64)
            trie = Trie([read(r) for r in home], size[: len(home)], t, bool(guests))
            links, a, b = np.zeros(len(own), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, path in enumerate(trie.paths):
                j, _ = trie.matches(path, int(size[i]))
                j = j[j != i]
                links[i] += many[j].sum()
                later = j[j > i]
                a.append(np.full(len(later[:1]), i))
                b.append(later[:1])
                a.append(later[:-1])  # a chain connects them as well as a star
                b.append(later[1:])
            for i, r in enumerate(guests, len(home)):
                j, _ = trie.matches(trie.path_of(read(r)), int(size[i]))
                links[i] += many[j].sum()
                links[j] += many[i]
                a.append(np.full(len(j), i))
                b.append(j)
            root = _forest(np.concatenate(a), np.concatenate(b), len(own))
            joined = np.flatnonzero(links)
            sig = np.array([r[3] for r in own], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig[joined]), pa.array(sig[root[joined]]), pa.array(links[joined])], names=["sig", "class", "links"])
        give_back()

    found = stored(rows.mapInArrow(match, "sig long, class long, links long"))
    if not several:
        return found
    classes = components(found.select(F.col("sig").alias("a"), F.col("class").alias("b"))).toDF("sig", "class")
    return stored(found.groupBy("sig").agg(F.sum("links").alias("links")).join(classes, "sig").select("sig", "class", "links"))


def _tasks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each block and shard."""
    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and own[-1][:2] != row[:2]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _classes(docs: DataFrame, rows: DataFrame, n: int, t: float) -> DataFrame:
    """(sig, class_sig, class_id, copies, links) of each set that several texts have or that joins others; rows: as ``_described`` gives them."""
    texts = rows.filter("shared").select("doc_id", "sig", "size").distinct()
    carriers = stored(texts.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("copies")))
    sets = _ordered(docs, carriers, n, t)
    found = _matched(sets, carriers, t)
    discard(sets)
    own = carriers.join(found, "sig", "left").filter("copies > 1 or links is not null")
    own = stored(own.select("sig", F.coalesce("class", "sig").alias("class_sig"), "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links")))
    # the least text of a class: by doc_id, nulls last, then by signature
    least = own.groupBy("class_sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "sig")).alias("least"))
    return stored(own.join(least, "class_sig").select("sig", "class_sig", F.col("least.doc_id").alias("class_id"), F.col("least.sig").alias("least_sig"), "copies", "links"))


def join(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, class_id, n_links) as said above."""
    docs = docs.select("doc_id", "text")
    rows = _described(docs, n, t)
    classes = _classes(docs, rows, n, t).withColumnRenamed("sig", "of")
    texts = rows.filter("shared or size = 0").select("doc_id", "sig", "size").distinct()
    near = texts.join(_joinable(classes), F.col("sig") == F.col("of"), "left")
    near = near.select("doc_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"))
    # a set that shares too little is no other row's
    alone = rows.filter("not shared and size > 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return near.union(alone)


def _signature(texts: Column, n: int) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for _, bounds, own in grams.gram_sets(texts, n):
            out.append(np.where(np.diff(bounds) > 0, _signatures(bounds, own), 0))
        return pa.array(np.concatenate(out))

    return of(texts)


def deduplicate(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; rows whose texts have no n-grams stay."""
    rows = _described(docs.select("doc_id", "text"), n, t)
    classes = _classes(docs.select("doc_id", "text"), rows, n, t)
    shared = rows.filter("shared").select("doc_id", "sig")
    known = shared.join(_joinable(classes.withColumnRenamed("sig", "of")), F.col("sig") == F.col("of"), "left")
    known = stored(known.select("doc_id", F.col("class_sig").isNotNull().alias("near"), ((F.col("least_sig") == F.col("sig")) & (F.col("class_id") == F.col("doc_id"))).alias("first")))
    # most doc_ids have one row, and the id alone decides; the rows of the others are told apart by their texts
    several = stored(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").join(known.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("gone")))
    gone = stored(known.filter("near and not first").select(F.col("doc_id").alias("gone")).filter("gone is not null").union(several).distinct())
    nulls = known.filter("doc_id is null").limit(1).count()
    id_of = docs["doc_id"].cast("long")
    left = docs.join(_joinable(gone), id_of == gone["gone"], "left_anti")
    left = left.filter(docs["doc_id"].isNotNull()) if nulls else left
    if not nulls and not several.limit(1).count():
        return left
    rest = docs.join(_joinable(several), id_of == several["gone"], "left_semi")
    if nulls:
        rest = rest.union(docs.filter(docs["doc_id"].isNull()))
    columns = docs.columns
    rest = rest.select(F.struct(*(rest[f"`{c}`"] for c in columns)).alias("row"), rest["doc_id"].cast("long").alias("id"), _signature(rest["text"], n).alias("own"))
    empty = rest.filter("own = 0")
    rest = rest.filter("own <> 0").groupBy("id", "own").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    rest = rest.join(_joinable(classes), F.col("own") == F.col("sig"), "left").filter((F.col("sig").isNull()) | (F.col("least_sig") == F.col("own")) & F.col("class_id").eqNullSafe(F.col("id")))
    return left.union(rest.select("row").union(empty.select("row")).select("row.*"))


#: The same rows in SQL, by counting shared n-grams and following joins from set to set.
SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
texts AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - {N - 1}) + 1), lambda i: array_to_string(w[i : i + {N - 1}], ' ')))) END AS s FROM words),
sets AS (SELECT s, row_number() OVER () AS k, count(*) AS copies, len(s) AS size, min(doc_id) AS least FROM texts WHERE len(s) > 0 GROUP BY s),
e AS (SELECT k, size, unnest(s) AS gram FROM sets),
near AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k
  HAVING count(*) >= {T} * (any_value(a.size) + any_value(b.size) - count(*)) - 1e-9),
reach AS (SELECT k, k AS other FROM sets UNION SELECT reach.k, near.b FROM reach JOIN near ON near.a = reach.other),
class AS (SELECT reach.k, min(least) AS class_id FROM reach JOIN sets ON sets.k = reach.other GROUP BY reach.k),
links AS (SELECT a AS k, sum(copies) AS n FROM near JOIN sets ON sets.k = near.b GROUP BY a)
SELECT doc_id, CASE WHEN len(texts.s) = 0 THEN doc_id ELSE class_id END AS class_id, CAST(coalesce(links.n, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM texts LEFT JOIN sets ON sets.s = texts.s LEFT JOIN class ON class.k = sets.k LEFT JOIN links ON links.k = sets.k"""
