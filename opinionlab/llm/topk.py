"""Operator 5, exact top-k search by norm-bucketed retrieval.

For every vector whose id is divisible by ``every``, the k others of largest
inner product among all vectors.  Vectors are grouped by length into buckets, the longest first, and each bucket is sorted by length and
holds its unit vectors with each coordinate's order.  Queries go in blocks.  A
first search, in the bucket of the longest vectors, gives each query a lower
bound theta of its k-th product.  A block then meets the buckets whose longest
vector reaches the least theta / |q| of its queries; the join leaves out the
others.  In a bucket the local cosine threshold theta / (|q| * longest) prunes the bucket where it is above 1,
and else chooses the way to candidates, per query:

* coordinate pruning, where the threshold is high: a unit vector whose cosine
  with the query is at least c has, in the query's largest coordinate u, a value
  in c u +- sqrt((1 - c^2)(1 - u^2)); the coordinate's order gives that range;
* length pruning otherwise: the bucket's vectors down to length theta / |q|.

Candidates are verified by their products, summed the same way wherever they
occur, and theta rises as they are found.  Products are rounded to 6 digits and
ties go to the least id, so results don't depend on partitions; pruning keeps a
margin of 2e-6 for that.

Queries are rows of the same table; each pair of a block and a bucket is a row
of packed arrays, paired by Spark without a collect, and a bucket is prepared
once for the blocks that come to it in a task.

Defined results: vectors that are null, empty, of another dimension than the
table's commonest (the least such on ties), or hold a null, infinity or NaN are
neither queries nor results, nor are those with a null id; zero vectors take
part with product 0; of rows that repeat an id, the one of the greatest vector
in array order stands for all; a query with fewer than k others has fewer rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stored

K, EVERY, BUCKET, BLOCK, MARGIN = 10, 50, 4096, 2048, 2e-6
_PACK = "longest double, number long, ids binary, vectors binary"


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, norm) of the vectors that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter("vec_id is not null and embedding is not null and size(embedding) > 0").filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = own.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    most = own.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    own = own.join(F.broadcast(most), F.size("embedding") == F.col("d")).drop("d")  # one row
    return own.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))


def _packed(own: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """Rows of packed ids and vectors, numbered by length, the longest first."""
    # global ranks without one partition: range partitions are sorted, then numbered by their starts
    parts = parts or max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = own.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            ids, rows = np.concatenate([ids, batch.column(0).to_numpy()]), v if rows is None else np.concatenate([rows, v])
            while len(ids) >= size:
                yield give(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield give(ids, rows)

    def give(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((rows * rows).sum(1)).max())]), pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())], names=["longest", "number", "ids", "vectors"])

    return ranged.select("vec_id", "embedding").mapInArrow(pack, _PACK)


class Bucket:
    """Vectors sorted by length, their unit vectors and the order of each coordinate."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norm = np.sqrt((vectors * vectors).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.vectors, self.norm = ids[order], vectors[order], norm[order]
        self.unit = self.vectors / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.orders:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.orders[f] = order, self.unit[order, f]
        return self.orders[f]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(query_ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, bucket: Bucket, k: int, high: float = 0.9) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, products) of what the bucket has of products >= theta: at most k for each query."""
    norms = np.sqrt((queries * queries).sum(1))
    longest = bucket.norm[0]
    reach = norms * longest
    alive = np.flatnonzero(reach + MARGIN >= theta)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, (theta - MARGIN) / np.where(reach > 0, reach, 1), -1.0)
    steep = alive[(local[alive] > high) & (local[alive] <= 1 + 1e-9)]
    for q in steep.tolist():
        unit = queries[q] / norms[q]
        f = int(np.abs(unit).argmax())
        c, u = min(1.0, local[q]), unit[f]
        width = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - u * u)) + 1e-7
        # the range for every cosine from c to 1: its ends are at c, or at 1 where the bound turns over
        low, top = (-1.0 if -u >= c else c * u - width), (1.0 if u >= c else c * u + width)
        order, values = bucket.coordinate(f)
        own = np.sort(order[np.searchsorted(values, low - 1e-9, "left") : np.searchsorted(values, top + 1e-9, "right")])
        if len(own):
            yield from _verified(q, query_ids[q], queries[q], bucket.ids[own], bucket.vectors[own], theta[q], k)
    rest = np.setdiff1d(alive, steep, assume_unique=True)
    for at in range(0, len(rest), 256):
        part = rest[at : at + 256]
        # length pruning: down to the shortest that any query of the part needs
        least = ((theta[part] - MARGIN) / np.where(norms[part] > 0, norms[part], 1)).min()
        down = int(np.searchsorted(-bucket.norm, -least, "right")) if least > 0 else len(bucket.norm)
        if not down:
            continue
        rough = queries[part] @ bucket.vectors[:down].T
        kth = np.partition(rough, -(k + 1), 1)[:, -(k + 1)] if down > k + 1 else np.full(len(part), -np.inf)
        bound = np.maximum(kth, theta[part]) - MARGIN
        for i, q in enumerate(part.tolist()):
            own = np.flatnonzero(rough[i] >= bound[i])
            if len(own):
                yield from _verified(q, query_ids[q], queries[q], bucket.ids[own], bucket.vectors[own], theta[q], k)


def _verified(q: int, own_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, theta: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    products = np.zeros(len(ids))
    for f in range(len(query)):  # one order of summation, whatever else is in the batch
        products += vectors[:, f] * query[f]
    products = np.round(products, 6) + 0.0
    good = (ids != own_id) & (products >= theta - MARGIN)
    if good.any():
        yield q, *_best(ids[good], products[good], k)


def unpack(ids: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(packed, np.float64).reshape(len(own), -1)


def pairs(vectors: DataFrame, k: int, every: int, bucket: int, block: int) -> DataFrame:
    """(bucket, bucket_ids, bucket_vectors, query_ids, queries, theta): each bucket with each block of queries that may find something in it."""
    own = stored(clean(vectors))
    buckets, blocks = stored(_packed(own, bucket)), _packed(own.filter(F.col("vec_id") % every == 0), block)
    # one row of ``bucket`` vectors
    first = own.orderBy(F.desc("norm"), "vec_id").limit(bucket)
    first = _packed(first, bucket, 1).agg(F.first("ids").alias("first_ids"), F.first("vectors").alias("first_vectors"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = None
        for batch in batches:
            for number, ids, packed, first_ids, first_vectors in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                longest = longest or Bucket(*unpack(first_ids, first_vectors))
                query_ids, queries = unpack(ids, packed)
                theta = np.full(len(query_ids), -np.inf)
                for q, _, products in search(query_ids, queries, theta, longest, k):
                    if len(products) >= k:
                        theta[q] = products[k - 1]
                norms = np.sqrt((queries * queries).sum(1))
                # a product reaches theta only with a vector of at least that length; a zero query's products are 0 whatever the length
                need = np.where(norms > 0, (theta - MARGIN) / np.where(norms > 0, norms, 1), np.where(theta <= MARGIN, -np.inf, np.inf)).min()
                yield pa.RecordBatch.from_arrays([pa.array([float(need)]), pa.array([ids], pa.binary()), pa.array([packed], pa.binary()), pa.array([theta.tobytes()], pa.binary())], names=["need", "query_ids", "queries", "theta"])

    bounded = stored(blocks.select("number", "ids", "vectors").crossJoin(F.broadcast(first)).mapInArrow(bounds, "need double, query_ids binary, queries binary, theta binary"))
    return buckets.join(bounded, F.col("longest") >= F.col("need") - 1e-9).select(F.col("number").alias("bucket"), F.col("ids").alias("bucket_ids"), F.col("vectors").alias("bucket_vectors"), "query_ids", "queries", "theta")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(vec_id, rank, neighbour_id, product) of every vector whose id is divisible by ``every``, rank from 1."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ready = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                if ready is None or batch.column(0)[r].as_py() != number:
                    number, ready = batch.column(0)[r].as_py(), Bucket(*unpack(batch.column(1)[r].as_py(), batch.column(2)[r].as_py()))
                ids, packed, theta = (batch.column(c)[r].as_py() for c in (3, 4, 5))
                query_ids, queries = unpack(ids, packed)
                found = list(search(query_ids, queries, np.frombuffer(theta, np.float64), ready, k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(query_ids[[q for q, _, _ in found]], [len(i) for _, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([p for _, _, p in found]))],
                        names=["vec_id", "neighbour_id", "product"],
                    )

    hits = pairs(vectors, k, every, bucket, block).mapInArrow(apply, "vec_id long, neighbour_id long, product double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("product"), "neighbour_id")).cast("long")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "product")


#: The same rows in SQL.
SQL = f"""
WITH v AS (SELECT vec_id, max(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.e, b.e), 6) + 0.0 AS product FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT vec_id, rank, neighbour_id, product FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY product DESC, neighbour_id) AS rank FROM p) WHERE rank <= {K}"""
