"""Draft topics: TF-IDF of character n-grams and spherical k-means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gram_codes, scalar, text
from . import rows


#: Rows of vectors that are multiplied at once.
_ROWS = 512


def term_counts(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, texts): what vocabulary and vectors count terms in, a row for each key; no row is made for a term of a text."""
    return rows.texts_by_key(df, key, text.topic_text(F.col(body)))


def vocabulary(counts: DataFrame, n: int, size: int = 1200) -> DataFrame:
    """(gram, df, idf) of the size grams in most documents, ties by gram; idf ln((1 + n) / (1 + df)) + 1."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in gram_codes.pieces(*gram_codes.flat(batch.column(0)), 4):
                for k in (2, 3, 4):
                    ids, df = gram_codes.runs(piece.tally(k)[1])
                    yield pa.RecordBatch.from_arrays([piece.decode(ids, k), pa.array(df)], ["gram", "df"])

    # a document whose texts fall into two pieces would count twice
    own = counts.select(F.when(F.size("texts") < 2, F.col("texts")).otherwise(F.array(F.array_join("texts", "\n"))).alias("texts"))
    own = own.mapInArrow(part, "gram string, df long").filter(~F.contains("gram", F.lit("\n")))  # no text holds white space
    own = own.groupBy("gram").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "gram").limit(size)
    return own.withColumn("idf", F.log((1.0 + n) / (1 + F.col("df"))) + 1)


def vectors(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """M1: (key, terms, tf), a row for each key: places in the vocabulary and how often they occur; the vocabulary is metadata of terms."""
    own = sorted(((r["gram"], r["df"], r["idf"]) for r in vocab.collect()), key=lambda r: (-r[1], r[0]))  # vocab has its fixed size
    known = gram_codes.Vocabulary([r[0] for r in own])
    width = max(1, len(own))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = gram_codes.flat(batch.column(1))
            found = [np.zeros(0, np.int64)]
            for start, piece in gram_codes.pieces(texts, at, 4):
                for k in (2, 3, 4):
                    row, term = piece.find(known, k)
                    found.append(at[start + row] * width + term)
            pairs, tf = gram_codes.runs(np.concatenate(found))
            ends = np.searchsorted(pairs, np.arange(len(batch) + 1) * width).astype(np.int32)
            of = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), of(pairs % width), of(tf)], ["key", "terms", "tf"])

    out = counts.select(F.col(key).alias("key"), "texts").mapInArrow(part, f"key {counts.schema[key].dataType.simpleString()}, terms array<int>, tf array<int>")
    return out.select(F.col("key").alias(key), F.col("terms").alias("terms", metadata={"grams": [r[0] for r in own], "idf": [float(r[2]) for r in own]}), "tf")


def grams_of(vecs: DataFrame) -> list[str]:
    """The vocabulary, by its places."""
    return vecs.schema["terms"].metadata["grams"]


def _dense(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows by terms): vectors of length 1; a row without terms is all 0."""
    terms, tf = batch.column("terms"), batch.column("tf")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64))])
    places, counts = terms.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False)
    for start in range(0, len(batch), _ROWS):
        stop = min(start + _ROWS, len(batch))
        own = slice(ends[start], ends[stop])
        out = np.zeros((stop - start, len(idf)))
        out[np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1])), places[own]] = counts[own] * idf[places[own]]
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        yield start, np.divide(out, norms, out=out, where=norms > 0)


def _idf(vecs: DataFrame) -> np.ndarray:
    return np.array(vecs.schema["terms"].metadata["idf"])


def _nearest(dense: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid and cosine, rounded so that the order of summation can't decide a tie."""
    cos = np.round(dense @ means.T, 9)
    best = cos.argmax(axis=1)
    return best, cos[np.arange(len(cos)), best]


def initial(df: DataFrame, vecs: DataFrame, key: str, k: int, seed: int = 42) -> np.ndarray:
    """The directions of the k documents of least sample key, in that order: topics by terms; one without terms has none."""
    keys = [r[0] for r in df.select(key).orderBy(scalar.sample_key(seed, F.col(key)), F.col(key)).limit(k).collect()]
    idf, out = _idf(vecs), np.zeros((len(keys), len(vecs.schema["terms"].metadata["idf"])))
    for r in vecs.filter(F.col(key).isin(keys)).collect():
        w = np.zeros(len(idf))
        w[r["terms"]] = np.array(r["tf"]) * idf[r["terms"]]
        if len(r["terms"]):
            out[[x == r[key] for x in keys]] = w / np.sqrt((w * w).sum())
    return out


def centroids(vecs: DataFrame, means: np.ndarray) -> DataFrame:
    """(topic, gram, w) of topics by terms, without zeros; k times the vocabulary at most."""
    grams = grams_of(vecs)
    return vecs.sparkSession.createDataFrame([(int(t), grams[g], float(means[t, g])) for t, g in zip(*np.nonzero(means), strict=True)], "topic long, gram string, w double")


def assign(vecs: DataFrame, means: np.ndarray, key: str) -> DataFrame:
    """(key, topic, distance): the nearest centroid by cosine, ties to the least topic; without vocabulary topic 0 at distance 1."""
    idf = _idf(vecs)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_nearest(dense, means) for _, dense in _dense(batch, idf)]
            topic, cos = (np.concatenate([np.zeros(0), *(f[i] for f in found)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(topic.astype(np.int64)), pa.array(1 - cos)], ["key", "topic", "distance"])

    kind = vecs.schema[key].dataType.simpleString()
    return vecs.select(F.col(key).alias("key"), "terms", "tf").mapInArrow(part, f"key {kind}, topic long, distance double").withColumnRenamed("key", key)


def _pass(vecs: DataFrame, key: str, means: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """For each set of centroids, by one pass over the vectors: sums of its topics' vectors, topics' sizes, the sum of distances, a digest of who is where.

    As many rows as the cluster has cores go to the driver, of the size of the
    centroids; they are added in a fixed order.
    """
    idf, every = _idf(vecs), np.concatenate(means)
    starts = np.cumsum([0, *(len(m) for m in means)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, sizes = np.zeros_like(every), np.zeros(len(every), np.int64)
        far, digest = np.zeros(len(means)), np.zeros(len(means), np.uint64)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for start, dense in _dense(batch, idf):
                cos, here = np.round(dense @ every.T, 9), np.zeros((len(dense), len(every)))
                row = np.arange(len(dense))
                for i in range(len(means)):
                    best = cos[:, starts[i] : starts[i + 1]].argmax(axis=1)
                    here[row, starts[i] + best] = 1
                    far[i] += (1 - cos[row, starts[i] + best]).sum()
                    x = (keys[start : start + len(dense)] ^ (best.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    digest[i : i + 1] += ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)
                sums += here.T @ dense
                sizes += here.sum(axis=0).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "data": [b"".join(x.tobytes() for x in (sums, sizes, far, digest))]})

    own = vecs.select(F.xxhash64(key).alias("key"), "terms", "tf").coalesce(max(1, vecs.sparkSession.sparkContext.defaultParallelism))
    sums, sizes, far, digest = np.zeros_like(every), np.zeros(len(every), np.int64), np.zeros(len(means)), np.zeros(len(means), np.uint64)
    for r in sorted(own.mapInArrow(part, "part long, data binary").collect()):
        data, at = bytes(r["data"]), 0
        for x in (sums, sizes, far, digest):
            x += np.frombuffer(data, x.dtype, x.size, at).reshape(x.shape)
            at += x.nbytes
    cut = [slice(starts[i], starts[i + 1]) for i in range(len(means))]
    return [(sums[c], sizes[c], float(far[i]), int(digest[i])) for i, c in enumerate(cut)]


def _fit(df: DataFrame, vecs: DataFrame, key: str, ks: list[int], seed: int, iterations: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """k -> (centroids, sizes of its topics, sum of distances): all k in the same passes, each until no document moves."""
    first = initial(df, vecs, key, max(ks), seed)
    means, before, out = {k: first[:k].copy() for k in ks}, dict.fromkeys(ks), {}
    for i in range(iterations):
        for k, (sums, sizes, far, digest) in zip(list(means), _pass(vecs, key, list(means.values())), strict=True):
            if digest == before[k] or i == iterations - 1:
                out[k] = (means.pop(k), sizes, far)
                continue
            before[k] = digest
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            means[k] = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), means[k])  # an empty cluster keeps its centroid
        if not means:
            break
    return out


def kmeans(df: DataFrame, vecs: DataFrame, key: str, k: int, save: Callable[[DataFrame], DataFrame], seed: int = 42, iterations: int = 30) -> DataFrame:
    """M2: (key, topic, distance).  save writes a table and reads it again."""
    return save(assign(vecs, _fit(df, vecs, key, [k], seed, iterations)[k][0], key))


def choose_k(df: DataFrame, vecs: DataFrame, key: str, save: Callable[[DataFrame], DataFrame], seed: int = 42, ks: tuple[int, ...] = tuple(range(3, 10)), iterations: int = 30) -> tuple[int, DataFrame, list[tuple[int, float]]]:
    """M3: (k, its assignment, the scores): least inertia * (1 + 0.03 * greatest / least cluster); with under 30 documents min(3, n)."""
    n = df.count()
    if n < 30:
        k = max(1, min(3, n))
        return k, kmeans(df, vecs, key, k, save, seed, iterations), []
    fitted = _fit(df, vecs, key, list(ks), seed, iterations)
    scores = [(k, far * (1 + 0.03 * sizes.max() / max(1, sizes[sizes > 0].min()))) for k, (_, sizes, far) in sorted(fitted.items())]
    best = min(scores, key=lambda x: (x[1], x[0]))[0]
    return best, save(assign(vecs, fitted[best][0], key)), [(k, float(s)) for k, s in scores]


def summary(df: DataFrame, vecs: DataFrame, assigned: DataFrame, key: str, body: str, terms: int = 12, examples: int = 3) -> DataFrame:
    """(topic, count, share, top_terms, examples)."""
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("count"))
    sizes = sizes.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))), 4))
    joined = lambda d, place, value, k: d.withColumn("_p", place).filter(F.col("_p") <= k).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(value).alias("v")))), lambda x: x["v"]).alias("_l"))
    weights = _weights(vecs, assigned, key)
    top = joined(weights, F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("w"), "gram")), "gram", terms)
    near = joined(nearest(assigned, key, examples).join(df.select(key, text.squash(F.col(body)).alias("body")), key), F.col("place"), "body", examples)
    return sizes.join(top.withColumn("top_terms", F.array_join("_l", "、")).drop("_l"), "topic", "left").join(near.withColumn("examples", F.array_join("_l", " | ")).drop("_l"), "topic", "left")


def _weights(vecs: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """(topic, gram, w): the sum of each term's weights in each topic."""
    idf, grams = _idf(vecs), grams_of(vecs)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            topics = batch.column("topic").to_numpy(zero_copy_only=False)
            for start, dense in _dense(batch, idf):
                own = topics[start : start + len(dense)]
                for t in np.unique(own):
                    sums[int(t)] = sums.get(int(t), 0) + dense[own == t].sum(axis=0)
        for t, w in sums.items():
            places = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), t)), pa.array([grams[i] for i in places], pa.string()), pa.array(w[places])], ["topic", "gram", "w"])

    own = vecs.join(assigned.select(key, "topic"), key).select("topic", "terms", "tf").mapInArrow(part, "topic long, gram string, w double")
    return own.groupBy("topic", "gram").agg(F.round(F.sum("w"), 6).alias("w"))


def nearest(assigned: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(topic, place, key) of each topic's nearest documents."""
    # the filter is on the rank itself, so that each task gives no more than k rows of a topic
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.round("distance", 9), key))
    return assigned.withColumn("place", place).filter(F.col("place") <= k).select("topic", F.col("place").cast("long").alias("place"), key)


def embedding_clusters(df: DataFrame, key: str, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    """(key, cluster) by Spark's k-means; rows without a vector, or with a zero one, are in cluster -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    full = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    vecs = own.filter(full).select(key, array_to_vector("v").alias("features"))
    fitted = KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(vecs)
    return fitted.transform(vecs).select(key, F.col("prediction").cast("long").alias("cluster")).union(own.filter(~full).select(key, F.lit(-1).cast("long")))
