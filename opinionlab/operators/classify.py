"""Character n-gram classifiers.

Grams are counted and looked up in numpy where the texts are; the multinomial
Bayes model has at most max_vocab rows a label, and no document's text meets the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gram_codes, text
from ..sources.tables import stored
from . import rows


def gram_counts(df: DataFrame, key: str, body: str, max_chars: int | None = None) -> DataFrame:
    """(key, gram, c): counted where the text is, so no row for an occurrence and no shuffle."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in gram_codes.pieces(*gram_codes.flat(batch.column(1)), 2):
                for n in (1, 2):
                    row, ids, c = piece.tally(n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + piece.base)), piece.decode(ids, n), pa.array(c)], ["key", "gram", "c"])

    own = _whole(rows.texts_by_key(df, key, text.classifier_text(F.col(body), max_chars)))
    return _outside(own.mapInArrow(part, f"key {own.schema[key].dataType.simpleString()}, gram string, c long")).withColumnRenamed("key", key)


def _whole(own: DataFrame) -> DataFrame:
    """A key's texts as one, so that they are counted together; they hold no white space, so a line end is in none of their grams."""
    return own.withColumn("texts", F.when(F.size("texts") < 2, F.col("texts")).otherwise(F.array(F.array_join("texts", "\n"))))


def _outside(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.contains("gram", F.lit("\n")))


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows with a label that isn't blank, trimmed."""
    return df.withColumn(label, F.trim(F.col(label).cast("string"))).filter(F.coalesce(F.col(label), F.lit("")) != "")


def _training(df: DataFrame, key: str, body: str, label: str, labels: DataFrame | None, max_chars: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, texts) of every key; (label, texts), a row for each label given to a key; (label, n) of these.

    labels: (key, label) where df has no such column.
    """
    texts = rows.texts_by_key(df, key, text.classifier_text(F.col(body), max_chars))
    if labels is None:
        known = labelled(df.select(key, label), label)
        # where keys are distinct, a row's label is beside its text
        training = labelled(df, label).select(F.col(label).alias("label"), F.array(text.classifier_text(F.col(body), max_chars)).alias("texts")) if rows.distinct_keys(df, key) else None
    else:
        known, training = labelled(labels.select(key, label), label).join(df.select(key), key), None
    if training is None:
        training = texts.join(known.withColumnRenamed(label, "label"), key).select("label", "texts")
    return texts, training, known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def label_grams(training: DataFrame, max_vocab: int = 3500) -> DataFrame:
    """(label, gram, n) of (label, texts): each label's commonest grams, ties by gram."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            texts, at = gram_codes.flat(batch.column(1))
            for _, piece in gram_codes.pieces(texts, names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at], 2):
                for k in (1, 2):
                    own, ids, n = piece.tally(k)
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(own + piece.base)), piece.decode(ids, k), pa.array(n)], ["label", "gram", "n"])

    counts = training.select("label", "texts").mapInArrow(part, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("_p", place).filter(F.col("_p") <= max_vocab).drop("_p")


def model_tokens(df: DataFrame, key: str, body: str, label: str, labels: DataFrame | None = None, max_vocab: int = 3500, max_chars: int | None = None) -> DataFrame:
    """The Bayes model (label, gram, n)."""
    return label_grams(_training(df, key, body, label, labels, max_chars)[1], max_vocab)


def _scored(texts: DataFrame, key: str, grams: list[str], score: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """(key, s): a row of score(row, gram's place, number of rows) for each key."""
    known = gram_codes.Vocabulary(grams)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = gram_codes.flat(batch.column(1))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for start, piece in gram_codes.pieces(own, at, 2):
                for n in (1, 2):
                    row, term = piece.find(known, n)
                    found.append((at[start + row], term))
            s = score(*(np.concatenate(x) for x in zip(*found, strict=True)), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.astype(float).ravel()))], ["key", "s"])

    own = texts.select(F.col(key).alias("key"), "texts").mapInArrow(part, f"key {texts.schema[key].dataType.simpleString()}, s array<double>")
    return own.withColumnRenamed("key", key)


def bayes(df: DataFrame, key: str, body: str, label: str, labels: DataFrame | None = None, max_vocab: int = 3500, max_chars: int | None = None, confidence: float = 0.6, margin: float = 0.15) -> DataFrame:
    """M5, M6, M8: (key, predicted_label, predicted_confidence, top2_margin, needs_review, classifier_backend) of every key.

    Prior ln(n_l / N); a gram of the joint vocabulary of V grams counts
    ln((n + 1) / (total_l + V)); ties go to the least label.  labels: see _training.
    """
    texts, training, known = _training(df, key, body, label, labels, max_chars)
    counts: dict[str, dict[str, int]] = {}
    for r in label_grams(training, max_vocab).collect():  # at most max_vocab rows a label
        counts.setdefault(r["label"], {})[r["gram"]] = r["n"]
    given = {r["label"]: r["n"] for r in known.collect()}  # one row a label
    every = sum(given.values())
    classes = [{"label": x, "n_l": given[x]} for x in sorted(counts)]
    grams = sorted({g for own in counts.values() for g in own})
    # what each occurrence of a gram adds to each label's score
    totals = np.array([sum(counts[c["label"]].values()) + len(grams) for c in classes], float)
    weights = np.log((np.array([[counts[c["label"]].get(g, 0) for c in classes] for g in grams], float).reshape(len(grams), len(classes)) + 1) / totals)

    def score(row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(row, weights[term, i], n) for i in range(len(classes))], axis=1)

    sums = _scored(texts, key, grams, score)
    score = lambda i, c: F.struct((-(F.col("s")[i] + math.log(c["n_l"] / every))).alias("minus"), F.lit(c["label"]).alias("label"))
    scored = sums.select(key, F.array_sort(F.array(*(score(i, c) for i, c in enumerate(classes)))).alias("s"))
    return _best(scored, key, confidence, margin, "fast-nb", softmax=True)


def _best(own: DataFrame, key: str, confidence: float, margin: float, backend: str, softmax: bool) -> DataFrame:
    """The best label with its probability and distance from the second, of (key, s), s sorted by minus and label."""
    if softmax:
        weights = F.transform("s", lambda x: F.exp(F.element_at("s", 1)["minus"] - x["minus"]))
        p = own.withColumn("w", weights).withColumn("t", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        top, second = F.element_at("w", 1) / F.col("t"), F.when(F.size("w") > 1, F.element_at("w", 2) / F.col("t")).otherwise(0.0)
    else:
        p = own
        top, second = -F.element_at("s", 1)["minus"], F.when(F.size("s") > 1, -F.element_at("s", 2)["minus"]).otherwise(0.0)
    out = p.select(key, F.element_at("s", 1)["label"].alias("predicted_label"), F.round(top, 4).alias("predicted_confidence"), F.round(top - second, 4).alias("top2_margin"))
    return out.withColumn("needs_review", needs_review(confidence, margin)).withColumn("classifier_backend", F.lit(backend))


def needs_review(confidence: float = 0.6, margin: float = 0.15, score: str = "predicted_confidence", distance: str = "top2_margin"):
    """W13, on rounded values."""
    return (F.col(score) < confidence) | (F.col(distance) < margin)


def regression(df: DataFrame, key: str, body: str, label: str, labels: DataFrame | None = None, max_features: int = 60_000, max_chars: int | None = None, confidence: float = 0.6, margin: float = 0.15, max_iter: int = 1000) -> DataFrame:
    """M7: logistic regression with balanced classes over TF-IDF of character 1- and 2-grams, fitted by Spark's own solver.

    The penalty 1 / n, without standardising, is that of C = 1 for weights that
    sum to n.  labels: see _training.  Only the labelled keys' vectors are
    written; the others' are made where they are scored.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructType

    texts, training, known = _training(df, key, body, label, labels, max_chars)
    training = stored(training)  # read twice, and its join with the labels moves the texts
    given = {r["label"]: r["n"] for r in known.collect()}  # one row a label
    names, n = sorted(given), sum(given.values())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, piece in gram_codes.pieces(*gram_codes.flat(batch.column(0)), 2):
                for k in (1, 2):
                    ids, count = gram_codes.runs(piece.tally(k)[1])
                    yield pa.RecordBatch.from_arrays([piece.decode(ids, k), pa.array(count)], ["gram", "df"])

    counts = _outside(_whole(training).select("texts").mapInArrow(documents, "gram string, df long")).groupBy("gram").agg(F.sum("df").alias("df"))
    vocabulary = counts.orderBy(F.desc("df"), "gram").limit(max_features).collect()  # max_features bounds it
    grams, idf = [r["gram"] for r in vocabulary], np.log((n + 1) / (np.array([r["df"] for r in vocabulary], float) + 1))
    width, place, weight = max(1, len(grams)), {x: i for i, x in enumerate(names)}, [n / (len(names) * given[x]) for x in names]
    found = gram_codes.Vocabulary(grams)

    def weighed(row: np.ndarray, term: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, value) of vectors of length 1."""
        pairs, tf = gram_codes.runs(row * width + term)
        row, term = pairs // width, pairs % width
        x = tf * idf[term]
        norms = np.sqrt(np.bincount(row, x * x, count))[row]
        return row, term, np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = gram_codes.flat(batch.column(1))
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for start, piece in gram_codes.pieces(own, at, 2):
                for k in (1, 2):
                    row, term = piece.find(found, k)
                    parts.append((at[start + row], term))
            row, term, x = weighed(*(np.concatenate(p) for p in zip(*parts, strict=True)), len(batch))
            ends, y = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)), np.array([place[v] for v in batch.column(0).to_pylist()], np.int64)
            features = pa.StructArray.from_arrays([pa.array(np.zeros(len(batch), np.int8)), pa.array(np.full(len(batch), width, np.int32)), pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([features, pa.array(y.astype(float)), pa.array(np.array(weight)[y])], ["features", "y", "weight"])

    # written once, in the form of Spark's vectors: fitting reads it in every iteration
    made = stored(training.select("label", "texts").mapInArrow(vectors, "features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>, y double, weight double"))
    own = df.sparkSession.read.schema(StructType().add("features", VectorUDT()).add("y", DoubleType()).add("weight", DoubleType())).parquet(made.stored_at)
    fitted = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(own)
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()

    def score(row: np.ndarray, term: np.ndarray, count: int) -> np.ndarray:
        row, term, x = weighed(row, term, count)
        m = np.stack([np.bincount(row, x * w[term], count) + b for w, b in zip(matrix, intercepts, strict=True)], axis=1)
        if len(matrix) == 1:
            m = np.concatenate([np.zeros_like(m), m], axis=1)
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    of = lambda i, x: F.struct((-F.col("s")[i]).alias("minus"), F.lit(x).alias("label"))
    scored = _scored(texts, key, grams, score).select(key, F.array_sort(F.array(*(of(i, x) for i, x in enumerate(names)))).alias("s"))
    return _best(scored, key, confidence, margin, "logistic", softmax=False)


def train_and_score(df: DataFrame, key: str, body: str, label: str, backend: str = "auto", labels: DataFrame | None = None, **how) -> DataFrame:
    """M9: backend lr, nb, or auto (lr); at least two labels are needed.  labels: (key, label) where df has no such column."""
    if labelled((df if labels is None else labels).select(label), label).select(label).distinct().limit(2).count() < 2:
        raise ValueError("at least two labels are needed")
    return (bayes if backend in ("nb", "fast-nb") else regression)(df, key, body, label, labels, **how)
