"""Reproducible samples and batches.

Random order is the order of md5(seed | id), so a sample is the same on any
cluster and can be taken from SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text
from ..sources.readers import Keywords
from . import rows

def seed_size(n: int) -> tuple[int, int]:
    """(least, most) rows of a first labelling sample of a table of n rows."""
    return (100, 200) if n < 10_000 else (200, 400) if n <= 100_000 else (300, 500)


def _order(seed: int, key: str) -> list[Column]:
    return [scalar.sample_key(seed, F.col(key)), F.col(key)]


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """L2."""
    return df.orderBy(*_order(seed, key)).limit(n)


def per_class(df: DataFrame, by: list[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """L3: up to n of each class, null being one."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(seed, key)))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def stratified(df: DataFrame, strata: list[str], n: int, key: str, least: int = 5, most: int = 80, seed: int = 42) -> DataFrame:
    """L4: of each stratum up to min(least, most) rows; if these are over n, n of them; else filled to n from the rest at random."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*_order(seed, key)))
    own = df.withColumn("_late", F.when(place <= min(least, most), 0).otherwise(1))
    return own.orderBy("_late", *_order(seed, key)).limit(n).drop("_late")


def batches(df: DataFrame, row_id: str, body: str, size: int = 100) -> DataFrame:
    """(batch_id, n, prompt_payload): rows in the order of row_id by the hundred, one line each."""
    own = scalar.dense_ids(df.select(row_id, body), row_id, "_at")
    line = F.concat(F.col(row_id).cast("string"), F.lit("\t"), text.plain(F.col(body)))
    own = own.select((F.floor(F.col("_at") / size) + 1).cast("long").alias("batch_id"), F.struct("_at", line.alias("line")).alias("x"))
    return own.groupBy("batch_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("prompt_payload"))


def lowest(df: DataFrame, column: str, k: int, key: str) -> DataFrame:
    """The k rows of least value, nulls first."""
    return df.orderBy(F.col(column).asc_nulls_first(), key).limit(k)


def uncertain(
    df: DataFrame, row_id: str, label: str, confidence: str, margin: str, review_text: str | None = None, sarcasm: str | None = None, weak: str | None = None, *, n: int = 1000, uncertain_label: str = "uncertain", low_confidence: int = 400, low_margin: int = 400, random_per_class: int = 50, weak_per_class: int = 80, disagreement: int = 300,
) -> DataFrame:
    """df's rows to review next, with part (the first reason), up to n, one for each text.

    Reasons in order: labelled uncertain, least confidence, least margin,
    sarcasm, random by class, random by weak label, weak label against label.
    A row is (part, rank) by its first reason; of equal texts the first stays.
    """
    own = df.withColumn("_id", F.col(row_id))
    ranked = lambda d, *o: d.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*o)))
    slim = own.select("_id", F.col(label).alias("_label"), F.col(confidence).alias("_conf"), F.col(margin).alias("_margin"), *([F.col(weak).alias("_weak")] if weak else []), *([scalar.truthy(F.col(sarcasm)).alias("_sarcasm")] if sarcasm else []))
    parts: list[tuple[int, str, DataFrame]] = [(0, "uncertain_label", slim.filter(F.col("_label") == uncertain_label).withColumn("_rank", F.col("_id")))]
    parts.append((1, "low_confidence", ranked(lowest(slim, "_conf", low_confidence, "_id"), F.col("_conf").asc_nulls_first(), F.col("_id"))))
    parts.append((2, "low_margin", ranked(lowest(slim, "_margin", low_margin, "_id"), F.col("_margin").asc_nulls_first(), F.col("_id"))))
    if sarcasm:
        parts.append((3, "sarcasm", slim.filter("_sarcasm").withColumn("_rank", F.col("_id"))))
    parts.append((4, "random_per_class", per_class(slim, ["_label"], random_per_class, "_id", 42).withColumn("_rank", F.col("_id"))))
    if weak:
        named = slim.filter(F.trim(text.plain(F.col("_weak").cast("string"))) != "")
        parts.append((5, "weak_per_class", per_class(named, ["_weak"], weak_per_class, "_id", 43).withColumn("_rank", F.col("_id"))))
        against = named.filter(F.col("_label").isNotNull() & (F.col("_weak").cast("string") != F.col("_label").cast("string")))
        parts.append((6, "disagreement", random_sample(against, disagreement, "_id", 44).withColumn("_rank", F.col("_id"))))
    every = None
    for k, name, d in parts:
        one = d.select("_id", F.lit(k).alias("_part"), F.lit(name).alias("part"), F.col("_rank").cast("long").alias("_rank"))
        every = one if every is None else every.union(one)
    first = every.groupBy("_id").agg(F.min(F.struct("_part", "_rank", "part")).alias("x")).select("_id", "x.*")
    chosen = own.join(first, "_id")
    if review_text:
        key = F.trim(text.plain(F.col(review_text)))
        chosen = chosen.withColumn("_same", F.row_number().over(Window.partitionBy(key).orderBy("_part", "_rank", "_id"))).filter("_same = 1").drop("_same")
    return chosen.orderBy("_part", "_rank", "_id").limit(n).drop("_id", "_part", "_rank")


def targeted(df: DataFrame, row_id: str, body: str, keywords: dict[str, Keywords], targets: list[str], weak: str | None = None, per_label: int = 100, min_chars: int = 0, max_chars: int = 0, seed: int = 42) -> DataFrame:
    """df's candidates for each target label, by weak label or keyword, up to per_label of each, with target_label_candidate and target_keyword_hits."""
    own = df.filter(rows.length_between(F.col(body), min_chars, max_chars))
    entries = []
    for label in targets:
        words = keywords.get(label, Keywords())
        hits = rows.keyword_hits(F.col(body), words.words, "|", 8) if words.words else F.lit("")
        by_word = (hits != "") & rows.length_between(F.col(body), words.min_chars, words.max_chars)
        by_weak = F.coalesce(F.col(weak).cast("string") == label, F.lit(False)) if weak else F.lit(False)
        # a weak-labelled row comes first and has no hits to show
        entries.append(F.when(by_weak | by_word, F.struct(F.lit(label).alias("target_label_candidate"), F.when(~by_weak, hits).alias("target_keyword_hits"))))
    own = own.withColumn("_target", F.explode(F.array_compact(F.array(*entries)))).select(*df.columns, "_target.*")
    return per_class(own, ["target_label_candidate"], per_label, row_id, seed)
