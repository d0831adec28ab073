"""Reviewed labels: merging, checking, propagating."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text
from . import rows


def string_key(x: Column) -> Column:
    """Ids are compared as trimmed strings."""
    return F.trim(x.cast("string"))


def canonical(df: DataFrame, label: str, aliases: DataFrame | None) -> DataFrame:
    """Label trimmed and replaced by its canonical form where aliases(alias, canonical_label) has one."""
    df = df.withColumn(label, F.trim(F.col(label).cast("string")))
    if aliases is None:
        return df
    # a label map is written by hand; the optimiser broadcasts it by its size
    own = aliases.select(F.trim("alias").alias("_alias"), F.col("canonical_label").alias("_to")).dropDuplicates(["_alias"])
    return df.join(own, df[label] == own["_alias"], "left").withColumn(label, F.coalesce("_to", label)).drop("_alias", "_to")


@dataclass
class Merged:
    """A merge's tables; ``merged`` has the prepared rows with their labels."""

    merged: DataFrame
    invalid: DataFrame
    duplicates: DataFrame
    missing: DataFrame
    summary: DataFrame


def merge(prepared: DataFrame, labels: DataFrame, valid: list[str], ordinal: str, aliases: DataFrame | None = None, policy: str = "last", source: str = "ai_reviewed", row_id: str = "row_id") -> Merged:
    """labels(row_id, label[, confidence, reason, is_sarcasm]) onto prepared by row_id.

    Labels outside ``valid`` are reported and left out; of repeated ids the
    first or last in the order of labels' ordinal stays, or, by policy
    "error", there is an error.
    """
    own = canonical(labels, "label", aliases).withColumn(row_id, string_key(F.col(row_id)))
    for name, kind in (("confidence", "double"), ("reason", "string"), ("is_sarcasm", "string")):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    own = own.withColumn("confidence", scalar.number(F.col("confidence")))
    if "label_source" not in own.columns:
        own = own.withColumn("label_source", F.lit(source))
    good = F.col("label").isin(valid)
    invalid = own.filter(~F.coalesce(good, F.lit(False)))
    own = own.filter(good)
    duplicates = rows.members_of_groups(own, [row_id])
    if policy == "error" and duplicates.take(1):
        raise ValueError("labels repeat a row_id")
    one = rows.keep_first(own, [row_id], ordinal, last=policy == "last").select(F.col(row_id).alias("_key"), "label", "confidence", "reason", "is_sarcasm", "label_source")
    clash = {c: f"{c}_label" for c in one.columns if c in prepared.columns}
    one = one.withColumnsRenamed(clash)
    base = prepared.withColumn("_own", string_key(F.col(row_id)))
    merged = base.join(one, base["_own"] == one["_key"], "left").drop("_own", "_key")
    missing = base.select(F.col("_own").alias(row_id)).join(one.select(F.col("_key").alias(row_id)), row_id, "left_anti").distinct()
    return Merged(merged, invalid, duplicates, missing, quality_summary(prepared, own, invalid, duplicates, one, missing, clash.get("confidence", "confidence"), row_id))


def quality_summary(prepared: DataFrame, valid: DataFrame, invalid: DataFrame, duplicates: DataFrame, used: DataFrame, missing: DataFrame, confidence: str, row_id: str) -> DataFrame:
    """(metric, value)."""
    parts = [
        prepared.agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("prepared_rows")),
        valid.agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("valid_label_rows")),
        invalid.agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("invalid_label_rows")),
        duplicates.agg(F.count_distinct(row_id).cast("double").alias("value")).withColumn("metric", F.lit("duplicate_row_ids")),
        missing.agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("missing_row_ids")),
        used.agg(F.round(F.avg(confidence), 4).alias("value")).withColumn("metric", F.lit("mean_confidence")),
    ]
    return rows.union_ragged([p.select("metric", "value") for p in parts])


def propagate(prepared: DataFrame, reviewed: DataFrame, key: str, ordinal: str, label: str = "label", confidence: str | None = "confidence") -> DataFrame:
    """prepared's rows with the label of the first reviewed row of the same key, and label_source."""
    own = reviewed.withColumn("_key", string_key(F.col(key))).filter((F.col("_key") != "") & (F.trim(text.plain(F.col(label).cast("string"))) != ""))
    columns = [label] + ([confidence] if confidence and confidence in reviewed.columns else [])
    one = rows.keep_first(own, ["_key"], ordinal).select("_key", *(F.col(c).alias(f"{c}_reviewed" if c in prepared.columns else c) for c in columns))
    name = f"{label}_reviewed" if label in prepared.columns else label
    base = prepared.withColumn("_own", string_key(F.col(key)))
    return base.join(one, base["_own"] == one["_key"], "left").drop("_own", "_key").withColumn("label_source", F.when(F.col(name).isNotNull(), "reviewed_expression_mapped"))


def duplicate_keys(reviewed: DataFrame, key: str) -> DataFrame:
    """The reviewed rows whose key occurs again."""
    return rows.members_of_groups(reviewed.withColumn("_key", string_key(F.col(key))).filter("_key <> ''"), ["_key"]).drop("_key")


def final_label(df: DataFrame, human: str | None, ai: str | None, model: str | None) -> DataFrame:
    """Df with final_label and label_source: a human's over an AI's over the classifier's."""
    given = [(c, n) for c, n in ((human, "human"), (ai, "ai_reviewed"), (model, "classifier")) if c]
    own = [(F.when(F.trim(text.plain(F.col(c).cast("string"))) != "", F.trim(F.col(c).cast("string"))), n) for c, n in given]
    source = F.coalesce(*(F.when(x.isNotNull(), n) for x, n in own))
    return df.withColumns({"final_label": F.coalesce(*(x for x, _ in own)), "label_source": source})


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left's rows whose key right lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def first_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).filter("_p = 1").drop("_p")
