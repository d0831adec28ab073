"""Preparing comments for labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text
from ..sources.readers import ORDINAL
from ..sources.tables import stored

SALT = "opinionlab"
#: What removes a row, in order.
STAGES = ["empty", "emoji_only", "low_information", "below_min_info_len", "duplicate"]


def staged(df: DataFrame, text_col: str, ordinal: str = ORDINAL, *, drop_low_info: bool = False, min_info_len: int = 0, keep_emoji_only: bool = False, dedupe: list[str] | None = None) -> DataFrame:
    """df with clean_text, its measures and removed_by (null: kept).

    dedupe: columns (clean_text among them, say) of which only the first row stays.
    """
    t = F.col("clean_text")
    own = df.withColumn("clean_text", text.normalize(F.col(text_col)))
    own = own.withColumns({"info_len": text.info_length(t), "emoji_only_candidate": text.emoji_only(t), "short_attitude_signal": text.attitude(t), "low_information_candidate": text.low_information(t)})
    removed = F.when(t == "", STAGES[0])
    if not keep_emoji_only:
        removed = removed.when(F.col("emoji_only_candidate"), STAGES[1])
    if drop_low_info:
        removed = removed.when(F.col("low_information_candidate") & ~F.col("short_attitude_signal"), STAGES[2])
    if min_info_len:
        removed = removed.when((F.col("info_len") < min_info_len) & ~F.col("short_attitude_signal"), STAGES[3])
    own = own.withColumn("removed_by", removed)
    if dedupe:
        apart = F.when(F.col("removed_by").isNotNull(), F.col(ordinal))
        keys = [text.digest(F.col(c)) if c == "clean_text" else F.col(c) for c in dedupe]
        place = F.row_number().over(Window.partitionBy(apart, *keys).orderBy(ordinal))
        own = own.withColumn("removed_by", F.when(F.col("removed_by").isNull() & (place > 1), STAGES[4]).otherwise(F.col("removed_by")))
    return own


def prepare(df: DataFrame, text_col: str, ordinal: str = ORDINAL, hash_col: str | None = None, salt: str = SALT, **how) -> DataFrame:
    """The kept rows with row_id 0 .. n - 1 in input order, text_hash, duplicate_count and source_hash."""
    kept = scalar.keep(staged(df, text_col, ordinal, **how), F.col("removed_by").isNull()).drop("removed_by")
    # rows are counted and numbered without their texts, which then move once, to meet their numbers
    marks = stored(kept.select(ordinal, text.digest(F.col("clean_text")).alias("_digest")))
    marks = marks.withColumn("duplicate_count", F.count("*").over(Window.partitionBy("_digest"))).drop("_digest")
    kept = kept.withColumns({"text_hash": scalar.hashed(F.col("clean_text"), salt), "source_hash": scalar.hashed(F.col(hash_col), salt) if hash_col else F.lit("")})
    return kept.join(scalar.dense_ids(marks, ordinal, "row_id"), ordinal)


def summary(df: DataFrame, text_col: str, ordinal: str = ORDINAL, min_info_len: int = 0, **how) -> DataFrame:
    """(metric, value) of what each stage removed and what is left, by one aggregation by text and stage."""
    own = staged(df, text_col, ordinal, min_info_len=min_info_len, **how)
    kept = F.col("removed_by").isNull()
    by = own.groupBy("removed_by", "clean_text").agg(F.count("*").alias("n"), F.first("emoji_only_candidate").alias("emoji"), F.first("short_attitude_signal").alias("attitude"), F.first("low_information_candidate").alias("low"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    by_stage = lambda k: n(F.col("removed_by") == STAGES[k])
    metrics = {
        "original_rows": n(F.lit(True)),
        "removed_empty_rows": by_stage(0),
        "removed_emoji_only_rows": by_stage(1),
        "removed_low_information_rows": by_stage(2),
        "removed_below_min_info_len_rows": by_stage(3),
        "removed_duplicate_rows": by_stage(4),
        "kept_rows": n(kept),
        "short_attitude_rows_kept": n(kept & F.col("attitude")),
        "emoji_only_candidate_rows": n(kept & F.col("emoji")),
        "low_information_candidate_rows": n(kept & F.col("low")),
        "unique_clean_texts": F.count_if(kept).cast("long"),
        "duplicate_extra_rows": n(kept) - F.count_if(kept),
        "min_info_len": F.lit(min_info_len).cast("long"),
    }
    one = by.agg(*(v.alias(k) for k, v in metrics.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics))).alias("m")).select("m.*")


def denominator(df: DataFrame, text_col: str) -> DataFrame:
    """Df with in_denominator and exclusion_reason: blank, emoji-only and low-information texts don't count, a short attitude does."""
    t = text.normalize(F.col(text_col))
    reason = F.when(t == "", "blank").when(text.emoji_only(t), "emoji_only").when(text.low_information(t) & ~text.attitude(t), "low_information").otherwise("")
    return df.withColumn("exclusion_reason", reason).withColumn("in_denominator", F.when(F.col("exclusion_reason") == "", "yes").otherwise("no"))
