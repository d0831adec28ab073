"""Streams: preparation and masking are row-local, so they run as they are; counts by day need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import prepare


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def prepared(stream: DataFrame, text_col: str, ordinal: str, **how) -> DataFrame:
    """W6 without deduplication: clean_text, its measures and removed_by."""
    if how.get("dedupe"):
        raise ValueError("a stream has no first row of equals")
    return prepare.staged(stream, text_col, ordinal, **how)


def masked(stream: DataFrame, text_col: str) -> DataFrame:
    """P9."""
    return stream.withColumn(text_col, text.mask(F.col(text_col)))


def daily_counts(stream: DataFrame, ts: str, late: str = "2 days", by: list[str] | None = None) -> DataFrame:
    """A16 over a stream: (day, n) and by, each day once no row of it can come any more."""
    own = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return own.groupBy(F.window("_ts", "1 day").alias("_w"), *(by or [])).agg(F.count("*").alias("n")).select(F.to_date("_w.start").alias("day"), *(by or []), "n")
