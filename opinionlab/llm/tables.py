"""Tables that the operators read, and those in the shared folder that cut their lineages."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import discard, shared_dir, stored

__all__ = ["bound_batches", "discard", "documents", "give_back", "shared_dir", "stored"]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once by bytes, as texts differ in length by orders of magnitude; a setting that is there already stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "8m")


def give_back() -> None:
    """Gives a worker's freed memory back to the system: workers are used again, by other operators too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
