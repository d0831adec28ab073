"""Tables in the shared folder: what cuts a lineage is written where every executor can read it again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local session that names none (tests) gets a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="opinionlab-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return shared_dir.own


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that isn't taken; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/opinionlab-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder; reading it survives the loss of executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that ``stored`` gave; no later use of it, nor of what was derived from it, is possible."""
    _remove(df.sparkSession, df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
