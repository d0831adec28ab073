"""Scalar rules other than text's (F15-F24, P10) and the keys of reproducible sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd")
YES = tuple(sorted("1 1.0 y yes true include included 有效 是 纳入".split()))
NO = tuple(sorted("0 0.0 n no false exclude excluded 不纳入 否 排除".split()))
NOTHING = ("", "nan", "none", "null")


def parse_time(text: Column) -> Column:
    """a timestamp without zone by the first format that fits, else null."""
    own = F.trim(text.cast("string"))
    return F.coalesce(*(F.try_to_timestamp(own, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def number(x: Column) -> Column:
    """F16: a double, or null."""
    return x.try_cast("double")


def flag(x: Column) -> Column:
    """yes, no, blank or unknown."""
    own = F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))
    return F.when(own.isin(*YES), "yes").when(own.isin(*NO), "no").when(own.isin(*NOTHING), "").otherwise("unknown")


def truthy(x: Column) -> Column:
    """F18."""
    return F.coalesce(F.upper(x.cast("string")).isin("TRUE", "1", "YES"), F.lit(False))


def hashed(x: Column, salt: str) -> Column:
    """P10: the first 16 hexadecimal digits of the salted sha256; blank stays blank."""
    own = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(own == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), own), 256), 1, 16))


def sample_key(seed: int, key: Column) -> Column:
    """What random samples are ordered by: the same rows on any cluster."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), 4)


def split_list(text: str) -> list[str]:
    """F23."""
    return [x.strip() for x in text.split(",") if x.strip()]


def find_column(df: DataFrame, aliases: list[str], explicit: str | None = None) -> str | None:
    """the explicit name, which must exist, or the first alias among the columns' trimmed lower-case names."""
    if explicit:
        if explicit not in df.columns:
            raise ValueError(f"no column {explicit}")
        return explicit
    names = {c.strip().lower(): c for c in df.columns}
    return next((names[a.lower()] for a in aliases if a.lower() in names), None)


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter(condition) for columns that cost much to compute.

    A plain filter would be pushed below the projection that makes the columns,
    with a copy of their expressions for each use; a column that isn't
    deterministic between the two stops that, so they are computed once.
    """
    return df.withColumn("_fence", F.spark_partition_id()).filter(condition & (F.col("_fence") >= 0)).drop("_fence")


def dense_ids(df: DataFrame, ordinal: str, name: str = "row_id") -> DataFrame:
    """0 .. n - 1 in the order of a distinct integer ordinal, without one partition for all rows.

    Rows are numbered within equal ranges of the ordinal; the ranges' starts, as
    many rows as there are shuffle partitions, are joined back.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    slim = stored(df.select(ordinal))  # so that what df is made of runs once for the counts and once for the rows
    low, high = slim.agg(F.min(ordinal), F.max(ordinal)).first()
    width = max(1, -(-(int(high) - int(low) + 1) // parts)) if low is not None else 1
    cut = F.floor((F.col(ordinal) - F.lit(int(low or 0))) / F.lit(width)).cast("long")
    own = df.withColumn("_range", cut)
    starts = slim.withColumn("_range", cut).groupBy("_range").agg(F.count("*").alias("_n")).selectExpr("_range", "sum(_n) OVER (ORDER BY _range) - _n AS _before")
    own = own.join(F.broadcast(starts), "_range")  # at most 4 rows for each shuffle partition
    return own.withColumn(name, F.expr(f"_before + row_number() OVER (PARTITION BY _range ORDER BY `{ordinal}`) - 1").cast("long")).drop("_range", "_before")
