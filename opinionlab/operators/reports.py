"""Distributions, crosstabs, trends and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import scalar, text
from . import rows, sampling


def whole() -> WindowSpec:
    """All rows, for those of a finished aggregate only."""
    return Window.partitionBy(F.lit(0))


def label_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels)), "place int, label string")


def named(df: DataFrame, label: str) -> DataFrame:
    """(label): null is blank."""
    return df.select(text.plain(F.col(label).cast("string")).alias("label"))


def distribution(df: DataFrame, label: str, targets: list[str] | None = None) -> DataFrame:
    """A1: (label, count, share) over all rows; targets that don't occur have count 0."""
    counts = named(df, label).groupBy("label").agg(F.count("*").alias("count"))
    if targets:
        counts = counts.join(label_table(df.sparkSession, targets).select("label"), "label", "full_outer").select("label", F.coalesce("count", F.lit(0)).alias("count"))
    return counts.withColumn("share", scalar.share(F.col("count"), F.sum("count").over(whole())))


def effective_distribution(df: DataFrame, label: str, targets: list[str]) -> DataFrame:
    """A2, V3: targets only, shares within them."""
    counts = df.filter(F.col(label).isin(targets)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    counts = label_table(df.sparkSession, targets).select("label").join(counts, "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("count"))
    return counts.withColumn("share", scalar.share(F.col("count"), F.sum("count").over(whole())))


def coverage(df: DataFrame, label: str, targets: list[str], least: int = 20, most_share: float = 0.8) -> DataFrame:
    """(label, count, share, status, note) of targets, and of all other labels together, where there are any."""
    spark = df.sparkSession
    own = df.select(F.coalesce(F.trim(F.col(label).cast("string")), F.lit("nan")).alias("label"))
    unknown = "__unknown_or_non_target__"
    counts = own.select(F.when(F.col("label").isin(targets), F.col("label")).otherwise(unknown).alias("label")).groupBy("label").agg(F.count("*").alias("count"))
    aims = label_table(spark, targets).select("label").join(counts, "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("count"))
    aims = aims.withColumn("share", scalar.share(F.col("count"), F.sum("count").over(whole())))
    over = (F.col("share") > most_share) & F.lit(len(targets) > 1)
    status = F.when(over, "audit_required").when(F.col("count") < least, "needs_targeted_sampling").otherwise("ok")
    note = F.when(over, F.lit(f"share over {most_share:.0%}")).when(F.col("count") < least, F.lit(f"under {least} rows")).otherwise("")
    rest = counts.filter(F.col("label") == unknown).select("label", "count", F.lit(None).cast("double").alias("share"), F.lit("review_labels").alias("status"), F.lit("not among the targets").alias("note"))
    return aims.withColumns({"status": status, "note": note}).unionByName(rest)


def reviewed_coverage(df: DataFrame, label: str, targets: list[str], least: int = 20) -> DataFrame:
    """A4: (label, reviewed_count, min_required, status)."""
    own = distribution(df, label, targets)
    aim = F.col("label").isin(targets)
    return own.select("label", F.col("count").alias("reviewed_count"), F.when(aim, F.lit(least)).cast("long").alias("min_required"), F.when(~aim, "extra_label").when(F.col("count") >= least, "ok").otherwise("insufficient").alias("status"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """A5, long: (row_label, col_label, n)."""
    return df.groupBy(F.col(row).cast("string").alias("row_label"), F.col(column).cast("string").alias("col_label")).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, row: str, column: str, values: list[str] | None = None) -> DataFrame:
    """A5, wide: a column for each value of column, zero-filled."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def row_shares(tab: DataFrame) -> DataFrame:
    """A long crosstab with each row's shares, pairs that don't occur being 0."""
    every = tab.select("row_label").distinct().crossJoin(tab.select("col_label").distinct())
    full = every.join(tab, ["row_label", "col_label"], "left").select("row_label", "col_label", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", scalar.share(F.col("n"), F.sum("n").over(Window.partitionBy("row_label"))))


def monthly(df: DataFrame, date: str, label: str, targets: list[str]) -> DataFrame:
    """V4: (month, label, n, share) of targets; rows without a date are left out."""
    own = df.filter(F.col(label).isin(targets)).select(scalar.month(scalar.parse_time(F.col(date))).alias("m"), F.col(label).alias("l")).filter("m is not null")
    return row_shares(crosstab(own, "m", "l")).withColumnsRenamed({"row_label": "month", "col_label": "label"})


def monthly_or_note(df: DataFrame, date: str | None, label: str, targets: list[str]) -> DataFrame:
    """V6: monthly(), or a row (note) where there is no usable date."""
    if date in df.columns and df.filter(scalar.parse_time(F.col(date)).isNotNull()).limit(1).count():
        return monthly(df, date, label, targets)
    return df.sparkSession.createDataFrame([("no usable date column",)], "note string")


def risk_by_month(months: DataFrame, risky: list[str]) -> DataFrame:
    """(month, risk_share)."""
    whole = F.sum("n")
    return months.groupBy("month").agg(scalar.share(F.sum(F.when(F.col("label").isin(risky), F.col("n")).otherwise(0)), whole).alias("risk_share"))


def risk(effective: DataFrame, risky: list[str]) -> DataFrame:
    """One row (risk_share)."""
    return effective.agg(scalar.share(F.coalesce(F.sum(F.when(F.col("label").isin(risky), F.col("count"))), F.lit(0)), F.sum("count")).alias("risk_share"))


def transitions(now: DataFrame, before: DataFrame, row_id: str, label: str, before_label: str | None = None) -> DataFrame:
    """(previous_label, current_label, n, rate) of rows in both; rate within the previous label."""
    a = before.select(F.col(row_id).alias("_k"), F.col(before_label or label).alias("previous_label"))
    b = now.select(F.col(row_id).alias("_k"), F.col(label).alias("current_label"))
    tab = a.join(b, "_k").groupBy("previous_label", "current_label").agg(F.count("*").alias("n"))
    return tab.withColumn("rate", scalar.share(F.col("n"), F.sum("n").over(Window.partitionBy("previous_label"))))


def top_label(df: DataFrame, label: str) -> DataFrame:
    """One row (label, count, share), the commonest, ties by label."""
    return distribution(df, label).orderBy(F.desc("count"), "label").limit(1)


def duplicate_metrics(df: DataFrame, key: Column) -> DataFrame:
    """One row (row_count, duplicate_extra_rows, duplicate_share)."""
    texts = df.select(F.trim(text.plain(key.cast("string"))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    out = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("u"))
    return out.select("row_count", (F.col("row_count") - F.col("u")).alias("duplicate_extra_rows"), scalar.share(F.col("row_count") - F.col("u"), F.col("row_count")).alias("duplicate_share"))


def low(column: str, threshold: float, nulls: bool = True) -> Column:
    """Under the threshold, or null where nulls count."""
    x = scalar.number(F.col(column))
    return F.coalesce(x < threshold, F.lit(nulls))


def confidence_summary(df: DataFrame, confidence: str, margin: str) -> DataFrame:
    """A10: (metric, value); nulls are left out of means and medians and count as not low."""
    c, m = scalar.number(F.col(confidence)), scalar.number(F.col(margin))
    part = lambda test: F.round(F.avg(F.coalesce(test, F.lit(False)).cast("double")), 4)
    one = df.agg(
        F.round(F.avg(c), 4).alias("confidence_mean"), F.round(F.lit(rows.quantiles(df, c, [0.5])[0]).cast("double"), 4).alias("confidence_median"), part(c < 0.6).alias("confidence_lt_0_6_share"), part(c < 0.4).alias("confidence_lt_0_4_share"),
        F.round(F.avg(m), 4).alias("top2_margin_mean"), part(m < 0.15).alias("top2_margin_lt_0_15_share"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def top_categories(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(category, n); null is 空值."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("空值")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def daily(df: DataFrame, column: str) -> DataFrame:
    """(day, n) of parseable times."""
    return df.select(F.to_date(scalar.parse_time(F.col(column))).alias("day")).filter("day is not null").groupBy("day").agg(F.count("*").alias("n"))


def agreement(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """One row (total_rows, usable_rows, matched_rows, agreement_rate, error_rate) over pairs without a null."""
    both = F.col(reference).isNotNull() & F.col(predicted).isNotNull()
    same = both & (F.trim(F.col(reference).cast("string")) == F.trim(F.col(predicted).cast("string")))
    one = df.agg(F.count("*").alias("total_rows"), F.count_if(both).alias("usable_rows"), F.count_if(same).alias("matched_rows"))
    return one.select("*", scalar.share(F.col("matched_rows"), F.col("usable_rows")).alias("agreement_rate"), scalar.share(F.col("usable_rows") - F.col("matched_rows"), F.col("usable_rows")).alias("error_rate"))


def confusion(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """The long crosstab of pairs without a null."""
    return crosstab(df.filter(F.col(reference).isNotNull() & F.col(predicted).isNotNull()), reference, predicted)


def disagreements(df: DataFrame, reference: str, predicted: str, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """L5."""
    return sampling.random_sample(df.filter(F.trim(F.col(reference).cast("string")) != F.trim(F.col(predicted).cast("string"))), n, key, seed)


def top_terms(df: DataFrame, body: str, k: int = 20) -> DataFrame:
    """(term, n) of lower-case words between blanks."""
    return df.select(F.explode(F.split(F.lower(text.squash(F.col(body))), " ")).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def grouped(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """N, mean, least and greatest of a number by group."""
    x = scalar.number(F.col(column))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"))
