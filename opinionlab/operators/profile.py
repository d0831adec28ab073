"""Column roles, summaries and audits of personal data and quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text

#: Words in a column's name -> its role; the first that matches counts.
NAME_ROLES = [
    ("link", "link url 网址 链接".split()),
    ("time", "date time 日期 时间".split()),
    ("text", "body comment content text 内容 描述 文本 正文 评论 说明".split()),
    ("person", "author name user 作者 昵称 用户 账号".split()),
    ("source", "channel platform source 平台 来源 渠道".split()),
]
SENSITIVE_HINTS = sorted("ip id uid url 主页 位置 作者 地址 手机 昵称 用户 电话 网址 账号 邮箱 链接".split(), reverse=True)
TEXT_HINTS = "内容 文本 正文 留言 翻译 评论".split()
FLAGS = ["empty_text", "short_text_candidate", "emoji_or_symbol_only", "bracket_token_only", "common_low_info_text", "contains_url", "contains_mention", "contains_email", "contains_phone_or_long_number", "question_like", "duplicate_expression"]


def value_counts(df: DataFrame) -> DataFrame:
    """(column_name, value, n) over all columns as strings: two levels of counting, so no distinct is expanded by column."""
    names = df.columns
    own = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in names))
    long = own.unpivot([], names, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def column_roles(df: DataFrame) -> DataFrame:
    """(column_name, role_guess, non_empty, missing_pct) of each column."""
    value = F.trim("value")
    filled = F.col("value").isNotNull()
    weight = lambda test: F.sum(F.when(filled & test, F.col("n")).otherwise(0))
    stats = value_counts(df).groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        weight(F.lit(True)).alias("filled"),
        weight(value != "").alias("non_empty"),
        F.count_distinct(value).alias("unique"),
        F.sum(F.when(filled, F.length(value) * F.col("n"))).alias("chars"),
        weight(scalar.number(F.col("value")).isNotNull()).alias("numbers"),
        weight(scalar.parse_time(F.col("value")).isNotNull()).alias("times"),
    )
    least = F.greatest("filled", F.lit(1))
    named = None
    for role, words in NAME_ROLES:
        test = F.lower("column_name").rlike("|".join(map(re.escape, words)))
        named = F.when(test, role) if named is None else named.when(test, role)
    role = (
        named.when((F.col("filled") > 0) & (F.col("numbers") / least >= 0.85), "numeric")
        .when((F.col("filled") > 0) & (F.col("times") / least >= 0.75), "time")
        .when(F.coalesce(F.col("chars"), F.lit(0)) / least >= 30, "text")
        .when(F.col("unique") / least <= 0.25, "category")
        .when(F.col("unique") / least >= 0.9, "id_or_key")
        .otherwise("unknown")
    )
    missing = F.round((F.col("rows") - F.col("filled")) / F.greatest("rows", F.lit(1)) * 100, 2)
    return stats.select("column_name", role.alias("role_guess"), F.col("filled").alias("non_empty"), missing.alias("missing_pct"))


def sample_values(df: DataFrame, columns: list[str], ordinal: str, k: int = 3, width: int = 80) -> DataFrame:
    """(column_name, place, value): each column's first k distinct squashed values, cut to width."""
    own = df.select(F.col(ordinal).alias("_at"), *(text.squash(F.col(f"`{c}`").cast("string")).alias(c) for c in columns))
    first = own.unpivot(["_at"], columns, "column_name", "value").filter("value <> ''").groupBy("column_name", "value").agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("_at", "value")).cast("long")
    return first.withColumn("place", place).filter(F.col("place") <= k).select("column_name", "place", F.substring("value", 1, width).alias("value"))


def sensitive_columns(columns: list[str], hints: list[str] = SENSITIVE_HINTS) -> list[str]:
    """Columns with a hint in their name; short ASCII hints must be a token of it."""
    out = []
    for c in columns:
        lower = c.lower()
        tokens = set(re.split(r"[^a-z0-9]+", lower))
        if any((h in tokens) if h.isascii() and len(h) <= 3 else h.lower() in lower for h in hints):
            out.append(c)
    return out


def default_text_columns(columns: list[str]) -> list[str]:
    """P6."""
    return [c for c in columns if any(h in c for h in TEXT_HINTS)]


def column_risks(df: DataFrame, hints: list[str] = SENSITIVE_HINTS) -> DataFrame:
    """P5: (column_name, risk_type, nonblank_rows, unique_values, recommended_action) of the sensitive columns."""
    names = sensitive_columns(df.columns, hints)
    schema = "column_name string, risk_type string, nonblank_rows long, unique_values long, recommended_action string"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    counts = value_counts(df.select(*(F.col(f"`{c}`") for c in names))).withColumn("value", F.trim("value")).filter("value <> ''")
    found = counts.groupBy("column_name").agg(F.sum("n").alias("nonblank_rows"), F.count_distinct("value").alias("unique_values"))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    return every.join(found, "column_name", "left").select("column_name", F.lit("sensitive_column_name").alias("risk_type"), F.coalesce("nonblank_rows", F.lit(0)).alias("nonblank_rows"), F.coalesce("unique_values", F.lit(0)).alias("unique_values"), F.lit("drop_or_hash").alias("recommended_action"))


def text_risks(df: DataFrame, columns: list[str], ordinal: str, examples: bool = True) -> DataFrame:
    """(column_name, pattern, hit_rows[, examples]) of the patterns that occur; examples are the first three, masked."""
    hits = F.array(*(F.when(F.col("value").rlike(p), name) for name, p in text.PATTERNS.items()))
    own = df.select(F.col(ordinal).alias("_at"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns)).unpivot(["_at"], columns, "column_name", "value")
    own = own.select("_at", "column_name", "value", F.explode(F.array_compact(hits)).alias("pattern"))
    if not examples:
        return own.groupBy("column_name", "pattern").agg(F.count("*").alias("hit_rows"))
    place = F.row_number().over(Window.partitionBy("column_name", "pattern").orderBy("_at"))
    some = own.withColumn("place", place).filter("place <= 3").groupBy("column_name", "pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.mask_audit(F.col("value")).alias("v")))), lambda x: x["v"]), " | ").alias("examples"))
    return own.groupBy("column_name", "pattern").agg(F.count("*").alias("hit_rows")).join(some, ["column_name", "pattern"])


def privacy_summary(df: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """One row (row_count, sensitive_columns, text_columns, text_risk_types)."""
    risks = text_risks(df, columns, ordinal, examples=False).agg(F.count("*").alias("text_risk_types"))
    rows = df.agg(F.count("*").alias("row_count"))
    return rows.crossJoin(risks).select("row_count", F.lit(len(sensitive_columns(df.columns))).cast("long").alias("sensitive_columns"), F.lit(len(columns)).cast("long").alias("text_columns"), "text_risk_types")


def quality_flags(df: DataFrame, column: str, short: int = 6) -> DataFrame:
    """Df with squashed text, info_len, FLAGS and duplicate_count."""
    own = _flagged(df.withColumn("_text", text.squash(F.col(column))), short).drop("_text")
    # flags are made before the window, and equal texts are found by their digests, so that texts move only if they are asked for
    own = own.withColumn("duplicate_count", F.count("*").over(Window.partitionBy("_digest"))).drop("_digest")
    return own.withColumn("duplicate_expression", (F.col("duplicate_count") > 1) & ~F.col("empty_text"))


def _flagged(own: DataFrame, short: int) -> DataFrame:
    """own with the flags of its squashed _text, but for duplicate_expression, info_len and _digest."""
    t, n = F.col("_text"), F.col("info_len")
    flags = {
        "empty_text": t == "",
        "short_text_candidate": (n < short) & (t != ""),
        "emoji_or_symbol_only": text.symbol_only(t),
        "bracket_token_only": text.bracket_only(t),
        "common_low_info_text": text.common_low_information(t),
        **{name: text.profile_flag(t, name) for name in text.PROFILE_PATTERNS},
        "_digest": text.digest(t),
    }
    return own.withColumn("info_len", text.info_length_profile(t)).withColumns(flags)


def stacked(df: DataFrame, metrics: dict[str, Column], value: str = "value") -> DataFrame:
    """(metric, value) rows of a one-row aggregate."""
    entries = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias(value)) for k, v in metrics.items()))
    return df.select(F.explode(entries).alias("m")).select("m.metric", f"m.{value}")


def quality_profile(df: DataFrame, column: str, short: int = 6) -> DataFrame:
    """(metric, count, share) of rows, unique_texts, duplicate_extra_rows and each of FLAGS."""
    # flags are made where the texts are; rows of equal flags and digest are one of the shuffle
    names = [f for f in FLAGS if f != "duplicate_expression"]
    texts = _flagged(df.select(text.squash(F.col(column)).alias("_text")), short).groupBy("_digest", *names).agg(F.count("*").alias("n"))
    tests = {**{f: F.col(f) for f in names}, "duplicate_expression": (F.col("n") > 1) & ~F.col("empty_text")}
    agg = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("unique_texts"), *(F.coalesce(F.sum(F.when(v, F.col("n"))), F.lit(0)).alias(k) for k, v in tests.items()))
    agg = agg.withColumn("duplicate_extra_rows", F.col("rows") - F.col("unique_texts"))
    entries = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("count"), scalar.share(F.col(k), F.col("rows")).alias("share")) for k in ["rows", "unique_texts", "duplicate_extra_rows", *FLAGS]))
    return agg.select(F.explode(entries).alias("m")).select("m.*")


def flag_samples(flags: DataFrame, ordinal: str, k: int = 100) -> DataFrame:
    """(sample, ordinal): the first k rows of each kind of sample."""
    kinds = {
        "empty_text": F.col("empty_text"),
        "short_text": F.col("short_text_candidate"),
        "emoji_or_symbol_only": F.col("emoji_or_symbol_only"),
        "common_low_info": F.col("common_low_info_text"),
        "question_like": F.col("question_like"),
        "duplicate_expression": F.col("duplicate_expression"),
        "privacy_risk": F.col("contains_url") | F.col("contains_mention") | F.col("contains_email") | F.col("contains_phone_or_long_number"),
    }
    own = flags.select(ordinal, F.explode(F.array_compact(F.array(*(F.when(v, name) for name, v in kinds.items())))).alias("sample"))
    return own.withColumn("_place", F.row_number().over(Window.partitionBy("sample").orderBy(ordinal))).filter(F.col("_place") <= k).select("sample", ordinal)
