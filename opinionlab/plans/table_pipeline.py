"""Table processing by a config.

Stages run in a fixed order - drop blank, minimum length, dates, keywords, exact
copies, equal prefixes - and each removed row keeps the first stage that it
failed.  The row-local stages are one CASE; a dedupe sees only rows that no
stage before it removed, by giving removed rows partitions of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text
from ..operators import rows
from ..sources.readers import ORDINAL

STAGE, REASON = "_stage", "删除原因"


@dataclass
class Config:
    """What to do; None or empty leaves a stage out, as does a column that isn't there."""

    rename_map: dict[str, str] = field(default_factory=dict)
    text_columns: list[str] = field(default_factory=list)
    primary_column: str | None = None
    drop_empty_primary: bool = False
    min_chars: int = 0
    date_column: str | None = None
    date_start: str | None = None
    date_end: str | None = None
    keyword_column: str | None = None
    keyword_terms: list[str] = field(default_factory=list)
    keyword_mode: str = "any"
    dedupe_exact: bool = False
    dedupe_prefix: int = 0
    keep_columns: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, own: dict) -> Config:
        """From the JSON form with its nested filters."""
        dates, words, dedupe = own.get("date_filter") or {}, own.get("keyword_filter") or {}, own.get("dedupe") or {}
        return cls(
            own.get("rename_map") or {}, own.get("text_columns") or [], own.get("primary_column"), bool(own.get("drop_empty_primary")), int(own.get("min_chars") or 0),
            dates.get("column"), dates.get("start"), dates.get("end"), words.get("column"), words.get("terms") or [], words.get("mode", "any"), bool(dedupe.get("exact")), int(dedupe.get("prefix_n") or 0), own.get("keep_columns") or [],
        )


def staged(df: DataFrame, config: Config, ordinal: str = ORDINAL) -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with cleaned columns and _stage (null: kept, else the number of the stage), and the stages' (name, reason)."""
    df = df.withColumnsRenamed({k: v for k, v in config.rename_map.items() if k in df.columns})
    for c in config.text_columns:
        if c in df.columns:
            df = df.withColumn(f"{c}_清洗后", text.squash(F.col(c)))
    primary = config.primary_column
    main = f"{primary}_清洗后" if f"{primary}_清洗后" in df.columns else primary if primary in df.columns else None
    stages: list[tuple[str, str]] = []
    fails: list[Column] = []

    def local(name: str, reason: str, keeps: Column) -> None:
        stages.append((name, reason))
        fails.append(~F.coalesce(keeps, F.lit(False)))

    if main and config.drop_empty_primary:
        local("drop_empty_primary", "主要列为空", F.trim(text.plain(F.col(main))) != "")
    if main and config.min_chars:
        local("min_chars", f"少于{config.min_chars}字", F.length(text.plain(F.col(main))) >= config.min_chars)
    if config.date_column in df.columns:
        local("date_filter", "不在日期范围内", rows.in_dates(F.col(config.date_column), config.date_start, config.date_end))
    words = config.keyword_column or main
    if words in df.columns and config.keyword_terms:
        local("keyword_filter", "关键词未命中", rows.has_keywords(F.col(words), config.keyword_terms, config.keyword_mode))
        df = df.withColumn("命中关键词", rows.keyword_hits(F.col(words), config.keyword_terms))
    df = df.withColumn(STAGE, F.coalesce(*(F.when(f, k) for k, f in enumerate(fails)), F.lit(None).cast("int")))
    for name, reason, key in (("dedupe_exact", "完全重复", lambda c: F.col(c)), ("dedupe_prefix", f"前{config.dedupe_prefix}字重复", lambda c: F.substring(c, 1, config.dedupe_prefix))):
        if main and (config.dedupe_exact if name == "dedupe_exact" else config.dedupe_prefix):
            here = len(stages)
            stages.append((name, reason))
            own = F.when(F.col(STAGE).isNull(), key(main))
            place = F.row_number().over(Window.partitionBy(F.xxhash64(own), F.when(F.col(STAGE).isNotNull(), F.col(ordinal)), own).orderBy(ordinal))
            df = df.withColumn(STAGE, F.when(F.col(STAGE).isNull() & (place > 1), here).otherwise(F.col(STAGE)))
    return df, stages


def process(df: DataFrame, config: Config, ordinal: str = ORDINAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result, removed, log): result has keep_columns if given; removed has all columns and the reason; log counts each stage."""
    own, stages = staged(df, config, ordinal)
    result = scalar.keep(own, F.col(STAGE).isNull()).drop(STAGE)
    keep = [c for c in config.keep_columns if c in result.columns]
    removed = scalar.keep(own, F.col(STAGE).isNotNull()).withColumn(REASON, F.element_at(F.array(*(F.lit(r) for _, r in stages)), F.col(STAGE) + 1)) if stages else own.limit(0).withColumn(REASON, F.lit(""))
    return result.select(*keep) if keep else result, removed.drop(STAGE), step_log(own, stages)


def step_log(own: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """(step, before_rows, after_rows, removed_rows) of each stage from one scan."""
    if not stages:
        return own.sparkSession.createDataFrame([], "step string, before_rows long, after_rows long, removed_rows long")
    counts = own.agg(F.count("*").alias("n"), *(F.coalesce(F.count_if(F.col(STAGE) == k), F.lit(0)).alias(f"s{k}") for k in range(len(stages))))
    before = F.col("n")
    out = []
    for k, (name, _) in enumerate(stages):
        gone = F.col(f"s{k}")
        out.append(F.struct(F.lit(name).alias("step"), before.alias("before_rows"), (before - gone).alias("after_rows"), gone.alias("removed_rows")))
        before = before - gone
    return counts.select(F.explode(F.array(*out)).alias("x")).select("x.*")
