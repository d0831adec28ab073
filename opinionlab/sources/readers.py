"""Readers (S1-S9): tables arrive as strings, each row with its ordinal.

CSV and TSV files are one sheet named 数据; Parquet is read as it is.  Workbooks
need openpyxl and are read on the driver, as a file holds at most a million rows
a sheet.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHEET = "数据"
ORDINAL = "_ordinal"
#: Texts that count as missing, as spreadsheet tools write them.
MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", missing: tuple[str, ...] = MISSING) -> DataFrame:
    """All columns as strings; quotes doubled, line breaks within quotes, a byte-order mark dropped."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_sheets(spark: SparkSession, path: str, sheets: str | list[str] = "all") -> list[tuple[str, DataFrame]]:
    """(sheet, rows) of a file, all of them or those named."""
    kind = Path(path).suffix.lower()
    if kind in (".csv", ".tsv"):
        out = [(SHEET, read_delimited(spark, path, "\t" if kind == ".tsv" else ","))]
    elif kind == ".parquet":
        out = [(SHEET, spark.read.parquet(path))]
    elif kind in (".xlsx", ".xlsm", ".xls"):
        out = _read_workbook(spark, path)
    else:
        raise ValueError(f"no reader for {kind or path}")
    if sheets == "all":
        return out
    known = dict(out)
    return [(s, known[s]) for s in sheets]


def _read_workbook(spark: SparkSession, path: str) -> list[tuple[str, DataFrame]]:
    import pandas as pd  # pandas needs openpyxl for this; its own error says so

    book = pd.read_excel(path, sheet_name=None, dtype=object)
    out = []
    for name, rows in book.items():
        texts = rows.astype(object).where(rows.notna(), None).map(lambda x: None if x is None else str(x))
        schema = ", ".join(f"`{c}` string" for c in texts.columns)
        out.append((name, spark.createDataFrame(texts.values.tolist(), schema) if len(texts.columns) else spark.createDataFrame([], "empty string")))
    return out


def with_ordinal(df: DataFrame, order: str | None = None) -> DataFrame:
    """An increasing ordinal: of a given order column, or of the rows' place in their file (not dense)."""
    if order:
        return df.withColumn(ORDINAL, F.col(order).cast("long"))
    return df.withColumn(ORDINAL, F.monotonically_increasing_id())


def read_config(path: str) -> dict:
    """S7."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical_label) of a JSON object or a CSV of these two columns."""
    if path.lower().endswith(".json"):
        own = read_config(path)
        if not isinstance(own, dict):
            raise ValueError("a label map is a JSON object")
        return label_map(spark, own)
    df = read_delimited(spark, path)
    if not {"alias", "canonical_label"} <= set(df.columns):
        raise ValueError("a label map has the columns alias and canonical_label")
    return df.select("alias", "canonical_label")


def label_map(spark: SparkSession, own: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([(str(k), str(v)) for k, v in own.items()], "alias string, canonical_label string")


@dataclass(frozen=True)
class Keywords:
    """A label's words, and the lengths of texts they are looked for in (None: no bound)."""

    words: list[str] = field(default_factory=list)
    min_chars: int | None = None
    max_chars: int | None = None


def read_keywords(path: str) -> dict[str, Keywords]:
    """JSON of label -> list or {keywords, min_chars, max_chars}, or CSV of label, keyword[, min_chars, max_chars].

    A CSV's lengths are the least min_chars and the greatest max_chars of a label; blanks are no bound.
    """
    out: dict[str, Keywords] = {}
    if path.lower().endswith(".json"):
        for label, own in read_config(path).items():
            out[label] = Keywords(list(own)) if isinstance(own, list) else Keywords(list(own.get("keywords", [])), own.get("min_chars"), own.get("max_chars"))
        return out
    with open(path, encoding="utf-8-sig", newline="") as f:
        for row in csv.DictReader(f):
            old = out.get(row["label"], Keywords())
            low, high = (int(float(row[k])) if (row.get(k) or "").strip() else None for k in ("min_chars", "max_chars"))
            least = min((x for x in (old.min_chars, low) if x is not None), default=None)
            most = max((x for x in (old.max_chars, high) if x is not None), default=None)
            out[row["label"]] = Keywords([*old.words, row["keyword"]], least, most)
    return out


def group_keywords(df: DataFrame) -> DataFrame:
    """A20 for a table (label, keyword, min_chars, max_chars): (label, keywords, min_chars, max_chars), keywords sorted and joined with "|"."""
    return df.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("keyword")), "|").alias("keywords"), F.min("min_chars").alias("min_chars"), F.max("max_chars").alias("max_chars"))


def combine_sheets(sheets: list[tuple[str, DataFrame]]) -> DataFrame:
    """The sheets' rows one below the other, missing columns null, with 来源工作表 and 来源行号 (a file's first data row is 2)."""
    out = None
    for k, (name, df) in enumerate(sheets):
        df = with_ordinal(df)
        line = F.row_number().over(Window.orderBy(ORDINAL)).cast("long") + 1
        own = df.select(F.lit(name).alias("来源工作表"), line.alias("来源行号"), *df.drop(ORDINAL).columns, F.lit(k).alias("_sheet"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheets")
    return out.withColumn(ORDINAL, F.col("_sheet").cast("long") * (1 << 40) + F.col("来源行号")).drop("_sheet")
