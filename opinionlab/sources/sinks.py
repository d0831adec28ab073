"""Writers (K1-K5)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """K1: a folder of CSV files, or with bom one file with a byte-order mark for spreadsheet tools, written by the driver row by row."""
    if not bom:
        # white space at a text's ends is part of it; Spark's writer would trim it
        df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(df.columns)
        for row in df.toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if v is None else v for v in row])


def write_book(parts: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """K2: each named table in its own folder; tables without rows are left out, but for the first."""
    done = []
    for k, (name, df) in enumerate(parts.items()):
        if k and not df.take(1):
            continue
        target = f"{folder}/{name}"
        write_csv(df, target) if fmt == "csv" else df.write.mode("overwrite").parquet(target)
        done.append(target)
    return done


def write_json(summary: Mapping | DataFrame, path: str) -> None:
    """K3: a summary as indented JSON, letters as they are; a DataFrame must be a report of few rows."""
    own = [json.loads(x) for x in summary.toJSON().collect()] if isinstance(summary, DataFrame) else dict(summary)
    Path(path).write_text(json.dumps(own, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
