"""Queries of this subpackage and their SQL: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_ids, imatch, link_trust, mixing, ngram_join, pieces, pii, quality, secrets, topk
from .tables import documents


_TOPS = ("com", "net", "org")
#: Operator 1's seeds among the hosts of the tables.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("cheap-pills", "adult-x", "free-bets", "casino-win", "spam-farm", "ads-track") for top in _TOPS)
TRUSTED = tuple(f"{name}.example.{top}" for name in ("ththth", "thther", "ththon", "ththan") for top in _TOPS)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_link_trust_url_filter": lambda s, d: link_trust.filter_urls(s.read.parquet(f"{d}/pages.parquet"), TRUSTED, BLOCKED),
        "op2_ngram_jaccard_join": lambda s, d: ngram_join.join(documents(s, d)),
        "op3_secret_scan": lambda s, d: secrets.scan_secrets(documents(s, d)),
        "op4_source_mixing": lambda s, d: mixing.mix(documents(s, d)),
        "op5_exact_top_k": lambda s, d: topk.top_k(s.read.parquet(f"{d}/embeddings.parquet")),
        "op6_pii_spans": lambda s, d: pii.find_pii(documents(s, d)),
        "op7_imatch_fingerprints": lambda s, d: imatch.fingerprints(documents(s, d)),
        "op8_quality_classifier": lambda s, d: quality.quality_scores(documents(s, d), _labels(s, d)),
        "op9_binary_token_ids": lambda s, d: binary_ids.write_binary(documents(s, d))[0],
        "op10_sentencepiece": lambda s, d: pieces.encode(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_link_trust_url_filter": link_trust.sql(TRUSTED, BLOCKED), "op2_ngram_jaccard_join": ngram_join.SQL, "op5_exact_top_k": topk.SQL, "op7_imatch_fingerprints": imatch.SQL}
