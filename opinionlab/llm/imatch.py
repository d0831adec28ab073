"""Operator 7, document fingerprints: I-Match over several randomised lexicons.

Terms are the words of the lower-cased text (runs of ASCII letters, digits and
non-ASCII characters).  The lexicon holds the terms whose inverse document
frequency ln(N / df) lies in a chosen band; N and df cover all documents.
Subset k of the lexicon keeps the terms whose k-th hexadecimal digit of
md5(seed | term) lies under ``kept`` of sixteen.  A fingerprint is the md5 of a
document's distinct lexicon terms in code-point order, joined with "|".

The band's upper bound makes the lexicon's size independent of the corpus: a
term in it is in at least N * exp(-high) documents, so there are at most
(mean distinct terms of a document) * exp(high) of them.  Its size is checked:
up to ``broadcast_terms`` it is sent to the executors, beyond that the
documents' terms are joined with it.

Defined results: a null or word-free text has n_terms 0 and null fingerprints,
as has any fingerprint over fewer than ``min_terms`` terms; a null doc_id stays
null; repeated rows give repeated rows; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
#: Terms a worker counts before it hands on what it has.
FLUSH = 400_000
_loaded: dict = {}


def terms(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all rows; the row with a null term has the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        give = lambda: pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "df": pa.array(seen.values(), pa.int64())})
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(terms(text))
                if len(seen) > FLUSH:
                    yield give()
                    seen.clear()
        seen[None] = rows
        yield give()

    return docs.select("text").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _subset_hits(term: str, seed: int, subsets: int, kept: int) -> int:
    digits = hashlib.md5(f"{seed}|{term}".encode()).hexdigest()
    return sum(1 << k for k in range(subsets) if int(digits[k], 16) < kept)


def _fingerprints(found: list[tuple[str, int]], subsets: int, min_terms: int) -> list[str | None]:
    """Of sorted (term, bit mask of its subsets): the whole lexicon's fingerprint, then each subset's."""
    out = []
    for k in range(-1, subsets):
        own = [t for t, m in found if k < 0 or m >> k & 1]
        out.append(hashlib.md5("|".join(own).encode()).hexdigest() if len(own) >= max(1, min_terms) else None)
    return out


def fingerprints(docs: DataFrame, low: float = 2.3, high: float = 6.9, subsets: int = 8, kept: int = 11, seed: int = 7, min_terms: int = 3, broadcast_terms: int = 1_000_000) -> DataFrame:
    """(doc_id, n_terms, print_full, print_0 .. print_<subsets - 1>) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = stored(document_frequencies(docs))
    total = counts.filter("term is null").agg(F.sum("df")).first()[0] or 0
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    lexicon = counts.filter(F.col("term").isNotNull() & (F.col("df") <= total) & (idf >= low) & (idf <= high)).select("term")
    names = ["print_full", *(f"print_{k}" for k in range(subsets))]
    schema = "doc_id long, n_terms long, " + ", ".join(f"{x} string" for x in names)

    def batch_of(ids: pa.Array, found: list[list[tuple[str, int]]]) -> pa.RecordBatch:
        columns = list(zip(*(_fingerprints(x, subsets, min_terms) for x in found), strict=True)) or [()] * (subsets + 1)
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["doc_id", "n_terms", *names])

    if lexicon.limit(broadcast_terms + 1).count() <= broadcast_terms:
        key = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast(lexicon.toPandas()["term"].tolist())

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if _loaded.get("key") != key:  # once for each worker
                _loaded.update(key=key, masks={t: _subset_hits(t, seed, subsets, kept) for t in sent.value})
            masks = _loaded["masks"]
            for batch in batches:
                found = [sorted((t, masks[t]) for t in terms(text) & masks.keys()) for text in batch.column(1).to_pylist()]
                yield batch_of(batch.column(0), found)

        return docs.mapInArrow(apply, schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(terms(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], names=["row", "doc_id", "terms"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted((t, _subset_hits(t, seed, subsets, kept)) for t in x or []) for x in batch.column(1).to_pylist()]
            yield batch_of(batch.column(0), found)

    # beyond a broadcast: rows are keyed before the join, so that repeated and null ids stay apart
    keyed = stored(docs.select(F.expr("uuid()").alias("row"), "doc_id", "text"))
    split_terms = keyed.mapInArrow(split, "row string, doc_id long, terms array<string>").select("row", F.explode("terms").alias("term"))
    hits = split_terms.join(lexicon, "term").groupBy("row").agg(F.collect_list("term").alias("terms"))
    return keyed.select("row", "doc_id").join(hits, "row", "left").select("doc_id", "terms").mapInArrow(finish, schema)


def _sql(low: float = 2.3, high: float = 6.9, subsets: int = 8, kept: int = 11, seed: int = 7, min_terms: int = 3) -> str:
    prints = ", ".join(
        f"CASE WHEN count(*) FILTER ({test}) >= {min_terms} THEN md5(string_agg(term, '|' ORDER BY term) FILTER ({test})) END AS {name}"
        for name, test in [("print_full", "term IS NOT NULL"), *((f"print_{k}", f"strpos('{'0123456789abcdef'[:kept]}', substr(digits, {k + 1}, 1)) > 0") for k in range(subsets))]
    ).replace("FILTER (", "FILTER (WHERE ")
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
doc_terms AS (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM rows),
lexicon AS (SELECT term, md5('{seed}|' || term) AS digits FROM doc_terms GROUP BY term
  HAVING ln((SELECT count(*) FROM rows)::DOUBLE / count(*)) BETWEEN {low} AND {high}),
hits AS (SELECT r, term, digits FROM doc_terms JOIN lexicon USING (term))
SELECT any_value(doc_id) AS doc_id, count(term) AS n_terms, {prints}
FROM rows LEFT JOIN hits USING (r) GROUP BY r"""


#: The same rows as fingerprints() gives.
SQL = _sql()
