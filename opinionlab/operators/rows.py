"""Filters, deduplication and unions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text


def in_dates(column: Column, start: str | None = None, end: str | None = None) -> Column:
    """Parseable, from start, up to the last second of end."""
    ts = scalar.parse_time(column)
    out = ts.isNotNull()
    if start:
        out &= ts >= F.lit(start).cast("timestamp_ntz")
    if end:
        out &= ts <= F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' SECOND")
    return F.coalesce(out, F.lit(False))


def has_keywords(column: Column, terms: list[str], mode: str = "any") -> Column:
    """Contains any (or all) terms, whatever the case; no terms are always met."""
    own = [t.strip() for t in terms if t.strip()]
    tests = [F.contains(F.lower(text.plain(column)), F.lit(t.lower())) for t in own]
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests) if tests else F.lit(True)


def keyword_hits(column: Column, terms: list[str], joint: str = "、", most: int | None = None) -> Column:
    """The terms found, in their order."""
    own = [t.strip() for t in terms if t.strip()]
    if not own:
        return F.lit("")
    found = F.array_compact(F.array(*(F.when(F.contains(F.lower(text.plain(column)), F.lit(t.lower())), t) for t in own)))
    return F.array_join(F.slice(found, 1, most) if most else found, joint)


def length_between(column: Column, low: int | None = None, high: int | None = None) -> Column:
    """Null or zero is no bound."""
    n = F.length(text.plain(column))
    return (n >= low if low else F.lit(True)) & (n <= high if high else F.lit(True))


def numeric_between(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """A number within the bounds."""
    x = scalar.number(column)
    return F.coalesce((x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True)) & x.isNotNull(), F.lit(False))


def keep_first(df: DataFrame, keys: list[str | Column], ordinal: str, last: bool = False) -> DataFrame:
    """Of the rows equal in keys (nulls are equal) the one of least, or greatest, ordinal; rows are sorted by a hash of the keys before the keys themselves."""
    order = F.col(ordinal).desc() if last else F.col(ordinal).asc()
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(order))).filter("_place = 1").drop("_place")


def members_of_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def distinct_keys(df: DataFrame, key: str) -> bool:
    """Whether no key occurs twice, which its column alone tells."""
    return not df.select(key).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()


def texts_by_key(df: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, texts): a row for each key with all its texts; where keys are distinct, no text is moved."""
    if distinct_keys(df, key):
        return df.select(key, F.array(body).alias("texts"))
    return df.select(key, body.alias("t")).groupBy(key).agg(F.collect_list("t").alias("texts"))


def union_ragged(parts: list[DataFrame]) -> DataFrame:
    """Columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Buckets of a pass of quantiles, and values that go to the driver in the end.
_BUCKETS, _FEW = 4096, 10_000


def quantiles(df: DataFrame, column: Column, parts: list[float]) -> list[float | None]:
    """Exact quantiles by linear interpolation, nulls left out, NaN greatest; None without values.

    The range that holds a rank is cut into buckets that are counted, until few
    values are left in it or all are equal; values are counted where they are,
    so a task reads a few thousand counts, however many values there are.
    """
    own = df.select(column.cast("double").alias("x")).filter("x IS NOT NULL")
    finite = ~F.isnan("x") & (F.abs("x") < math.inf)
    numbers = own.filter(finite)
    n, low, high, size, least, nan = own.agg(F.count("*"), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x"))), F.count_if(finite), F.count_if(F.col("x") == -math.inf), F.count_if(F.isnan("x"))).first()
    if not n:
        return [None] * len(parts)

    def rank(k: int) -> float:
        """The value of rank k from 0."""
        if k < least:
            return -math.inf
        if k >= least + size:
            return math.inf if k < n - nan else math.nan
        k, a, b, m = k - least, low, high, size
        while a < b and m > _FEW:
            step = b / _BUCKETS - a / _BUCKETS
            if step <= 0:  # a few of the least numbers there are
                break
            far = F.col("x") / F.lit(step) - F.lit(a / step) if b - a == math.inf else (F.col("x") - F.lit(a)) / F.lit(step)
            # buckets are in order of their values, as each step of the arithmetic is; their own least and greatest values are the next bounds
            place = F.least(F.floor(far), F.lit(_BUCKETS - 1)).cast("int")
            got = {r["i"]: (r["c"], r["l"], r["h"]) for r in numbers.filter(F.col("x").between(a, b)).groupBy(place.alias("i")).agg(F.count("*").alias("c"), F.min("x").alias("l"), F.max("x").alias("h")).collect()}
            for i in sorted(got):
                m = got[i][0]
                if k < m:
                    a, b = got[i][1:]
                    break
                k -= m
        if a == b:
            return a
        for v, c in sorted(map(tuple, numbers.filter(F.col("x").between(a, b)).groupBy("x").agg(F.count("*").alias("c")).collect())):
            if k < c:
                return v
            k -= c
        raise AssertionError("the table changed")

    known: dict[int, float] = {}
    at = lambda k: known[k] if k in known else known.setdefault(k, rank(k))
    out = []
    for p in parts:
        place = p * (n - 1)
        below, above = math.floor(place), math.ceil(place)
        out.append(at(below) if below == above else at(below) if at(below) == at(above) else (above - place) * at(below) + (place - below) * at(above))
    return out


def outliers_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond factor times the interquartile range; quartiles by linear interpolation."""
    low, high = quantiles(df, F.col(column), [0.25, 0.75])
    if low is None:
        return df.limit(0)
    spread = factor * (high - low)
    return df.filter((F.col(column) < F.lit(low) - F.lit(spread)) | (F.col(column) > F.lit(high) + F.lit(spread)))


def fuzzy_pairs(df: DataFrame, key: str, column: str, distance: int) -> DataFrame:
    """(key_a, key_b, distance), key_a < key_b, of values within an edit distance.

    Exact: a string within distance d of another has one of its d + 1 equal
    parts in it unchanged, at most d places away.  Values are joined on these
    parts and their places, then compared.
    """
    own = df.select(F.col(key).alias("k"), F.col(column).alias("v")).filter("v is not null")
    texts = own.groupBy("v").agg(F.count("*").alias("_n")).select("v", F.length("v").alias("n"))
    d = distance
    # the parts of each string as the longer (or equal) one, and every place a shorter one may have them at
    parts = [F.struct(F.lit(p).alias("p"), F.floor(F.col("n") * p / (d + 1)).cast("int").alias("at"), F.substring("v", F.floor(F.col("n") * p / (d + 1)).cast("int") + 1, F.floor(F.col("n") * (p + 1) / (d + 1)).cast("int") - F.floor(F.col("n") * p / (d + 1)).cast("int")).alias("s")) for p in range(d + 1)]
    left = texts.select("v", "n", F.explode(F.array(*parts)).alias("x")).select(F.col("v").alias("va"), F.col("n").alias("na"), "x.p", "x.s")
    probes = []
    for longer in range(d + 1):  # by how much the partner is longer
        for p in range(d + 1):
            total = F.col("n") + longer
            start = F.floor(total * p / (d + 1)).cast("int")
            size = F.floor(total * (p + 1) / (d + 1)).cast("int") - start
            for shift in range(-d, d + 1):
                at = start + shift
                probes.append(F.when((at >= 0) & (at + size <= F.col("n")), F.struct(total.cast("int").alias("na"), F.lit(p).alias("p"), F.substring("v", at + 1, size).alias("s"))))
    right = texts.select("v", F.explode(F.array_distinct(F.array_compact(F.array(*probes)))).alias("x")).select(F.col("v").alias("vb"), "x.na", "x.p", "x.s")
    pairs = left.join(right, ["na", "p", "s"]).filter("va <> vb").select("va", "vb").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("va", "vb", d)).filter("distance >= 0")
    pairs = pairs.union(pairs.select("vb", "va", "distance")).distinct().union(texts.select("v", "v", F.lit(0)))
    a, b = own.select(F.col("k").alias(f"{key}_a"), F.col("v").alias("va")), own.select(F.col("k").alias(f"{key}_b"), F.col("v").alias("vb"))
    return pairs.join(a, "va").join(b, "vb").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b", F.col("distance").cast("long").alias("distance"))
