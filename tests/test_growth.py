"""What a query costs as its tables grow, and that it counts as before: jobs, bytes shuffled, grams by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinionlab import queries
from opinionlab.functions import gram_codes, text
from opinionlab.operators import classify, prepare, profile, rows, topics
from opinionlab.sources.tables import stored

#: few characters, many, and more than fit packed codes
ALPHABETS = ["ab", "abcdefgh é", "".join(map(chr, range(0x4E00, 0x9000))) + "😀\0", "".join(chr(x) for x in range(1, 0x20000) if not 0xD800 <= x < 0xE000)]


def _grams(t, low, high):
    return [t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1)]


@pytest.mark.parametrize("piece", [1 << 20, 300])
@pytest.mark.parametrize("letters", ALPHABETS)
def test_gram_codes_by_force(monkeypatch, letters, piece):
    monkeypatch.setattr(gram_codes, "PIECE", piece)
    rng = random.Random(1)
    own = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 50, 400]))) for _ in range(40)]
    if len(letters) > 100_000:
        own.append(letters[:40_000] + letters[:10])
    at = np.array(sorted(rng.randint(0, 30) for _ in own))
    want = Counter((int(r), g) for r, t in zip(at, own, strict=True) for g in _grams(t, 1, 4))
    some = list(dict.fromkeys([g for _, g in rng.sample(sorted(want), 50)] + ["zz", "😀😀"]))
    known, counted, found = gram_codes.Vocabulary(some), Counter(), Counter()
    for start, p in gram_codes.pieces(pa.array(own), at, 4):
        for n in (1, 2, 3, 4):
            groups, ids, counts = p.tally(n)
            for r, g, c in zip(groups + p.base, p.decode(ids, n).to_pylist(), counts, strict=True):
                counted[(int(r), g)] += int(c)
            for t, g in zip(*p.find(known, n), strict=True):
                found[(int(at[start + t]), some[g])] += 1
    assert counted == want
    assert found == Counter({k: v for k, v in want.items() if k[1] in set(some)})


def jobs(spark, name, run):
    """The number of jobs that run starts, and what it gives."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_all_k_share_their_rounds(spark):
    rng = random.Random(5)
    words = [["red green blue", "cold warm hot", "one two three", "north south"][k % 4] for k in range(60)]
    df = spark.createDataFrame([(k, f"{w} {rng.choice(words)} {rng.random():.6f}") for k, w in enumerate(words)], "id long, t string")
    counts = topics.term_counts(df, "id", "t")
    vecs = stored(topics.vectors(counts, topics.vocabulary(counts, 60), "id"))
    n, (k, own, scores) = jobs(spark, "k", lambda: topics.choose_k(df, vecs, "id", stored))
    assert n <= 30 + 10 and [a for a, _ in scores] == list(range(3, 10)) and own.count() == 60
    # each k is what it gives by itself
    assert sorted(own.collect()) == sorted(topics.kmeans(df, vecs, "id", k, stored).collect())


def test_texts_of_one_key_count_together(spark):
    df = spark.createDataFrame([(1, "abab"), (1, "ab"), (2, "abc"), (3, None)], "id long, t string")
    counts = topics.term_counts(df, "id", "t")
    assert {r["gram"]: r["df"] for r in topics.vocabulary(counts, 4).collect()} == {"ab": 2, "ba": 1, "aba": 1, "bab": 1, "abab": 1, "bc": 1, "abc": 1}
    vecs = topics.vectors(counts, topics.vocabulary(counts, 4), "id")
    got = {r["id"]: {topics.grams_of(vecs)[t]: c for t, c in zip(r["terms"], r["tf"], strict=True)} for r in vecs.collect()}
    assert got == {1: {"ab": 3, "ba": 1, "aba": 1, "bab": 1, "abab": 1}, 2: {"ab": 1, "bc": 1, "abc": 1}, 3: {}}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_counted_where_texts_are(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "😀"), (3, None)], "id long, t string")
    own = classify.gram_counts(df, "id", "t")
    assert "Exchange" not in plan(own)
    assert sorted(map(tuple, own.collect())) == sorted([(1, "a", 2), (1, "b", 1), (1, "ab", 1), (1, "ba", 1), (2, "😀", 1)])
    again = df.union(df.filter("id = 1"))
    assert {(r["id"], r["gram"]): r["c"] for r in classify.gram_counts(again, "id", "t").collect()}[(1, "a")] == 4


def test_label_given_twice_counts_a_text_twice(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "b")], "id long, t string")
    given = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (9, "x")], "id long, l string")
    got = sorted(map(tuple, classify.model_tokens(docs, "id", "t", "l", given).collect()))
    assert got == [("x", "a", 2), ("x", "ab", 2), ("x", "b", 2), ("y", "b", 1)]
    scored = classify.train_and_score(docs, "id", "t", "l", "nb", given)
    # neither the text nor its grams are shuffled to score it
    assert "Exchange" not in plan(scored) and [r["predicted_label"] for r in scored.orderBy("id").collect()] == ["x", "x"]


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    own = ["a\r\nb", " lead", "trail ", "\ttab\t", "NA", "null", "nan", '"q"', '"', "\\", 'a\\"', "\n", "x\n", "\nx", "#c", " ", '",\n"', "\r\n", 'x"\n1,"y', None, ""]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(own)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["doc_id"]): r["text"] for r in queries.queries()["csv_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {i: t or None for i, t in enumerate(own)}


def test_quantiles_by_force(spark, monkeypatch):
    rng = random.Random(2)
    parts = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    for few in (10_000, 3):
        monkeypatch.setattr(rows, "_FEW", few)
        for own in ([rng.gauss(0, 1) for _ in range(300)], [rng.choice([1e9, 1e9 + 1e-6, 5.0]) for _ in range(101)], [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 3.0, 4.0], [float("-inf"), float("inf"), 1.0, 2.0, 3.0, None], [7.0] * 50, [None], list(range(1000))):
            df = spark.createDataFrame([(None if v is None else float(v),) for v in own], "x double")
            want = df.select(*(F.percentile("x", F.lit(p)) for p in parts)).first()
            assert rows.quantiles(df, F.col("x"), parts) == pytest.approx(list(want), nan_ok=True)
    # values stay where they are: none is shuffled
    df = spark.range(50_000).selectExpr("id", "cast((id * 7919) % 50000 as double) AS x")
    n, got = jobs(spark, "q", lambda: rows.outliers_iqr(df, "x", 0.25))
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    assert {r["id"] for r in got.collect()} == {i for i in range(50_000) if not 12499.75 - 6249.875 <= i * 7919 % 50_000 <= 37499.25 + 6249.875}


def test_short_cuts_of_text_rules(spark):
    """The rules as they are said, without the looks that spare most texts the work."""
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "　", "\x1c", "[", "]", "[赞]", "[ ]", "@", "@a ", "www.", "w ww.x", "http://", "ht tps://a", "HTTP://B", "h", "W", "a", "é", "7", "1234567", "13812345678", "٣٤٥٦٧٨٩", "a@b.cc", "?", "吗", "好的", "666", "呵呵", "👍", "-", "x y", "#", "哪里"]
    own = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(3000)] + bits + [None]
    df = spark.createDataFrame([(t,) for t in own], "t string")
    t = text.plain(F.col("t"))
    none = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")) == 0
    cut = lambda x: F.regexp_replace(x, r"\[[^\]]+\]", "")
    links = lambda x: F.regexp_replace(F.regexp_replace(cut(x), rf"(?iU)https?://{text._NON}+|www\.{text._NON}+", ""), rf"(?U)@{text._NON}+", "")
    c = text.compact(t)
    tokens = lambda k: c.rlike(rf"^(?:\[[^\]]{{1,{k}}}\])+$")
    emoji = (c != "") & (tokens(8) | none(cut(c)))
    rules = {
        "squash": (text.squash(t), F.trim(F.regexp_replace(t, f"{text.SPACE}+", " "))),
        "bracket_only": (text.bracket_only(t), tokens(12)),
        "emoji_only": (text.emoji_only(t), emoji),
        "symbol_only": (text.symbol_only(t), (c != "") & (tokens(12) | none(links(c)))),
        "attitude": (text.attitude(t), ~emoji & t.rlike(text.ATTITUDE)),
        "info_length_profile": (text.info_length_profile(t), F.length(F.regexp_replace(links(t), r"[^\p{L}\p{N}]+", "")).cast("long")),
        "low_information": (text.low_information(t), c.isin(text.LOW_INFORMATION) | emoji),
        **{n: (text.profile_flag(t, n), t.rlike(p)) for n, p in text.PROFILE_PATTERNS.items()},
    }
    wrong = df.select("t", F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), n) for n, (a, b) in rules.items()))).alias("w")).filter("size(w) > 0").limit(5).collect()
    assert wrong == []


def test_flags_and_numbers_move_no_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for df in (profile.quality_flags(docs, "text").drop("text"), profile.quality_profile(docs, "text")):
        moved = [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]
        assert moved and all("_digest" in x and not re.search(r"\b_?text#", x) for x in moved)
    # the kept rows' text moves once, to meet its number
    own = prepare.prepare(docs, "text", "doc_id", drop_low_info=True)
    assert not any("Window" in line and "clean_text" in line for line in own._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_regression_scores_where_the_texts_are(spark):
    own = spark.createDataFrame([(k, "abab" if k % 2 else "cdcd", ("odd" if k % 2 else "even") if k < 8 else None) for k in range(12)], "id long, t string, l string")
    scored = classify.train_and_score(own.select("id", "t"), "id", "t", "l", "lr", own.filter("l is not null").select("id", "l"), max_iter=5)
    assert "Exchange" not in plan(scored)
    assert all(r["predicted_label"] == ("odd" if r["id"] % 2 else "even") for r in scored.collect())
