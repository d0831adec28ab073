"""A query for each operator, with the same query in DuckDB's SQL wherever SQL can express it.

Tables stand in for comments: documents (texts), labels (reviewed labels),
orders and events (dated categories), pages (markup).  Scores of a classifier
are made by a rule where the point isn't the classifier.  Rules about Chinese
texts and emoji run over the literal rows of CHINESE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar, text
from .functions import text_sql as q
from .operators import classify, labels, prepare, profile, reports, rows, sampling, topics
from .plans import gates, table_pipeline
from .sources import readers, sinks
from .sources.readers import Keywords
from .sources.tables import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

CHINESE = [
    (1, "支持"), (2, "不支持！"), (3, "[赞][强]"), (4, "[一二三四五六七八九]"), (5, "👍👍"), (6, "❤️"), (7, "？？？"), (8, "好的"), (9, "哈 哈"), (10, "这个政策太离谱了"), (11, "增强体质"), (12, "☀️今天不错"), (13, "看 https://a.com/x 很好"),
    (14, "@张三 说得对"), (15, "#机器人# 加油"), (16, "难道不好吗"), (17, "好吗啊"), (18, "全角　空格"), (19, "666"), (20, "<b>早安</b>"), (21, ""), (22, None), (23, "电话 13812345678 联系"), (24, "a.b+c@x-y.com.cn WWW.x.cn"),
]
GOOD = "CASE quality WHEN 1 THEN 'good' ELSE 'poor' END"
#: A classifier's output by rule, and the round before it.
SCORES = """doc_id, text, source, CASE WHEN doc_id % 17 = 0 THEN 'uncertain' WHEN n_chars > 1500 THEN 'good' ELSE 'poor' END AS predicted_label,
  CASE WHEN doc_id % 23 <> 0 THEN CAST(doc_id * 37 % 100 AS DOUBLE) / 100 END AS predicted_confidence, CAST(doc_id * 53 % 100 AS DOUBLE) / 100 AS top2_margin,
  CASE WHEN doc_id % 19 = 0 THEN 'TRUE' ELSE 'no' END AS is_sarcasm, CASE lang WHEN 'en' THEN 'good' WHEN 'fr' THEN 'poor' ELSE '' END AS weak_label"""
BEFORE = "doc_id, CASE WHEN doc_id % 13 = 0 THEN 'uncertain' WHEN n_chars > 1800 THEN 'good' ELSE 'poor' END AS predicted_label"
TARGETS = ["good", "poor", "mixed"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def literal(value: object) -> str:
    return "NULL" if value is None else repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(own: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in own)}) v({names}))"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*_split(SCORES))


def before(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*_split(BEFORE))


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, label, predicted_label)."""
    own = table(spark, d, "documents").selectExpr("doc_id", "text", "CASE WHEN n_chars > 1500 THEN 'good' ELSE 'poor' END AS predicted_label")
    return own.join(table(spark, d, "labels").selectExpr("doc_id", f"{GOOD} AS label"), "doc_id")


def _split(columns: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:k])
            at = k + 1
    return [*out, columns[at:]]


S = f"(SELECT {SCORES} FROM documents)"
B = f"(SELECT {BEFORE} FROM documents)"
R = f"(SELECT doc_id, text, {GOOD} AS label, CASE WHEN n_chars > 1500 THEN 'good' ELSE 'poor' END AS predicted_label FROM documents JOIN labels USING (doc_id))"
COUNT = "count(*)::BIGINT"

# ---- sources and sinks -------------------------------------------------------------------------------------------


@query("csv_roundtrip", "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def _(spark, d):  # S1-S5, K1
    path = new_path(spark)
    sinks.write_csv(table(spark, d, "documents"), path)
    return readers.read_delimited(spark, path, missing=("",))  # a text NA or null is a text


@query("ragged_union", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def _(spark, d):  # U1
    a = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    b = table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return rows.union_ragged([a, b])


_ALIASES = {"正面": "positive", "pos": "positive", "负面": "negative", "neg": "negative"}
_ALIASED = [(1, "pos"), (2, " neg "), (3, "positive"), (4, "其他"), (5, None)]


@query("label_alias_map", f"SELECT id::BIGINT AS id, coalesce(canonical_label, trim(label)) AS label FROM {values(_ALIASED, 'id, label')} a LEFT JOIN {values(list(_ALIASES.items()), 'alias, canonical_label')} m ON trim(a.label) = m.alias")
def _(spark, d):  # S8, F19, J5
    return labels.canonical(spark.createDataFrame(_ALIASED, "id long, label string"), "label", readers.label_map(spark, _ALIASES))


_WORDS = [("good", "best", 3, 40), ("good", "great", 5, None), ("poor", "bad", None, 90), ("poor", "awful", None, None)]


@query("keyword_map_group", f"SELECT label, string_agg(keyword, '|' ORDER BY keyword) AS keywords, min(min_chars)::BIGINT AS min_chars, max(max_chars)::BIGINT AS max_chars FROM {values(_WORDS, 'label, keyword, min_chars, max_chars')} GROUP BY label")
def _(spark, d):  # S9, A20
    return readers.group_keywords(spark.createDataFrame(_WORDS, "label string, keyword string, min_chars long, max_chars long"))


# ---- profile and privacy -------------------------------------------------------------------------------------------


def _role_sql(columns: list[str], source: str) -> str:
    named = " ".join(f"WHEN regexp_matches(lower(column_name), '{'|'.join(words)}') THEN '{role}'" for role, words in profile.NAME_ROLES)
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM {source}" for c in columns)
    return f"""WITH long AS ({long}), s AS (SELECT column_name, {COUNT} AS n, count(value)::BIGINT AS filled, count(DISTINCT trim(value)) AS u, coalesce(sum(length(trim(value))), 0) AS chars,
  count(*) FILTER (WHERE try_cast(value AS DOUBLE) IS NOT NULL) AS nums, count(*) FILTER (WHERE try_strptime(trim(value), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d', '%Y/%m/%d', '%Y%m%d']) IS NOT NULL) AS times FROM long GROUP BY 1)
SELECT column_name, CASE {named} WHEN nums >= 0.85 * filled AND filled > 0 THEN 'numeric' WHEN times >= 0.75 * filled AND filled > 0 THEN 'time' WHEN chars >= 30 * filled AND filled > 0 THEN 'text'
  WHEN u <= 0.25 * greatest(filled, 1) THEN 'category' WHEN u >= 0.9 * greatest(filled, 1) THEN 'id_or_key' ELSE 'unknown' END AS role_guess, filled AS non_empty, round((n - filled)::DOUBLE / greatest(n, 1) * 100, 2) AS missing_pct FROM s"""


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("inspect_roles", _role_sql(_ORDERS, "orders"))
def _(spark, d):  # P1, P2
    return profile.column_roles(table(spark, d, "orders").select(*_ORDERS))


@query(
    "sample_values",
    f"""WITH long AS (SELECT o_orderkey AS pos, 'o_orderpriority' AS column_name, {q.squash('o_orderpriority')} AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', {q.squash('o_orderstatus')} FROM orders),
f AS (SELECT column_name, value, min(pos) AS pos FROM long WHERE value <> '' GROUP BY 1, 2), r AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY pos, value) AS place, substr(value, 1, 80) AS value FROM f)
SELECT * FROM r WHERE place <= 3""",
)
def _(spark, d):  # P3
    return profile.sample_values(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey")


_HINTS = ["c_name", "nationkey", "custkey", "segment"]
_RISK = "SELECT '{c}' AS column_name, 'sensitive_column_name' AS risk_type, count(nullif(trim({c}::VARCHAR), ''))::BIGINT AS nonblank_rows, count(DISTINCT nullif(trim({c}::VARCHAR), ''))::BIGINT AS unique_values, 'drop_or_hash' AS recommended_action FROM {t}"


@query("privacy_columns", " UNION ALL ".join(_RISK.format(c=c, t="customer") for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def _(spark, d):  # P4, P5
    return profile.column_risks(table(spark, d, "customer"), _HINTS)


@query("privacy_columns_pages", " UNION ALL ".join(_RISK.format(c=c, t="pages") for c in ("page_id", "url")))
def _(spark, d):  # P4, P5
    return profile.column_risks(table(spark, d, "pages"))


def _hits_sql(parts: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{p}' AS pattern, {COUNT} AS hit_rows FROM {t} WHERE {q.pattern_hit(c, p)} HAVING count(*) > 0" for t, c, p in parts)


@query("privacy_text_hits", _hits_sql([("documents", "text", p) for p in text.PATTERNS]))
def _(spark, d):  # P7
    return profile.text_risks(table(spark, d, "documents"), ["text"], "doc_id", examples=False)


@query("privacy_text_hits_pages", _hits_sql([("pages", c, p) for c in ("html", "url") for p in text.PATTERNS]))
def _(spark, d):  # P7
    return profile.text_risks(table(spark, d, "pages"), ["html", "url"], "page_id", examples=False)


@query("privacy_text_examples")
def _(spark, d):  # P7, P8
    return profile.text_risks(table(spark, d, "documents"), ["text"], "doc_id")


@query("privacy_summary", f"SELECT (SELECT {COUNT} FROM pages) AS row_count, 2::BIGINT AS sensitive_columns, 1::BIGINT AS text_columns, (SELECT {COUNT} FROM ({_hits_sql([('pages', 'html', p) for p in text.PATTERNS])})) AS text_risk_types")
def _(spark, d):  # P11
    return profile.privacy_summary(table(spark, d, "pages"), ["html"], "page_id")


@query("mask_text", f"SELECT doc_id, {q.mask('text')} AS masked FROM documents")
def _(spark, d):  # P9; numbers are masked in mask_text_numbers
    return table(spark, d, "documents").select("doc_id", text.mask(F.col("text"), numbers=False).alias("masked"))


@query("mask_text_numbers")
def _(spark, d):  # P9
    return table(spark, d, "documents").select("doc_id", text.mask(F.col("text")).alias("masked"))


@query("mask_text_audit", f"WITH m AS (SELECT page_id, {q.squash(q.mask_audit('url'))} AS m FROM pages) SELECT page_id, substr(m, 1, 80) AS masked FROM m")
def _(spark, d):  # P8
    return table(spark, d, "pages").select("page_id", text.mask_audit(F.col("url")).alias("masked"))


@query("hash_identifier", "SELECT user_id, CASE WHEN trim(user_id::VARCHAR) = '' OR user_id IS NULL THEN '' ELSE substr(sha256('salt|' || trim(user_id::VARCHAR)), 1, 16) END AS token FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):  # P10
    return table(spark, d, "events").select("user_id").distinct().withColumn("token", scalar.hashed(F.col("user_id"), "salt"))


def _flags_sql(source: str, key: str, column: str) -> str:
    flags = ", ".join(f"{q.profile_flag('t', f)} AS {f}" for f in text.PROFILE_PATTERNS)
    return f"""WITH t AS (SELECT {key}, {q.squash(column)} AS t FROM {source}), u AS (SELECT *, {q.info_length_profile('t')}::BIGINT AS info_len, count(*) OVER (PARTITION BY t) AS duplicate_count FROM t)
SELECT {key}, info_len, t = '' AS empty_text, info_len < 6 AND t <> '' AS short_text_candidate, {q.symbol_only('t')} AS emoji_or_symbol_only, {q.bracket_only('t')} AS bracket_token_only, {q.common_low_information('t')} AS common_low_info_text,
  {flags}, duplicate_count, duplicate_count > 1 AND t <> '' AS duplicate_expression FROM u"""


@query("quality_flags", _flags_sql("documents", "doc_id", "text"))
def _(spark, d):  # P12, F3
    return profile.quality_flags(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("quality_flags_chinese", _flags_sql(f"(SELECT id::BIGINT AS id, body FROM {values(CHINESE, 'id, body')})", "id", "body"))
def _(spark, d):  # P12, F10, F11
    return profile.quality_flags(spark.createDataFrame(CHINESE, "id long, body string"), "body").drop("body")


_PROFILE = f"WITH f AS ({_flags_sql('documents', 'doc_id', 'text')}), n AS (SELECT {COUNT} AS n, (SELECT count(DISTINCT {q.squash('text')}) FROM documents)::BIGINT AS u FROM documents) SELECT metric, \"count\", round(CASE WHEN n > 0 THEN \"count\"::DOUBLE / n ELSE 0 END, 4) AS share FROM (SELECT 'rows' AS metric, n AS \"count\" FROM n UNION ALL SELECT 'unique_texts', u FROM n UNION ALL SELECT 'duplicate_extra_rows', n - u FROM n " + " ".join(f"UNION ALL SELECT '{f}', (count(*) FILTER (WHERE {f}))::BIGINT FROM f" for f in profile.FLAGS) + ") x, n"


@query("quality_profile", _PROFILE)
def _(spark, d):  # P13, A13
    return profile.quality_profile(table(spark, d, "documents"), "text")


@query(
    "flag_samples",
    f"""WITH f AS ({_flags_sql('documents', 'doc_id', 'text')}), l AS ({' UNION ALL '.join(f"SELECT '{n}' AS sample, doc_id FROM f WHERE {c}" for n, c in [('empty_text', 'empty_text'), ('short_text', 'short_text_candidate'), ('emoji_or_symbol_only', 'emoji_or_symbol_only'), ('common_low_info', 'common_low_info_text'), ('question_like', 'question_like'), ('duplicate_expression', 'duplicate_expression'), ('privacy_risk', 'contains_url OR contains_mention OR contains_email OR contains_phone_or_long_number')])})
SELECT sample, doc_id FROM l QUALIFY row_number() OVER (PARTITION BY sample ORDER BY doc_id) <= 100""",
)
def _(spark, d):  # P14
    return profile.flag_samples(profile.quality_flags(table(spark, d, "documents").select("doc_id", "text"), "text"), "doc_id")


# ---- text and scalar functions -------------------------------------------------------------------------------------


@query("clean_table_text", f"SELECT doc_id, {q.squash('text')} AS cleaned FROM documents")
def _(spark, d):  # F1
    return table(spark, d, "documents").select("doc_id", text.squash(F.col("text")).alias("cleaned"))


@query("normalize_comment", f"SELECT page_id, {q.normalize('html')} AS clean_text FROM pages")
def _(spark, d):  # F2
    return table(spark, d, "pages").select("page_id", text.normalize(F.col("html")).alias("clean_text"))


@query("info_length", f"SELECT doc_id, {q.info_length('text')}::BIGINT AS info_len_prepare, {q.info_length_profile('text')}::BIGINT AS info_len_profile FROM documents")
def _(spark, d):  # F4, F5
    return table(spark, d, "documents").select("doc_id", text.info_length(F.col("text")).alias("info_len_prepare"), text.info_length_profile(F.col("text")).alias("info_len_profile"))


@query("short_text_rules", f"SELECT id::BIGINT AS id, t AS normalized, {q.info_length('t')}::BIGINT AS info_len, {q.emoji_only('t')} AS emoji_only, {q.bracket_only('t')} AS bracket_only, {q.attitude('t')} AS attitude, {q.low_information('t')} AS low_info, {q.profile_flag('t', 'question_like')} AS question FROM (SELECT id, {q.normalize('body')} AS t FROM {values(CHINESE, 'id, body')})")
def _(spark, d):  # F2, F4, F6-F9, F11
    t = F.col("normalized")
    own = spark.createDataFrame(CHINESE, "id long, body string").select("id", text.normalize(F.col("body")).alias("normalized"))
    return own.select("id", "normalized", text.info_length(t).alias("info_len"), text.emoji_only(t).alias("emoji_only"), text.bracket_only(t).alias("bracket_only"), text.attitude(t).alias("attitude"), text.low_information(t).alias("low_info"), text.profile_flag(t, "question_like").alias("question"))


@query("detectors", f"SELECT doc_id, {', '.join(f'{q.profile_flag("text", f)} AS {f}' for f in text.PROFILE_PATTERNS)} FROM documents")
def _(spark, d):  # F11
    return table(spark, d, "documents").select("doc_id", *(text.profile_flag(F.col("text"), f).alias(f) for f in text.PROFILE_PATTERNS))


@query("detectors_pages", f"SELECT page_id, {', '.join(f'{q.profile_flag("html", f)} AS {f}' for f in text.PROFILE_PATTERNS)} FROM pages")
def _(spark, d):  # F11
    return table(spark, d, "pages").select("page_id", *(text.profile_flag(F.col("html"), f).alias(f) for f in text.PROFILE_PATTERNS))


@query("length_buckets", f"SELECT 'documents' AS origin, {q.length_bucket('text')} AS bucket, {COUNT} AS n FROM documents GROUP BY 2 UNION ALL SELECT 'conversations', {q.length_bucket('text')}, {COUNT} FROM conversations GROUP BY 2")
def _(spark, d):  # F12
    of = lambda name: table(spark, d, name).groupBy(F.lit(name).alias("origin"), text.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))
    return of("documents").union(of("conversations"))


@query("char_ngrams_topic", f"WITH t AS (SELECT conv_id, turn, {q.compact(q.replace(q.plain('text'), 'https?://[^' + q._IN + ']+'))} AS x FROM conversations), g AS (SELECT conv_id, turn, unnest({q.grams('x', 2, 4)}) AS gram FROM t) SELECT gram, {COUNT} AS n, count(DISTINCT conv_id * 1000 + turn)::BIGINT AS texts FROM g GROUP BY 1")
def _(spark, d):  # F13
    own = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.explode(text.topic_grams(F.col("text"))).alias("gram")).groupBy("k", "gram").agg(F.count("*").alias("c"))
    return own.groupBy("gram").agg(F.sum("c").alias("n"), F.count("*").alias("texts"))


_TOK = f"t AS (SELECT doc_id, {q.compact('text')} AS x FROM documents), u AS (SELECT doc_id, unnest({q.grams('x', 1, 2)}) AS gram FROM t), tok AS (SELECT doc_id, gram, {COUNT} AS c FROM u GROUP BY 1, 2)"


@query("char_ngrams_clf", f"WITH {_TOK} SELECT doc_id, gram, c FROM tok")
def _(spark, d):  # F14
    return classify.gram_counts(table(spark, d, "documents"), "doc_id", "text")


_DATES = [(1, "2026-06-01"), (2, "2026/06/01"), (3, "2026-06-01 12:30:00"), (4, "06-2026"), (5, ""), (6, None), (7, "20260601"), (8, "2026-13-01")]


@query("parse_dates", f"SELECT id::BIGINT AS id, p::DATE AS day, strftime(p, '%Y-%m') AS month FROM (SELECT id, try_strptime(trim(x), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y/%m/%d', '%Y%m%d']) AS p FROM {values(_DATES, 'id, x')})")
def _(spark, d):  # F15
    ts = scalar.parse_time(F.col("x"))
    return spark.createDataFrame(_DATES, "id long, x string").select("id", F.to_date(ts).alias("day"), scalar.month(ts).alias("month"))


_NUMBERS = [(1, "1.5"), (2, "-3"), (3, "abc"), (4, ""), (5, None), (6, "1e3")]


@query("coerce_numeric", f"SELECT id::BIGINT AS id, try_cast(x AS DOUBLE) AS value FROM {values(_NUMBERS, 'id, x')}")
def _(spark, d):  # F16
    return spark.createDataFrame(_NUMBERS, "id long, x string").select("id", scalar.number(F.col("x")).alias("value"))


_FLAGGED = [(1, "是"), (2, "No"), (3, " YES "), (4, "1.0"), (5, "0"), (6, "maybe"), (7, ""), (8, None), (9, "nan"), (10, "True"), (11, "排除")]


@query("normalize_flags", f"SELECT id::BIGINT AS id, CASE WHEN y IN {scalar.YES} THEN 'yes' WHEN y IN {scalar.NO} THEN 'no' WHEN y IN {scalar.NOTHING} THEN '' ELSE 'unknown' END AS flag, coalesce(upper(x) IN ('TRUE', '1', 'YES'), false) AS truthy FROM (SELECT id, x, lower(trim(coalesce(x, ''))) AS y FROM {values(_FLAGGED, 'id, x')})")
def _(spark, d):  # F17, F18
    return spark.createDataFrame(_FLAGGED, "id long, x string").select("id", scalar.flag(F.col("x")).alias("flag"), scalar.truthy(F.col("x")).alias("truthy"))


# ---- filters, deduplication, the table pipeline --------------------------------------------------------------------

_TERMS = ["tion", " licensed ", "der"]
_ANY = " OR ".join(f"contains(lower(coalesce(text, '')), '{t.strip()}')" for t in _TERMS)
_HITS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{t.strip()}') THEN '{t.strip()}' END" for t in _TERMS) + "], lambda x: x IS NOT NULL), '、')"


@query("filter_keyword_any", f"SELECT doc_id, {_HITS} AS hits FROM documents WHERE {_ANY}")
def _(spark, d):  # W4, W5
    return table(spark, d, "documents").filter(rows.has_keywords(F.col("text"), _TERMS)).select("doc_id", rows.keyword_hits(F.col("text"), _TERMS).alias("hits"))


@query("filter_keyword_all", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the')")
def _(spark, d):  # W4
    return table(spark, d, "documents").filter(rows.has_keywords(F.col("text"), ["TION", "the"], "all")).select("doc_id")


@query("filter_date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30 23:59:59'")
def _(spark, d):  # W3
    return table(spark, d, "orders").filter(rows.in_dates(F.col("o_orderdate"), "1996-01-01", "1996-06-30")).select("o_orderkey", "o_orderdate")


@query("filter_numeric_range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def _(spark, d):  # W14
    return table(spark, d, "orders").filter(rows.numeric_between(F.col("o_totalprice"), 100000, 200000)).select("o_orderkey")


@query("filter_category", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW')")
def _(spark, d):  # W9, W14
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey", "o_orderstatus")


@query("filter_missing", f"SELECT doc_id FROM {S} WHERE predicted_confidence IS NULL")
def _(spark, d):  # W14
    return scores(spark, d).filter("predicted_confidence IS NULL").select("doc_id")


@query("dedupe_exact", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {q.squash('text')}")
def _(spark, d):  # N2
    return rows.keep_first(table(spark, d, "documents").select("doc_id", text.squash(F.col("text")).alias("t")), ["t"], "doc_id").select("doc_id")


@query("dedupe_prefix", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr({q.squash('text')}, 1, 40)")
def _(spark, d):  # N3
    return rows.keep_first(table(spark, d, "documents").select("doc_id", F.substring(text.squash(F.col("text")), 1, 40).alias("t")), ["t"], "doc_id").select("doc_id")


@query("dedupe_exact_text", f"SELECT max(doc_id) AS doc_id FROM documents GROUP BY {q.normalize('text')}")
def _(spark, d):  # N4, N5 with the last kept
    return rows.keep_first(table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("t")), ["t"], "doc_id", last=True).select("doc_id")


@query("dedupe_source_date_text", "SELECT min(event_id) AS event_id FROM events GROUP BY event_type, ts::DATE, user_id")
def _(spark, d):  # N4
    return rows.keep_first(table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "user_id"), ["event_type", "day", "user_id"], "event_id").select("event_id")


_CONFIG = table_pipeline.Config(text_columns=["text"], primary_column="text", drop_empty_primary=True, min_chars=200, keyword_column="text", keyword_terms=_TERMS, dedupe_exact=True, dedupe_prefix=40, keep_columns=["doc_id", "text_清洗后", "命中关键词"])
_STAGED = f"""a AS (SELECT doc_id, text, {q.squash('text')} AS c FROM documents),
b AS (SELECT *, CASE WHEN c = '' THEN 0 WHEN length(c) < 200 THEN 1 WHEN NOT ({_ANY}) THEN 2 END AS s FROM a),
e AS (SELECT *, CASE WHEN s IS NULL AND row_number() OVER (PARTITION BY s IS NULL, c ORDER BY doc_id) > 1 THEN 3 ELSE s END AS s2 FROM b),
p AS (SELECT *, CASE WHEN s2 IS NULL AND row_number() OVER (PARTITION BY s2 IS NULL, substr(c, 1, 40) ORDER BY doc_id) > 1 THEN 4 ELSE s2 END AS s3 FROM e)"""
_STEPS = ["drop_empty_primary", "min_chars", "keyword_filter", "dedupe_exact", "dedupe_prefix"]


def _process(spark, d):
    return table_pipeline.process(table(spark, d, "documents"), _CONFIG, "doc_id")


@query("process_pipeline_log", f"WITH {_STAGED} " + " UNION ALL ".join(f"SELECT '{n}' AS step, (count(*) FILTER (WHERE s3 IS NULL OR s3 >= {k}))::BIGINT AS before_rows, (count(*) FILTER (WHERE s3 IS NULL OR s3 > {k}))::BIGINT AS after_rows, (count(*) FILTER (WHERE s3 = {k}))::BIGINT AS removed_rows FROM p" for k, n in enumerate(_STEPS)))
def _(spark, d):  # W1, W2, W4, N2, N3, A22
    return _process(spark, d)[2]


@query("process_pipeline_result", f"WITH {_STAGED} SELECT doc_id, c AS \"text_清洗后\", {_HITS} AS \"命中关键词\" FROM p WHERE s3 IS NULL")
def _(spark, d):  # F20, F21
    return _process(spark, d)[0]


@query("removed_rows", f"WITH {_STAGED} SELECT doc_id, ['主要列为空', '少于200字', '关键词未命中', '完全重复', '前40字重复'][s3 + 1] AS removal_reason FROM p WHERE s3 IS NOT NULL")
def _(spark, d):  # U2
    return _process(spark, d)[1].select("doc_id", F.col(table_pipeline.REASON).alias("removal_reason"))


@query("filter_min_chars", f"SELECT doc_id FROM documents WHERE length({q.squash('text')}) >= 500")
def _(spark, d):  # W2
    return table(spark, d, "documents").filter(F.length(text.squash(F.col("text"))) >= 500).select("doc_id")


# ---- preparation ---------------------------------------------------------------------------------------------------

_PREPARED = f"""n AS (SELECT doc_id, source, lang, {q.normalize('text')} AS clean_text FROM documents),
m AS (SELECT *, {q.info_length('clean_text')}::BIGINT AS info_len, {q.emoji_only('clean_text')} AS emoji, {q.attitude('clean_text')} AS att, {q.low_information('clean_text')} AS low FROM n),
r AS (SELECT *, CASE WHEN clean_text = '' THEN 0 WHEN emoji THEN 1 WHEN low AND NOT att THEN 2 WHEN info_len < 100 AND NOT att THEN 3 END AS r FROM m)"""


@query(
    "prepare_texts",
    f"WITH {_PREPARED} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, clean_text, info_len, substr(sha256('{prepare.SALT}|' || clean_text), 1, 16) AS text_hash, count(*) OVER (PARTITION BY clean_text) AS duplicate_count, substr(sha256('{prepare.SALT}|' || trim(source)), 1, 16) AS source_hash FROM r WHERE r IS NULL",
)
def _(spark, d):  # W6, N1, N7, P10
    own = prepare.prepare(table(spark, d, "documents"), "text", "doc_id", "source", drop_low_info=True, min_info_len=100)
    return own.select("row_id", "doc_id", "clean_text", "info_len", "text_hash", "duplicate_count", "source_hash")


_METRICS = [("original_rows", "count(*)"), *((f"removed_{n}_rows", f"count(*) FILTER (WHERE r = {k})") for k, n in enumerate(["empty", "emoji_only", "low_information", "below_min_info_len"])), ("removed_duplicate_rows", "count(*) FILTER (WHERE r IS NULL AND c > 1)"), ("kept_rows", "count(*) FILTER (WHERE k)"), ("short_attitude_rows_kept", "count(*) FILTER (WHERE k AND att)"), ("emoji_only_candidate_rows", "count(*) FILTER (WHERE k AND emoji)"), ("low_information_candidate_rows", "count(*) FILTER (WHERE k AND low)"), ("unique_clean_texts", "count(DISTINCT clean_text) FILTER (WHERE k)"), ("duplicate_extra_rows", "count(*) FILTER (WHERE k) - count(DISTINCT clean_text) FILTER (WHERE k)"), ("min_info_len", "100 + 0 * count(*)")]


@query("prepare_summary", f"WITH {_PREPARED}, x AS (SELECT *, row_number() OVER (PARTITION BY r IS NULL, clean_text ORDER BY doc_id) AS c FROM r), z AS (SELECT *, r IS NULL AND c = 1 AS k FROM x) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, ({e})::BIGINT AS value FROM z" for m, e in _METRICS))
def prepare_summary(spark, d):  # A23
    return prepare.summary(table(spark, d, "documents"), "text", "doc_id", min_info_len=100, drop_low_info=True, dedupe=["clean_text"])


@query("denominator_decision", f"SELECT id::BIGINT AS id, CASE WHEN e = '' THEN 'yes' ELSE 'no' END AS in_denominator, e AS exclusion_reason FROM (SELECT id, CASE WHEN t = '' THEN 'blank' WHEN {q.emoji_only('t')} THEN 'emoji_only' WHEN {q.low_information('t')} AND NOT {q.attitude('t')} THEN 'low_information' ELSE '' END AS e FROM (SELECT id, {q.normalize('body')} AS t FROM {values(CHINESE, 'id, body')}))")
def _(spark, d):  # D1
    return prepare.denominator(spark.createDataFrame(CHINESE, "id long, body string"), "body").select("id", "in_denominator", "exclusion_reason")


# ---- samples -------------------------------------------------------------------------------------------------------

_KEY = lambda seed, key: f"md5('{seed}|' || {key}::VARCHAR), {key}"


@query("random_sample", f"SELECT doc_id FROM documents ORDER BY {_KEY(42, 'doc_id')} LIMIT 200")
def _(spark, d):  # L2
    return sampling.random_sample(table(spark, d, "documents").select("doc_id"), 200, "doc_id")


@query("per_class_sample", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_KEY(42, 'doc_id')}) <= 10")
def _(spark, d):  # L3
    return sampling.per_class(table(spark, d, "documents").select("doc_id", "source"), ["source"], 10, "doc_id")


_STRATIFIED = f"s AS (SELECT doc_id AS row_id, text, source, {q.length_bucket('text')} AS bucket FROM documents), o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, bucket ORDER BY {_KEY(42, 'row_id')}) <= 5 THEN 0 ELSE 1 END AS late FROM s), z AS (SELECT * FROM o ORDER BY late, {_KEY(42, 'row_id')} LIMIT 300)"


def _seed(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", "source", text.length_bucket(F.col("text")).alias("bucket"))
    return sampling.stratified(own, ["source", "bucket"], 300, "row_id")


@query("stratified_seed", f"WITH {_STRATIFIED} SELECT row_id, source, bucket FROM z")
def _(spark, d):  # L4, J6
    return _seed(spark, d).select("row_id", "source", "bucket")


@query("prompt_batches", f"WITH {_STRATIFIED}, n AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM z) SELECT (pos // 100 + 1)::BIGINT AS batch_id, {COUNT} AS n, string_agg(row_id || chr(9) || coalesce(text, ''), chr(10) ORDER BY pos) AS prompt_payload FROM n GROUP BY 1")
def _(spark, d):  # N8
    return sampling.batches(stored(_seed(spark, d)), "row_id", "text")


@query("lowest_confidence", f"SELECT doc_id FROM {S} ORDER BY predicted_confidence NULLS FIRST, doc_id LIMIT 400")
def _(spark, d):  # N9
    return sampling.lowest(scores(spark, d), "predicted_confidence", 400, "doc_id").select("doc_id")


@query(
    "uncertain_batch",
    f"""WITH s AS {S},
e AS (SELECT doc_id, 0 AS p, 'uncertain_label' AS part, doc_id AS r FROM s WHERE predicted_label = 'uncertain'
UNION ALL SELECT doc_id, 1, 'low_confidence', r FROM (SELECT doc_id, row_number() OVER (ORDER BY predicted_confidence NULLS FIRST, doc_id) AS r FROM s) WHERE r <= 400
UNION ALL SELECT doc_id, 2, 'low_margin', r FROM (SELECT doc_id, row_number() OVER (ORDER BY top2_margin NULLS FIRST, doc_id) AS r FROM s) WHERE r <= 400
UNION ALL SELECT doc_id, 3, 'sarcasm', doc_id FROM s WHERE upper(is_sarcasm) IN ('TRUE', '1', 'YES')
UNION ALL (SELECT doc_id, 4, 'random_per_class', doc_id FROM s QUALIFY row_number() OVER (PARTITION BY predicted_label ORDER BY {_KEY(42, 'doc_id')}) <= 50)
UNION ALL (SELECT doc_id, 5, 'weak_per_class', doc_id FROM s WHERE trim(weak_label) <> '' QUALIFY row_number() OVER (PARTITION BY weak_label ORDER BY {_KEY(43, 'doc_id')}) <= 80)
UNION ALL (SELECT doc_id, 6, 'disagreement', doc_id FROM s WHERE trim(weak_label) <> '' AND weak_label <> predicted_label ORDER BY {_KEY(44, 'doc_id')} LIMIT 300)),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p, r) = 1),
u AS (SELECT f.* FROM f JOIN s USING (doc_id) QUALIFY row_number() OVER (PARTITION BY trim(coalesce(text, '')) ORDER BY p, r, doc_id) = 1)
SELECT doc_id, part FROM u ORDER BY p, r, doc_id LIMIT 1000""",
)
def _(spark, d):  # M10, U3, N11, L1
    return sampling.uncertain(scores(spark, d), "doc_id", "predicted_label", "predicted_confidence", "top2_margin", "text", "is_sarcasm", "weak_label").select("doc_id", "part")


_TARGET_WORDS = {"good": Keywords(["tion", "ment"], 200, None), "poor": Keywords(["!!", "###", "|"], None, 5000)}
_target_sql = lambda label, words, bound: f"SELECT doc_id, '{label}' AS target_label_candidate, CASE WHEN NOT weak_label = '{label}' THEN array_to_string(list_filter([{', '.join(f'''CASE WHEN contains(lower(text), '{w}') THEN '{w}' END''' for w in words)}], lambda x: x IS NOT NULL)[1:8], '|') END AS hits FROM s WHERE weak_label = '{label}' OR (({' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)}) AND {bound})"


@query("targeted_sample", f"WITH s AS (SELECT * FROM {S} WHERE length(text) >= 100), c AS ({_target_sql('good', ['tion', 'ment'], 'length(text) >= 200')} UNION ALL {_target_sql('poor', ['!!', '###', '|'], 'length(text) <= 5000')}) SELECT doc_id, target_label_candidate AS target_label, hits FROM c QUALIFY row_number() OVER (PARTITION BY target_label_candidate ORDER BY {_KEY(42, 'doc_id')}) <= 100")
def _(spark, d):  # L6, W7, W8, U4
    own = sampling.targeted(scores(spark, d), "doc_id", "text", _TARGET_WORDS, ["good", "poor"], "weak_label", 100, min_chars=100)
    return own.select("doc_id", F.col("target_label_candidate").alias("target_label"), F.col("target_keyword_hits").alias("hits"))


# ---- labels --------------------------------------------------------------------------------------------------------

#: Labels as they come back: some ids twice, some labels not valid.
GIVEN = f"doc_id AS row_id, {GOOD} AS label, 0.5 + CAST(doc_id % 50 AS DOUBLE) / 100 AS confidence, doc_id * 2 AS pos"
AGAIN = "doc_id AS row_id, CASE WHEN doc_id % 5 = 0 THEN 'bogus' WHEN toxic = 1 THEN 'poor' ELSE 'good' END AS label, 0.9 AS confidence, doc_id * 2 + 1 AS pos"
_GIVEN = f"given AS (SELECT {GIVEN} FROM labels UNION ALL SELECT {AGAIN} FROM labels WHERE quality = 0), ok AS (SELECT * FROM given WHERE label IN ('good', 'poor')), one AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pos DESC) = 1)"


def _merge(spark, d):
    own = table(spark, d, "labels")
    given = own.selectExpr(*_split(GIVEN)).union(own.filter("quality = 0").selectExpr(*[c.replace("0.9 AS", "0.9D AS") for c in _split(AGAIN)]))
    return labels.merge(table(spark, d, "documents").selectExpr("doc_id AS row_id", "n_chars"), given, ["good", "poor"], "pos")


@query("merge_reviewed", f"WITH {_GIVEN} SELECT doc_id AS row_id, label, confidence FROM documents LEFT JOIN one ON doc_id = row_id")
def _(spark, d):  # J1, N5
    return _merge(spark, d).merged.select("row_id", "label", F.round("confidence", 6).alias("confidence"))


@query("invalid_labels", f"WITH {_GIVEN} SELECT row_id::VARCHAR AS row_id, label FROM given WHERE label NOT IN ('good', 'poor')")
def _(spark, d):  # W9
    return _merge(spark, d).invalid.select("row_id", "label")


@query("duplicate_row_ids", f"WITH {_GIVEN} SELECT row_id::VARCHAR AS row_id, label, pos FROM ok WHERE row_id IN (SELECT row_id FROM ok GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):  # N5
    return _merge(spark, d).duplicates.select("row_id", "label", "pos")


@query("missing_ids", f"WITH {_GIVEN} SELECT DISTINCT doc_id::VARCHAR AS row_id FROM documents WHERE doc_id NOT IN (SELECT row_id FROM one)")
def _(spark, d):  # J2, U5
    return _merge(spark, d).missing


@query("label_quality_summary", f"WITH {_GIVEN} SELECT 'prepared_rows' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'valid_label_rows', count(*) FROM ok UNION ALL SELECT 'invalid_label_rows', count(*) FROM given WHERE label NOT IN ('good', 'poor') UNION ALL SELECT 'duplicate_row_ids', count(*) FROM (SELECT row_id FROM ok GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_row_ids', count(*) FROM documents WHERE doc_id NOT IN (SELECT row_id FROM one) UNION ALL SELECT 'mean_confidence', round(avg(confidence), 4) FROM one")
def _(spark, d):  # A12, G16
    return _merge(spark, d).summary


@query("propagate_labels", f"WITH r AS (SELECT trim(text) AS k, label FROM {R} WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) = 1) SELECT doc_id, label, CASE WHEN label IS NOT NULL THEN 'reviewed_expression_mapped' END AS label_source FROM documents LEFT JOIN r ON trim(text) = k")
def _(spark, d):  # J3, N6
    return labels.propagate(table(spark, d, "documents").select("doc_id", "text"), reviewed(spark, d), "text", "doc_id", confidence=None).select("doc_id", "label", "label_source")


@query("duplicate_label_keys", f"SELECT doc_id, label FROM {R} WHERE trim(text) IN (SELECT trim(text) FROM {R} GROUP BY 1 HAVING count(*) > 1) AND trim(text) <> ''")
def _(spark, d):  # N6
    return labels.duplicate_keys(reviewed(spark, d), "text").select("doc_id", "label")


@query("final_label", f"SELECT doc_id, coalesce({GOOD.replace('ELSE', 'WHEN 0 THEN')}, nullif(weak_label, ''), predicted_label) AS final_label, CASE WHEN quality IS NOT NULL THEN 'human' WHEN weak_label <> '' THEN 'ai_reviewed' ELSE 'classifier' END AS label_source FROM {S} LEFT JOIN labels USING (doc_id)")
def _(spark, d):  # D2
    own = scores(spark, d).join(table(spark, d, "labels").selectExpr("doc_id", f"{GOOD} AS human"), "doc_id", "left")
    return labels.final_label(own, "human", "weak_label", "predicted_label").select("doc_id", "final_label", "label_source")


# ---- classifiers ---------------------------------------------------------------------------------------------------

_LAB = f"lab AS (SELECT doc_id, {GOOD} AS label FROM labels JOIN documents USING (doc_id))"
_MODEL = f"{_TOK}, {_LAB}, model AS (SELECT label, gram, sum(c)::BIGINT AS n FROM tok JOIN lab USING (doc_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, gram) <= 3500)"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").selectExpr("doc_id", f"{GOOD} AS label")


@query("nb_model_tokens", f"WITH {_MODEL} SELECT label, gram, n FROM model")
def _(spark, d):  # A18, M5
    docs, own = _labelled(spark, d)
    return classify.model_tokens(docs, "doc_id", "text", "label", own)


@query(
    "nb_predict",
    f"""WITH {_MODEL}, vocab AS (SELECT DISTINCT gram FROM model), tot AS (SELECT label, sum(n) + (SELECT count(*) FROM vocab) AS den FROM model GROUP BY 1),
cls AS (SELECT label, den, prior FROM (SELECT label, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS prior FROM lab GROUP BY 1) JOIN tot USING (label)),
sc AS (SELECT doc_id, cls.label, any_value(prior) + sum(c * ln((coalesce(n, 0) + 1)::DOUBLE / den)) AS s FROM tok SEMI JOIN vocab USING (gram) CROSS JOIN cls LEFT JOIN model ON model.gram = tok.gram AND model.label = cls.label GROUP BY 1, 2),
al AS (SELECT d.doc_id, cls.label, coalesce(s, prior) AS s FROM documents d CROSS JOIN cls LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.label = cls.label),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS k FROM al),
p AS (SELECT doc_id, max(label) FILTER (WHERE k = 1) AS predicted_label, round(max(e) FILTER (WHERE k = 1) / sum(e), 4) AS predicted_confidence, round((max(e) FILTER (WHERE k = 1) - max(e) FILTER (WHERE k = 2)) / sum(e), 4) AS top2_margin FROM w GROUP BY 1)
SELECT *, predicted_confidence < 0.6 OR top2_margin < 0.15 AS needs_review, 'fast-nb' AS classifier_backend FROM p""",
)
def _(spark, d):  # M6, M8, M9, W10, W13, J7
    docs, own = _labelled(spark, d)
    return classify.train_and_score(docs, "doc_id", "text", "label", "nb", own)


@query("lr_predict")
def _(spark, d):  # M7; tests hold it against the objective's gradient
    docs, own = _labelled(spark, d)
    return classify.train_and_score(docs, "doc_id", "text", "label", "lr", own)


@query("needs_review", f"SELECT doc_id, coalesce(predicted_confidence < 0.6 OR top2_margin < 0.15, false) AS needs_review FROM {S}")
def _(spark, d):  # W13
    return scores(spark, d).select("doc_id", F.coalesce(classify.needs_review(), F.lit(False)).alias("needs_review"))


# ---- topics --------------------------------------------------------------------------------------------------------

_CONV = "(SELECT conv_id * 1000 + turn AS id, text FROM conversations)"
_TERM = f"t AS (SELECT id, {q.compact(q.replace(q.plain('text'), 'https?://[^' + q._IN + ']+'))} AS x FROM {_CONV}), g AS (SELECT id, unnest({q.grams('x', 2, 4)}) AS gram FROM t), tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY 1, 2), voc AS (SELECT gram, {COUNT} AS df FROM tf GROUP BY 1 ORDER BY df DESC, gram LIMIT 1200), vocab AS (SELECT *, ln((1.0::DOUBLE + (SELECT count(*) FROM t)) / (1 + df)) + 1 AS idf FROM voc), w AS (SELECT id, gram, tf * idf AS w FROM tf JOIN vocab USING (gram)), vec AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)"
_TOPIC = f"{_TERM}, init AS (SELECT id, row_number() OVER (ORDER BY {_KEY(42, 'id')}) - 1 AS topic FROM t QUALIFY topic < 4), su AS (SELECT topic, gram, sum(w) AS w FROM vec JOIN init USING (id) GROUP BY 1, 2), cen AS (SELECT topic, gram, w / sqrt(sum(w * w) OVER (PARTITION BY topic)) AS w FROM su), dots AS (SELECT id, topic, round(sum(vec.w * cen.w), 9) AS cos FROM vec JOIN cen USING (gram) GROUP BY 1, 2), near AS (SELECT id, topic, cos FROM dots QUALIFY row_number() OVER (PARTITION BY id ORDER BY cos DESC, topic) = 1), asg AS (SELECT t.id, coalesce(topic, 0) AS topic, 1 - coalesce(cos, 0) AS distance FROM t LEFT JOIN near USING (id))"


def _conversations(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _vocabulary(spark, d):
    own = _conversations(spark, d)
    counts = topics.term_counts(own, "id", "text")
    return own, counts, topics.vocabulary(counts, own.count())


def _vectors(spark, d):
    own, counts, vocab = _vocabulary(spark, d)
    return own, topics.vectors(counts, vocab, "id")


@query("tfidf_top_terms", f"WITH {_TERM} SELECT gram, df, round(idf, 6) AS idf FROM vocab")
def _(spark, d):  # M1, A17
    return _vocabulary(spark, d)[2].select("gram", "df", F.round("idf", 6).alias("idf"))


@query("topic_centroids_1iter", f"WITH {_TOPIC} SELECT topic, gram, round(w, 6) AS w FROM cen")
def _(spark, d):  # A19
    own, vecs = _vectors(spark, d)
    return topics.centroids(vecs, topics.initial(own, vecs, "id", 4)).select("topic", "gram", F.round("w", 6).alias("w"))


def _assigned(spark, d):
    own, vecs = _vectors(spark, d)
    return own, vecs, stored(topics.assign(vecs, topics.initial(own, vecs, "id", 4), "id"))


@query("topic_assign_1iter", f"WITH {_TOPIC} SELECT id, topic, round(distance, 4) AS distance FROM asg")
def _(spark, d):  # M2, J8
    return _assigned(spark, d)[2].select("id", "topic", F.round("distance", 4).alias("distance"))


@query("topic_summary_1iter", f"WITH {_TOPIC}, ta AS (SELECT topic, gram, round(sum(w), 6) AS v FROM vec JOIN asg USING (id) GROUP BY 1, 2), tw AS (SELECT topic, gram, v AS w FROM ta QUALIFY row_number() OVER (PARTITION BY topic ORDER BY v DESC, gram) <= 12) SELECT topic, count, round(count::DOUBLE / sum(count) OVER (), 4) AS share, top_terms FROM (SELECT topic, {COUNT} AS count FROM asg GROUP BY 1) LEFT JOIN (SELECT topic, string_agg(gram, '、' ORDER BY w DESC, gram) AS top_terms FROM tw GROUP BY 1) USING (topic)")
def _(spark, d):  # M4, N10
    own, vecs, asg = _assigned(spark, d)
    return topics.summary(own, vecs, asg, "id", "text").drop("examples")


@query("topic_examples_1iter", f"WITH {_TOPIC} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(distance, 9), id) AS place, id FROM asg QUALIFY place <= 3")
def _(spark, d):  # N10
    return topics.nearest(_assigned(spark, d)[2], "id")


def _stored_vectors(spark, d):
    own, vecs = _vectors(spark, d)
    return own, stored(vecs)  # read in each round


@query("topics_kmeans")
def _(spark, d):  # M2
    own, vecs = _stored_vectors(spark, d)
    return topics.kmeans(own, vecs, "id", 4, stored).select("id", "topic", F.round("distance", 4).alias("distance"))


@query("topic_summary")
def _(spark, d):  # M4, N10, of the clustering and not its first round
    own, vecs = _stored_vectors(spark, d)
    return topics.summary(own, vecs, topics.choose_k(own, vecs, "id", stored)[1], "id", "text").drop("examples")


@query("topic_examples")
def _(spark, d):  # N10
    own, vecs = _stored_vectors(spark, d)
    return topics.nearest(topics.choose_k(own, vecs, "id", stored)[1], "id")


@query("choose_k")
def _(spark, d):  # M3
    own, vecs = _stored_vectors(spark, d)
    k, _, tried = topics.choose_k(own, vecs, "id", stored)
    return spark.createDataFrame([(a, round(s, 4), a == k) for a, s in tried] or [(k, None, True)], "k long, score double, chosen boolean")


@query("embedding_clusters")
def _(spark, d):  # D5
    return topics.embedding_clusters(table(spark, d, "embeddings"), "vec_id", "embedding")


# ---- reports -------------------------------------------------------------------------------------------------------

_T = f"(SELECT unnest({TARGETS!r}) AS label)"
_DIST = lambda source, label: f"SELECT label, count, round(CASE WHEN sum(count) OVER () > 0 THEN count::DOUBLE / sum(count) OVER () ELSE 0 END, 4) AS share FROM (SELECT label, coalesce(c, 0)::BIGINT AS count FROM {_T} FULL JOIN (SELECT coalesce({label}, '') AS label, count(*) AS c FROM {source} GROUP BY 1) USING (label))"


@query("round_distribution", _DIST(S, "predicted_label"))
def _(spark, d):  # A1
    return reports.distribution(scores(spark, d), "predicted_label", TARGETS)


@query("overall_distribution", "SELECT label, count, round(count::DOUBLE / sum(count) OVER (), 4) AS share FROM (SELECT label, count(o_orderkey)::BIGINT AS count FROM (SELECT unnest(['F', 'O', 'X']) AS label) LEFT JOIN orders ON o_orderstatus = label GROUP BY 1)")
def _(spark, d):  # A2, V3
    return reports.effective_distribution(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("overall_risk", "SELECT round((count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE / count(*), 4) AS risk_share FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(spark, d):  # A14, V5
    return reports.risk(reports.effective_distribution(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]), ["F"])


@query(
    "label_coverage",
    f"""WITH c AS (SELECT CASE WHEN l IN ('good', 'poor', 'mixed') THEN l ELSE '__unknown_or_non_target__' END AS label, {COUNT} AS count FROM (SELECT coalesce(trim(predicted_label), 'nan') AS l FROM {S}) GROUP BY 1),
a AS (SELECT label, coalesce(count, 0) AS count FROM {_T} LEFT JOIN c USING (label)), s AS (SELECT *, round(CASE WHEN sum(count) OVER () > 0 THEN count::DOUBLE / sum(count) OVER () ELSE 0 END, 4) AS share FROM a)
SELECT label, count, share, CASE WHEN share > 0.8 THEN 'audit_required' WHEN count < 20 THEN 'needs_targeted_sampling' ELSE 'ok' END AS status FROM s UNION ALL SELECT label, count, NULL, 'review_labels' FROM c WHERE label = '__unknown_or_non_target__'""",
)
def _(spark, d):  # A3, G2
    return reports.coverage(scores(spark, d), "predicted_label", TARGETS).drop("note")


@query("crosstab_status_priority", f"SELECT o_orderstatus AS row_label, o_orderpriority AS col_label, {COUNT} AS n FROM orders GROUP BY 1, 2")
def _(spark, d):  # A5
    return reports.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


_MONTHS = "b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS label, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2), m AS (SELECT month, label, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT month FROM b) CROSS JOIN (SELECT DISTINCT label FROM b) LEFT JOIN b USING (month, label))"


@query("monthly_shares", f"WITH {_MONTHS} SELECT month, label, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY month), 4) AS share FROM m")
def _(spark, d):  # A6, V4
    return reports.monthly_or_note(table(spark, d, "orders"), "o_orderdate", "o_orderstatus", ["F", "O", "P"])


@query("monthly_risk", f"WITH {_MONTHS} SELECT month, round((sum(n) FILTER (WHERE label = 'F'))::DOUBLE / sum(n), 4) AS risk_share FROM m GROUP BY 1")
def _(spark, d):  # A14, V5
    return reports.risk_by_month(reports.monthly(table(spark, d, "orders"), "o_orderdate", "o_orderstatus", ["F", "O", "P"]), ["F"])


@query("monthly_skipped", "SELECT 'no usable date column' AS note")
def _(spark, d):  # V6
    return reports.monthly_or_note(table(spark, d, "orders"), None, "o_orderstatus", ["F"])


_TRANS = f"tr AS (SELECT b.predicted_label AS previous_label, s.predicted_label AS current_label, {COUNT} AS n FROM {B} b JOIN {S} s USING (doc_id) GROUP BY 1, 2), rt AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY previous_label), 4) AS rate FROM tr)"


@query("round_transitions", f"WITH {_TRANS} SELECT * FROM rt")
def _(spark, d):  # J4, A7
    return reports.transitions(scores(spark, d), before(spark, d), "doc_id", "predicted_label")


@query("round_confidence", f"WITH s AS {S} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({e}, 4)::DOUBLE AS value FROM s" for m, e in [("confidence_mean", "avg(predicted_confidence)"), ("confidence_median", "median(predicted_confidence)"), ("confidence_lt_0_6_share", "avg(coalesce(predicted_confidence < 0.6, false)::INT)"), ("confidence_lt_0_4_share", "avg(coalesce(predicted_confidence < 0.4, false)::INT)"), ("top2_margin_mean", "avg(top2_margin)"), ("top2_margin_lt_0_15_share", "avg(coalesce(top2_margin < 0.15, false)::INT)")]))
def _(spark, d):  # A10, W12
    return reports.confidence_summary(scores(spark, d), "predicted_confidence", "top2_margin")


@query("category_top_n", f"SELECT coalesce(event_type, '空值') AS category, {COUNT} AS n FROM events GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def _(spark, d):  # A15, V1
    return reports.top_categories(table(spark, d, "events"), "event_type")


@query("daily_trend", f"SELECT ts::DATE AS day, {COUNT} AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def _(spark, d):  # A16, V2
    return reports.daily(table(spark, d, "events"), "ts")


@query("label_agreement", f"SELECT {COUNT} AS total_rows, {COUNT} AS usable_rows, (count(*) FILTER (WHERE label = predicted_label))::BIGINT AS matched_rows, round(avg((label = predicted_label)::INT), 4) AS agreement_rate, round((count(*) FILTER (WHERE label <> predicted_label))::DOUBLE / count(*), 4) AS error_rate FROM {R}")
def _(spark, d):  # A11, G15, W11
    return reports.agreement(reviewed(spark, d), "label", "predicted_label")


@query("confusion", f"SELECT label AS row_label, predicted_label AS col_label, {COUNT} AS n FROM {R} GROUP BY 1, 2")
def _(spark, d):  # G15
    return reports.confusion(reviewed(spark, d), "label", "predicted_label")


@query("disagreement_sample", f"SELECT doc_id, label, predicted_label FROM {R} WHERE label <> predicted_label ORDER BY {_KEY(42, 'doc_id')} LIMIT 200")
def _(spark, d):  # L5
    return reports.disagreements(reviewed(spark, d), "label", "predicted_label", "doc_id").select("doc_id", "label", "predicted_label")


@query("top_terms", f"SELECT term, {COUNT} AS n FROM (SELECT unnest(string_split(lower({q.squash('text')}), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def _(spark, d):  # D4
    return reports.top_terms(table(spark, d, "documents"), "text")


@query("grouped_summary", f"SELECT o_orderpriority, {COUNT} AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders GROUP BY 1")
def _(spark, d):  # D4
    return reports.grouped(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("outliers_iqr", "WITH z AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, z WHERE l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a)")
def _(spark, d):  # D4
    return rows.outliers_iqr(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.5)


@query("fuzzy_pairs", "WITH v AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS p_name_a, b.p_name AS p_name_b, levenshtein(a.p_name, b.p_name)::BIGINT AS distance FROM v a JOIN v b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 4")
def _(spark, d):  # D4
    return rows.fuzzy_pairs(table(spark, d, "part").select("p_name").distinct(), "p_name", "p_name", 4)


# ---- gates ---------------------------------------------------------------------------------------------------------

_AUDIT = f"WITH r AS {R}, c AS (SELECT label, {COUNT} AS n FROM r GROUP BY 1), t AS (SELECT label, round(n::DOUBLE / sum(n) OVER (), 4) AS s FROM c ORDER BY n DESC, label LIMIT 1), u AS (SELECT count(*) AS n, count(DISTINCT trim(text)) AS u FROM r) "


@query(
    "batch_audit",
    _AUDIT + "SELECT 'rows' AS metric, n::DOUBLE AS value, 'info' AS status FROM u UNION ALL SELECT 'duplicate_extra_rows', n - u, CASE WHEN (n - u)::DOUBLE / n > 0.3 THEN 'dedupe_review_batch' ELSE 'ok' END FROM u UNION ALL SELECT 'duplicate_expression_share', round((n - u)::DOUBLE / n, 4), CASE WHEN (n - u)::DOUBLE / n > 0.3 THEN 'dedupe_review_batch' ELSE 'ok' END FROM u UNION ALL SELECT 'top_label', NULL, 'info' FROM t UNION ALL SELECT 'top_label_share', s, CASE WHEN s > 0.8 THEN 'pause_before_training' ELSE 'ok' END FROM t UNION ALL SELECT 'label_count:' || label, n, 'info' FROM c",
)
def _(spark, d):  # G1, A8, A9
    return gates.batch_audit(reviewed(spark, d), "label", "text").drop("note")


@query(
    "diagnose_predictions",
    f"""WITH s AS (SELECT *, coalesce(predicted_confidence < 0.6, true) AS low, coalesce(top2_margin < 0.15, true) AS near, trim(coalesce(text, '')) AS k FROM {S}), n AS (SELECT count(*) AS n FROM s)
SELECT 'rows' AS metric, n::DOUBLE AS value, 'info' AS status FROM n UNION ALL SELECT 'low_confidence_share', round(avg(low::INT), 4), CASE WHEN avg(low::INT) > 0.9 THEN 'diagnose_before_iterating' ELSE 'ok' END FROM s UNION ALL SELECT 'low_margin_share', round(avg(near::INT), 4), 'info' FROM s
UNION ALL SELECT 'duplicate_extra_share', round((count(*) - count(DISTINCT k))::DOUBLE / count(*), 4), 'info' FROM s UNION ALL SELECT 'low_conf_unique_texts', count(DISTINCT k), 'info' FROM s WHERE low UNION ALL SELECT 'low_conf_duplicate_extra_rows', count(*) - count(DISTINCT k), 'info' FROM s WHERE low
UNION ALL SELECT 'label_share:' || predicted_label, round(count(*)::DOUBLE / any_value(n), 4), 'info' FROM s, n GROUP BY predicted_label""",
)
def _(spark, d):  # G3, W12, A9
    return gates.diagnosis(scores(spark, d), "predicted_label", "predicted_confidence", "top2_margin", "text").drop("note")


@query(
    "round_audit",
    f"""WITH s AS {S}, c AS (SELECT predicted_label AS l, count(*) AS n FROM s GROUP BY 1), g AS (SELECT count(*) AS n, string_agg(label, ',' ORDER BY label) AS l FROM {_T} WHERE label NOT IN (SELECT l FROM c))
SELECT 'rows' AS metric, count(*)::DOUBLE AS value, 'info' AS status, '' AS note FROM s UNION ALL SELECT 'duplicate_extra_share', round((count(*) - count(DISTINCT trim(text)))::DOUBLE / count(*), 4), CASE WHEN (count(*) - count(DISTINCT trim(text)))::DOUBLE / count(*) > 0.3 THEN 'dedupe_review_batch' ELSE 'info' END, '' FROM s
UNION ALL (SELECT 'top_label_share', round(n::DOUBLE / sum(n) OVER (), 4), CASE WHEN n::DOUBLE / sum(n) OVER () > 0.8 THEN 'pause_and_audit' ELSE 'ok' END, 'top_label=' || l FROM c ORDER BY n DESC, l LIMIT 1)
UNION ALL SELECT 'missing_target_labels', n, CASE WHEN n > 0 THEN 'supplement_before_training' ELSE 'ok' END, coalesce(l, '') FROM g
UNION ALL SELECT 'low_confidence_share', round(avg(coalesce(predicted_confidence < 0.6, true)::INT), 4), CASE WHEN avg(coalesce(predicted_confidence < 0.6, true)::INT) > 0.9 THEN 'diagnose_not_iterate_mechanically' ELSE 'info' END, '' FROM s UNION ALL SELECT 'low_margin_share', round(avg(coalesce(top2_margin < 0.15, true)::INT), 4), 'info', '' FROM s""",
)
def _(spark, d):  # G4
    return gates.round_audit(scores(spark, d), "predicted_label", "predicted_confidence", "top2_margin", "text", TARGETS)


@query("gate_coverage", f"SELECT label, count AS reviewed_count, CASE WHEN label IN ('good', 'poor', 'mixed') THEN 20::BIGINT END AS min_required, CASE WHEN label NOT IN ('good', 'poor', 'mixed') THEN 'extra_label' WHEN count >= 20 THEN 'ok' ELSE 'insufficient' END AS status FROM ({_DIST(R, 'label')})")
def _(spark, d):  # A4, G6
    return reports.reviewed_coverage(reviewed(spark, d), "label", TARGETS)


_PART = lambda source: f"(SELECT label, coalesce(c, 0)::DOUBLE / (SELECT count(*) FROM {source} x) AS s FROM {_T} FULL JOIN (SELECT predicted_label AS label, count(*) AS c FROM {source} y GROUP BY 1) USING (label))"


@query("gate_delta", f"SELECT label, round(p, 6) AS previous_share, round(c, 6) AS current_share, round(c - p, 6) AS delta, round(abs(c - p), 6) AS abs_delta, CASE WHEN abs(c - p) > 0.05 THEN 'changed_too_much' ELSE 'ok' END AS status FROM (SELECT label, coalesce(a.s, 0) AS p, coalesce(b.s, 0) AS c FROM {_PART(B)} a FULL JOIN {_PART(S)} b USING (label)) WHERE label IN (SELECT label FROM {_T})")
def _(spark, d):  # G8, U6
    return gates.distribution_delta(scores(spark, d), before(spark, d), "predicted_label", TARGETS)


@query("gate_transitions", f"WITH {_TRANS} SELECT *, CASE WHEN previous_label <> current_label AND n::DOUBLE / sum(n) OVER (PARTITION BY previous_label) > 0.2 THEN 'drift' ELSE 'ok' END AS status FROM rt")
def _(spark, d):  # G9, A7
    return gates.transition_drift(scores(spark, d), before(spark, d), "doc_id", "predicted_label")


@query("gate_audit", f"SELECT {COUNT} AS audit_rows, (count(*) FILTER (WHERE label <> predicted_label))::BIGINT AS error_rows, round((count(*) FILTER (WHERE label <> predicted_label))::DOUBLE / count(*), 4) AS error_share, CASE WHEN (count(*) FILTER (WHERE label <> predicted_label))::DOUBLE / count(*) > 0.15 THEN 'too_many_errors' ELSE 'ok' END AS status, 0.15::DOUBLE AS max_error_share FROM {R}")
def _(spark, d):  # G10
    return gates.audit_agreement(reviewed(spark, d), "predicted_label", "label")


_BLOCKED = [(1, ""), (2, "missing_audit_labels"), (3, "label_transition_drift"), (4, "new_batch_imbalanced,insufficient_label_coverage"), (5, "high_low_confidence_needs_audit,audit_error_too_high"), (6, "not_enough_review_rounds"), (7, "distribution_not_stable,missing_target_labels"), (8, "audit_error_too_high"), (9, "missing_previous_predictions"), (10, "missing_target_labels")]


@query("gate_decision", f"SELECT id::BIGINT AS id, CASE WHEN codes = '' THEN 'candidate_stop' WHEN list_has_any(string_split(codes, ','), {list(gates.AUDIT)}) THEN 'audit_needed' WHEN list_has_any(string_split(codes, ','), {list(gates.CONTINUE)}) THEN 'continue' ELSE 'incomplete' END AS status FROM {values(_BLOCKED, 'id, codes')}")
def _(spark, d):  # G12
    codes = F.filter(F.split("codes", ","), lambda x: x != "")
    return spark.createDataFrame(_BLOCKED, "id long, codes string").select("id", gates.decide(codes).alias("status"))


@query("convergence_reasons")
def _(spark, d):  # G5-G11; tests hold it against the gates' own tables
    own, old, done = scores(spark, d), before(spark, d), reviewed(spark, d)
    status, out = gates.convergence(own, TARGETS, "doc_id", previous=old, reviewed=done, new_batch=done, audit=done, rounds=1)
    return out.withColumn("decision", F.lit(status))


_FINAL = [(1, "good", "是", ""), (1, "", "否", "spam"), (2, "good", "yes", ""), (2, "", "no", ""), (3, "", "yes", ""), (4, "", "no", "spam"), (5, "good", "yes", ""), (5, "good", "maybe", ""), (5, "good", "", ""), (6, "good", "1.0", None), (6, None, "0.0", "blank")]
_GATE = [("excluded_rows_missing_reason", "excluded_missing_reason > 0"), ("effective_rows_missing_label", "effective_missing_label > 0"), ("zero_effective_denominator", "effective_rows = 0"), ("unknown_or_blank_denominator_flags", "unknown_flag_rows > 0")]


@query(
    "denominator_gate",
    f"""WITH f AS (SELECT case_id::BIGINT AS case_id, CASE WHEN lower(trim(coalesce(flag, ''))) IN {scalar.YES} THEN 'yes' WHEN lower(trim(coalesce(flag, ''))) IN {scalar.NO} THEN 'no' ELSE '' END AS f, lower(trim(coalesce(label, ''))) IN {scalar.NOTHING} AS l, lower(trim(coalesce(reason, ''))) IN {scalar.NOTHING} AS r FROM {values(_FINAL, 'case_id, label, flag, reason')}),
c AS (SELECT case_id, {COUNT} AS total_rows, (count(*) FILTER (WHERE f = 'yes'))::BIGINT AS effective_rows, (count(*) FILTER (WHERE f = 'no'))::BIGINT AS excluded_rows, (count(*) FILTER (WHERE f = ''))::BIGINT AS unknown_flag_rows, (count(*) FILTER (WHERE f = 'no' AND r))::BIGINT AS excluded_missing_reason, (count(*) FILTER (WHERE f = 'yes' AND l))::BIGINT AS effective_missing_label FROM f GROUP BY 1),
p AS (SELECT *, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _GATE)}], lambda x: x IS NOT NULL)), ';') AS problem_codes FROM c) SELECT *, CASE WHEN problem_codes = '' THEN 'pass' ELSE 'fail' END AS status FROM p""",
)
def _(spark, d):  # G13, A21, F17, F22
    return gates.denominator_counts(spark.createDataFrame(_FINAL, "case_id long, label string, flag string, reason string"), "label", "flag", "reason", ["case_id"])


_CHECKS = [(1, "pass"), (1, "pass"), (2, "warn"), (2, "pass"), (3, "warn"), (3, "fail"), (4, "fail")]


@query("package_checks", f"SELECT case_id::BIGINT AS case_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS overall FROM {values(_CHECKS, 'case_id, status')} GROUP BY 1")
def _(spark, d):  # G14
    return spark.createDataFrame(_CHECKS, "case_id long, status string").groupBy("case_id").agg(gates.verdict(F.collect_set("status")).alias("overall"))
