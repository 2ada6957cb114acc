"""Queries of the core operators over a directory of tables, with their SQL equivalents.

Doubles are rounded to six places on both sides, as engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import oracles
from turnwise.functions import text as T
from turnwise.functions.dates import parse_created_at
from turnwise.operators import aggregates, category, judge, layers, raw_summary, reshape, sampling, segments, skew, trends
from turnwise.operators.language import detect
from turnwise.session import scratch, spread, stash
from turnwise.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

METRICS = ("layer_a_segment_count", "layer_a_malformed_timestamp_ratio", "layer_a_duration_covered_seconds", "layer_b_total_tokens")
DURATION = "layer_a_duration_covered_seconds"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _read(s: SparkSession, d: str, table: str = "sample_multiline") -> DataFrame:
    return s.read.parquet(f"{d}/{table}.parquet")


def _texts(s: SparkSession, d: str, table: str = "sample_multiline") -> DataFrame:
    return spread(_read(s, d, table))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded as DuckDB's ``round`` does: the product with 10^places to a whole number, halves away from zero.

    Spark's own takes the printed number instead, and so parts from it on ties such as 0.0320655, and gives zero no sign: what is
    below zero and rounds to zero is -0.0.
    """
    unit = 10.0**places

    def nearest(c: str) -> Column:
        scaled = F.col(c) * unit
        return F.when(F.abs(scaled) < float("inf"), F.signum(c) * F.round(F.abs(scaled)) / unit).otherwise(F.col(c))

    return df.withColumns({f"{c}": nearest(c) for c, t in df.dtypes if t == "double"})


_AT = "CASE WHEN regexp_full_match(created_at, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN try_strptime(created_at, '%Y-%m-%d %H:%M:%S') END"
_AT_TRIMMED = _AT.replace("created_at", "trim(created_at)")

# ---- heavy keys ----

_query(
    "p1_found",
    """SELECT telegram_user_internal_id FROM sample_multiline WHERE trim(telegram_user_internal_id) <> ''
       GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM sample_multiline)""",
)(lambda s, d: skew.heavy_users(_read(s, d)))
_query(
    "p1_users",
    f"""WITH rows_ AS (SELECT CASE WHEN trim(telegram_user_internal_id) <> '' THEN telegram_user_internal_id END AS u, coalesce(id, '') AS id, {_AT} AS t FROM sample_multiline),
        s AS (SELECT u, id, t, epoch(t) - lag(epoch(t)) OVER w AS pause, lag(id) OVER w = id AND lag(t) OVER w IS NOT DISTINCT FROM t AS same
              FROM rows_ WINDOW w AS (PARTITION BY u ORDER BY t NULLS FIRST, id))
        SELECT u AS telegram_user_internal_id, count(*) AS n_rows, count(*) - count(*) FILTER (same) AS n_transcripts, min(t) AS first_at, max(t) AS last_at,
               CASE WHEN max(t) IS NULL THEN 0 ELSE 1 + count(*) FILTER (pause > 21600) END AS n_sessions, CAST(max(pause) AS BIGINT) AS max_pause_s
        FROM s GROUP BY u""",
)(lambda s, d: skew.user_activity(_read(s, d)))

# ---- buckets and shares ----

_BUCKETS = {"day": ("bucket_day", "date_trunc('day', created_at_parsed)::TIMESTAMP"), "iso_week": ("bucket_iso_week", "strftime(created_at_parsed, '%G-W%V')"), "month": ("bucket_month", "date_trunc('month', created_at_parsed)::TIMESTAMP")}


def _features(s: SparkSession, d: str) -> DataFrame:
    return aggregates.add_buckets(_read(s, d, "feature_rows").withColumn("created_at_parsed", F.col("created_at_parsed").cast("timestamp_ntz")).filter(F.col("created_at_parsed").isNotNull()).drop("bucket_day"))


def _quantile_sql(m: str) -> str:
    return f"round(median({m}), 6) AS {m}_median, round(quantile_cont({m}, 0.25), 6) AS {m}_q1, round(quantile_cont({m}, 0.75), 6) AS {m}_q3"


for _name, (_column, _expr) in _BUCKETS.items():
    _query(
        f"bucket_{_name}_quantiles",
        f"SELECT {_expr} AS {_column}, count(*) AS n_rows, {', '.join(map(_quantile_sql, METRICS))} FROM feature_rows WHERE created_at_parsed IS NOT NULL GROUP BY 1",
    )(lambda s, d, c=_column: rounded(aggregates.aggregate_buckets(_features(s, d), c, METRICS)))
    _query(
        f"language_share_{_name}",
        f"""SELECT b AS {_column}, c AS _category, count(*) AS n_in_category, CAST(sum(count(*)) OVER (PARTITION BY b) AS BIGINT) AS n_in_bucket,
                   round(count(*) / sum(count(*)) OVER (PARTITION BY b), 6) AS share
            FROM (SELECT {_expr} AS b, CASE WHEN layer_b_primary_language IS NULL OR layer_b_primary_language = '' THEN '(null)' ELSE layer_b_primary_language END AS c
                  FROM feature_rows WHERE created_at_parsed IS NOT NULL) GROUP BY b, c""",
    )(lambda s, d, c=_column: rounded(aggregates.category_share(_features(s, d), c, "layer_b_primary_language")))
_query(
    "user_month_quantiles",
    f"SELECT telegram_user_internal_id, {_BUCKETS['month'][1]} AS bucket_month, count(*) AS n_rows, {', '.join(map(_quantile_sql, METRICS))} FROM feature_rows WHERE created_at_parsed IS NOT NULL GROUP BY 1, 2",
)(lambda s, d: rounded(aggregates.aggregate_user_month(_features(s, d), METRICS)))
_LONG = " UNION ALL ".join(
    f"SELECT telegram_user_internal_id, {_BUCKETS['month'][1]} AS bucket_month, '{m}' AS metric, count(*) AS n_rows, round(median({m}), 6) AS median, round(quantile_cont({m}, 0.25), 6) AS q1, round(quantile_cont({m}, 0.75), 6) AS q3 FROM feature_rows WHERE created_at_parsed IS NOT NULL GROUP BY 1, 2"
    for m in METRICS
)
_query("user_month_quantiles_long", _LONG)(lambda s, d: rounded(aggregates.quantiles_long(_features(s, d), ["telegram_user_internal_id", "bucket_month"], METRICS)))
_query("user_month_quantiles_ranked", _LONG)(
    lambda s, d: rounded(skew.ranked_quantiles(_features(s, d), ["telegram_user_internal_id", "bucket_month"], list(METRICS)).withColumnsRenamed({"q_0": "median", "q_1": "q1", "q_2": "q3"}))
)
_query(
    "long_form_aggregate",
    " UNION ALL ".join(
        f"SELECT strftime({_BUCKETS['day'][1]}, '%Y-%m-%d %H:%M:%S') AS time_bucket, '{m}' AS metric, round(median({m}), 6) AS median, round(quantile_cont({m}, 0.25), 6) AS q1, round(quantile_cont({m}, 0.75), 6) AS q3, count(*) AS n_rows_per_bucket FROM feature_rows WHERE created_at_parsed IS NOT NULL GROUP BY 1"
        for m in METRICS
    ),
)(lambda s, d: rounded(reshape.to_long(aggregates.aggregate_buckets(_features(s, d), "bucket_day", METRICS, nan_last=True), "bucket_day")))
_SHARES = SQL["language_share_month"].replace("round(count(*) / sum(count(*)) OVER (PARTITION BY b), 6)", "count(*) / sum(count(*)) OVER (PARTITION BY b)")


def _month_shares(s: SparkSession, d: str) -> DataFrame:
    return aggregates.category_share(_features(s, d), "bucket_month", "layer_b_primary_language")


_PIVOTED = ("ru", "en", "uk", "de", "pl", "be", "(null)", "(other)")
_FOLDED = f"SELECT bucket_month, CASE WHEN _category IN ({', '.join(repr(c) for c in _PIVOTED)}) THEN _category ELSE '(other)' END AS _category, sum(share) AS share FROM ({_SHARES}) GROUP BY 1, 2"


def _folded_shares(s: SparkSession, d: str) -> DataFrame:
    """Monthly shares with all languages outside the columns of the pivot as ``(other)``."""
    named = F.when(F.col("_category").isin(*_PIVOTED), F.col("_category")).otherwise("(other)")
    return _month_shares(s, d).groupBy("bucket_month", named.alias("_category")).agg(F.sum("share").alias("share"))


_query(
    "share_pivot",
    "SELECT bucket_month, " + ", ".join(f"coalesce(max(round(share, 6)) FILTER (_category = '{c}'), 0.0) AS \"{c}\"" for c in _PIVOTED) + f" FROM ({_FOLDED}) GROUP BY 1",
)(lambda s, d: rounded(reshape.share_pivot(_folded_shares(s, d), "bucket_month", list(_PIVOTED))))
_query(
    "share_pivot_percent",
    "SELECT bucket_month, " + ", ".join(f"coalesce(max(round_even(share * 100, 2)) FILTER (_category = '{c}'), 0.0) AS \"{c}\"" for c in _PIVOTED) + f" FROM ({_FOLDED}) GROUP BY 1",
)(lambda s, d: rounded(reshape.share_pivot(_folded_shares(s, d), "bucket_month", list(_PIVOTED), percent=True)))
_query(
    "topk_plus_other",
    f"""WITH s AS ({_SHARES}), r AS (SELECT _category, row_number() OVER (ORDER BY sum(share) DESC, _category) AS n FROM s GROUP BY 1)
        SELECT bucket_month, CASE WHEN n <= 12 THEN _category ELSE '(other languages)' END AS _category, round(sum(share), 6) AS share FROM s JOIN r USING (_category) GROUP BY 1, 2""",
)(lambda s, d: rounded(reshape.top_categories_and_other(_month_shares(s, d), "bucket_month", 12)))
_query("category_totals", f"SELECT _category, CAST(sum(n_in_category) AS BIGINT) AS total FROM ({_SHARES}) GROUP BY 1")(lambda s, d: reshape.category_totals(_month_shares(s, d)))
_query(
    "share_spans",
    f"""WITH s AS ({_SHARES}), f AS (SELECT c._category, m.bucket_month, coalesce(s.share, 0.0) AS share FROM (SELECT DISTINCT _category FROM s) c CROSS JOIN (SELECT DISTINCT bucket_month FROM s) m LEFT JOIN s ON s._category = c._category AND s.bucket_month = m.bucket_month),
        t AS (SELECT _category, sum(n_in_category) / (SELECT sum(n_in_category) FROM s) AS total_share FROM s GROUP BY 1)
        SELECT _category, round(total_share, 6) AS total_share, round(max(share) - min(share), 6) AS span FROM f JOIN t USING (_category) GROUP BY 1, 2, total_share
        HAVING total_share >= 0.02 AND max(share) - min(share) >= 0.025 ORDER BY max(share) - min(share) DESC, _category LIMIT 3""",
)(lambda s, d: rounded(reshape.share_spans(_month_shares(s, d), "bucket_month")))
_query(
    "event_share_day",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS bucket_day, event_type AS _category, count(*) AS n_in_category, CAST(sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)) AS BIGINT) AS n_in_bucket,
              round(count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)), 6) AS share FROM events GROUP BY date_trunc('day', ts), event_type""",
)(lambda s, d: rounded(aggregates.category_share(aggregates.add_buckets(_read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts"), "bucket_day", "event_type")))
_query(
    "order_month_quantiles",
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket_month, count(*) AS n_rows, " + _quantile_sql("o_totalprice") + " FROM orders GROUP BY 1",
)(lambda s, d: rounded(aggregates.aggregate_buckets(aggregates.add_buckets(_read(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), "o_orderdate"), "bucket_month", ["o_totalprice"])))
_EXTENSION = r"lower(regexp_extract(list_extract(string_split(replace(trim(coalesce(file_name, '')), '\', '/'), '/'), -1), '^.+\.([^.]+)$', 1))"
_query(
    "file_extension_share_month",
    f"""WITH t AS (SELECT date_trunc('month', {_AT})::TIMESTAMP AS b, CASE WHEN {_EXTENSION} = '' THEN '(null)' ELSE {_EXTENSION} END AS c FROM sample_multiline WHERE {_AT} IS NOT NULL)
        SELECT b AS bucket_month, c AS _category, count(*) AS n_in_category, CAST(sum(count(*)) OVER (PARTITION BY b) AS BIGINT) AS n_in_bucket, round(count(*) / sum(count(*)) OVER (PARTITION BY b), 6) AS share FROM t GROUP BY b, c""",
)(lambda s, d: rounded(aggregates.category_share(aggregates.valid_times(_read(s, d)).withColumn("ext", T.file_extension(F.col("file_name"))), "bucket_month", "ext")))
_query(
    "daily_total",
    f"SELECT {_BUCKETS['day'][1]} AS bucket_day, round(coalesce(sum({DURATION}), 0.0), 6) AS total_seconds, count(*) AS n_rows FROM feature_rows WHERE created_at_parsed IS NOT NULL GROUP BY 1",
)(lambda s, d: rounded(aggregates.daily_total(_features(s, d))))
_query(
    "created_range",
    f"SELECT count(*) AS rows_read, count(*) FILTER ({_AT} IS NULL) AS rows_dropped_null_ts, strftime(min({_AT}), '%Y-%m-%d %H:%M:%S') AS created_at_min, strftime(max({_AT}), '%Y-%m-%d %H:%M:%S') AS created_at_max FROM sample_multiline",
)(lambda s, d: aggregates.created_range(_read(s, d)))
_query("parse_created_at", f"SELECT id, {_AT} AS created_at_parsed FROM sample_multiline")(lambda s, d: _read(s, d).select("id", parse_created_at(F.col("created_at")).alias("created_at_parsed")))

# ---- durations ----

_PCT = ", ".join(f"round(quantile_cont({DURATION}, {q}), 6) AS p{round(q * 100):02d}" for q in aggregates.PERCENTILES)
_SUMMARY = f"count(*) AS n, round(avg({DURATION}), 6) AS mean, round(median({DURATION}), 6) AS median, round(var_pop({DURATION}), 3) AS variance, round(stddev_pop({DURATION}), 6) AS stddev, round(min({DURATION}), 6) AS min, round(max({DURATION}), 6) AS max, {_PCT}"
_SANE = f"created_at_parsed IS NOT NULL AND {DURATION} IS NOT NULL"


def _durations(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).filter(F.col(DURATION).isNotNull()).withColumn("month", F.date_format("created_at_parsed", "yyyy-MM"))


def _summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rounded(aggregates.summary(df, DURATION, keys).withColumn("variance", F.round("variance", 3)))


_query("duration_summary_month", f"SELECT strftime(created_at_parsed, '%Y-%m') AS month, {_SUMMARY} FROM feature_rows WHERE {_SANE} GROUP BY 1")(lambda s, d: _summary(_durations(s, d), ["month"]))
_query("duration_overall", f"SELECT {_SUMMARY} FROM feature_rows WHERE {_SANE}")(lambda s, d: _summary(_durations(s, d)))
_query(
    "duration_last_30_days",
    f"SELECT {_SUMMARY} FROM feature_rows WHERE {_SANE} AND created_at_parsed >= (SELECT max(created_at_parsed) FROM feature_rows WHERE {_SANE}) - INTERVAL 30 DAYS",
)(lambda s, d: _summary(aggregates.trailing_days(_durations(s, d), "created_at_parsed")))
_query(
    "duration_window",
    f"SELECT {_SUMMARY} FROM feature_rows WHERE {_SANE} AND created_at_parsed BETWEEN TIMESTAMP '2024-06-01 00:00:00' AND TIMESTAMP '2024-12-31 23:59:59'",
)(lambda s, d: _summary(aggregates.between(_durations(s, d), "created_at_parsed", F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-12-31 23:59:59'"))))
_BIN = "CASE " + " ".join(f"WHEN m >= {a} AND m < {b} THEN {i}" for i, (a, b) in enumerate(zip(aggregates.EDGES_MINUTES[:-2], aggregates.EDGES_MINUTES[1:-1]))) + f" WHEN m BETWEEN {aggregates.EDGES_MINUTES[-2]} AND {aggregates.EDGES_MINUTES[-1]} THEN {len(aggregates.EDGES_MINUTES) - 2} END"
_BINS = f"SELECT strftime(created_at_parsed, '%Y-%m') AS month, {DURATION} AS x, {DURATION} / 60.0 AS m FROM feature_rows WHERE {_SANE}"
_EDGES = ", ".join(map(str, aggregates.EDGES_MINUTES))
_query(
    "histogram_fixed_edges",
    f"SELECT month, CAST(bin AS INTEGER) AS bin, CAST([{_EDGES}][bin + 1] AS INTEGER) AS \"left\", CAST([{_EDGES}][bin + 2] AS INTEGER) AS \"right\", count(*) AS count FROM (SELECT month, {_BIN} AS bin FROM ({_BINS})) WHERE bin IS NOT NULL GROUP BY ALL",
)(lambda s, d: aggregates.histogram(_durations(s, d), DURATION, ["month"]))
_query(
    "tail_shares",
    f"""SELECT month, count(*) AS n, round(count(*) FILTER (bin < 3) / count(*), 6) AS share_3min_or_less, round(count(*) FILTER (bin >= 8) / count(*), 6) AS share_30min_or_more,
               round(CASE WHEN quantile_cont(x, 0.5) <> 0 THEN quantile_cont(x, 0.95) / quantile_cont(x, 0.5) END, 6) AS tail_ratio, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr
        FROM (SELECT month, x, {_BIN} AS bin FROM ({_BINS})) GROUP BY 1""",
)(lambda s, d: rounded(aggregates.tail_shares(_durations(s, d), DURATION, ["month"])))
_query(
    "median_extreme_months",
    f"WITH m AS (SELECT strftime(created_at_parsed, '%Y-%m') AS month, median({DURATION}) AS x, count(*) AS n FROM feature_rows WHERE {_SANE} GROUP BY 1) SELECT (SELECT month FROM m ORDER BY x DESC, month LIMIT 1) AS longest, (SELECT month FROM m ORDER BY x, month LIMIT 1) AS shortest, (SELECT month FROM m ORDER BY n, month LIMIT 1) AS thinnest",
)(lambda s, d: aggregates.summary(_durations(s, d), DURATION, ["month"]).agg(F.min_by("month", F.struct(-F.col("median"), "month")).alias("longest"), F.min_by("month", F.struct("median", "month")).alias("shortest"), F.min_by("month", F.struct("n", "month")).alias("thinnest")))
_query(
    "first_last_delta",
    f"WITH m AS (SELECT strftime(created_at_parsed, '%Y-%m') AS month, median({DURATION}) AS x FROM feature_rows WHERE {_SANE} GROUP BY 1) SELECT count(*) AS n, CASE WHEN count(*) < 2 THEN 0.0 ELSE round_even(arg_max(x, month) - arg_min(x, month), 3) END AS delta FROM m",
)(lambda s, d: aggregates.first_last_delta(aggregates.summary(_durations(s, d), DURATION, ["month"]), "median", "month"))

# ---- texts ----

_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS = f"list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '')"


def _words(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))


_query(
    "token_stats",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS total_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS unique_tokens, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END, 6) AS type_token_ratio,
               round(list_avg(list_transform(w, lambda x: length(x))), 6) AS mean_word_length, CAST(list_median(list_transform(w, lambda x: length(x))) AS DOUBLE) AS median_word_length,
               round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) >= 7)) / len(w) END, 6) AS long_word_ratio FROM t""",
)(
    lambda s, d: rounded(
        _words(s, d).select(
            "doc_id", F.size("w").cast("bigint").alias("total_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("unique_tokens"), T.type_token_ratio(F.col("w")).alias("type_token_ratio"),
            T.array_mean(T.word_lengths(F.col("w"))).alias("mean_word_length"), T.array_median(T.word_lengths(F.col("w"))).alias("median_word_length"), T.long_word_ratio(F.col("w")).alias("long_word_ratio"),
        )
    )
)
_query(
    "word_entropy_hapax",
    f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT doc_id, sum(n) AS m FROM c GROUP BY 1)
        SELECT d.doc_id, round(x.e, 6) AS word_entropy_bits, round(x.h, 6) AS hapax_ratio FROM documents d LEFT JOIN
        (SELECT doc_id, -sum(n / m * log2(n / m)) AS e, count(*) FILTER (n = 1) / max(m) AS h FROM c JOIN s USING (doc_id) GROUP BY 1) x USING (doc_id)""",
)(lambda s, d: rounded(_words(s, d).select("doc_id", (T.entropy_bits(F.col("w")) + 0.0).alias("word_entropy_bits"), T.hapax_ratio(F.col("w")).alias("hapax_ratio"))))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


_CLASSES = {"cyrillic": r"[\x{0400}-\x{052F}]", "latin": r"[A-Za-zªµºÀ-ÖØ-öø-\x{024F}\x{1E00}-\x{1EFF}]", "digit": r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", "letters": r"\p{L}", "cyrillic_letters": r"[\x{0400}-\x{0481}\x{048A}-\x{052F}]",
    "cjk": r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]", "arabic": r"[\x{0600}-\x{065F}\x{066A}-\x{06EF}\x{06FA}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]",
    "arabic_letters": r"[\x{0620}-\x{064A}\x{066E}\x{066F}\x{0671}-\x{06D3}\x{06D5}\x{06E5}\x{06E6}\x{06EE}\x{06EF}\x{06FA}-\x{06FC}\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08C9}]", "cjk_letters": r"[\x{3005}\x{3006}\x{3031}-\x{3035}\x{303B}\x{303C}\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"}
_query(
    "script_ratios",
    "WITH t AS (SELECT doc_id, " + ", ".join(f"{_n(p)} AS {k}" for k, p in _CLASSES.items()) + """ FROM documents), u AS (SELECT *, letters - latin - cyrillic_letters - cjk_letters - arabic_letters AS other FROM t)
        SELECT doc_id, """ + ", ".join(f"round(coalesce({k} / nullif(cyrillic + latin + cjk + arabic + digit + other, 0), 0.0), 6) AS {k}" for k in ("cyrillic", "latin", "cjk", "arabic", "digit", "other")) + " FROM u",
)(lambda s, d: rounded(_read(s, d, "documents").select("doc_id", T.script_ratios(F.col("text")).alias("r")).select("doc_id", "r.cyrillic", "r.latin", "r.cjk", "r.arabic", "r.digit", "r.other")))
_query(
    "unicode_oddities",
    f"""SELECT doc_id, CAST({_n(chr(0xFFFD))} AS BIGINT) AS replacement_count, CAST({_n("[" + chr(0x200B) + "-" + chr(0x200D) + chr(0xFEFF) + "]")} AS BIGINT) AS zero_width_count,
               CAST({_n(r"\p{C}")} - {_n(r"[\t\n\r]")} AS BIGINT) AS control_count, round(coalesce(({_n(r"[\p{C}\p{Z}]")} - {_n(r"[ \t\n\r]")}) / nullif(length(coalesce(text, '')), 0), 0.0), 6) AS nonprintable_ratio FROM documents""",
)(
    lambda s, d: rounded(
        _read(s, d, "documents").select("doc_id", T.replacement_count(F.col("text")).alias("replacement_count"), T.zero_width_count(F.col("text")).alias("zero_width_count"), T.control_count(F.col("text")).alias("control_count"), T.nonprintable_ratio(F.col("text")).alias("nonprintable_ratio"))
    )
)
_query(
    "repeated_char_runs",
    r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS x, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
        f AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM c), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
        r AS (SELECT doc_id, run, any_value(x) AS x, count(*) AS n FROM g GROUP BY 1, 2)
        SELECT d.doc_id, round(coalesce(s.a / nullif(s.b, 0), 0.0), 6) AS repeated_char_run_ratio FROM documents d LEFT JOIN
        (SELECT doc_id, sum(n) FILTER (n >= 3) AS a, sum(n) AS b FROM r WHERE regexp_matches(x, '[\p{L}\p{N}]') GROUP BY 1) s USING (doc_id)""",
)(lambda s, d: rounded(_read(s, d, "documents").select("doc_id", T.repeated_char_run_ratio(F.col("text")).alias("repeated_char_run_ratio"))))
_PARTS = r"list_filter(string_split(replace(trim(coalesce(file_name, '')), '\', '/'), '/'), lambda x: x NOT IN ('', '.'))"
_query(
    "file_metadata",
    rf"""SELECT DISTINCT file_name, {_EXTENSION} AS extension, CAST(len(list_filter(string_split_regex(coalesce(list_extract({_PARTS}, -1), ''), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS BIGINT) AS tokens,
                CAST(greatest(len({_PARTS}) - 1, 0) AS BIGINT) AS depth FROM sample_multiline""",
)(lambda s, d: _read(s, d).select("file_name", T.file_extension(F.col("file_name")).alias("extension"), T.basename_token_count(F.col("file_name")).alias("tokens"), T.path_depth(F.col("file_name")).alias("depth")).distinct())
_query(
    "detection_sample",
    """SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 133) || substr(t, CAST(greatest(0, floor((length(t) - 134) / 2)) AS BIGINT) + 1, 134) || substr(t, length(t) - 132, 133) END AS sample
       FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)(lambda s, d: _read(s, d, "documents").select("doc_id", T.detection_sample(F.col("text"), 400).alias("sample")))
_query("detect_language", oracles.DETECT)(lambda s, d: rounded(_texts(s, d, "documents").select("doc_id", detect(F.col("text")).alias("l")).select("doc_id", "l.*")))
_query("excerpt", oracles.excerpt(1500))(lambda s, d: _read(s, d, "documents").select("doc_id", T.excerpt(F.col("text"), 1500).alias("e")).select("doc_id", "e.*"))

# ---- transcripts: segments and features ----

_query("segments", oracles.SEGMENTS)(lambda s, d: _texts(s, d).select("id", F.posexplode(segments.parse_segments(F.col("transcription_text"))).alias("seg_no", "seg")).select("id", "seg_no", "seg.*"))
_FEATURES = oracles.features(_EXTENSION, _PARTS, _CLASSES)
_ROUNDED = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in layers.DOUBLES) + f") FROM ({_FEATURES})"
_query("features", _ROUNDED)(lambda s, d: rounded(layers.add_features(_texts(s, d).select("id", "file_name", "transcription_text")).drop("transcription_text")))
_DATED = oracles.features(_EXTENSION, _PARTS, _CLASSES, "created_at,")
_query("features_month", oracles.month_quantiles(_DATED, _AT, layers.metric_columns(True)))(
    lambda s, d: rounded(aggregates.aggregate_buckets(aggregates.valid_times(layers.add_features(_texts(s, d))), "bucket_month", layers.metric_columns(True)))
)
_query("content_category_share_month", oracles.month_share(_DATED, _AT, "content_primary_category"))(lambda s, d: _content_shares(s, d))


def _content_shares(s: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.category_share(aggregates.valid_times(layers.add_features(_texts(s, d))), "bucket_month", "content_primary_category"))


_query(
    "separator_lines",
    r"""SELECT id, CAST(sum(len(regexp_extract_all(t, '(?m)^-{20,}[ \t]*$'))) AS BIGINT) AS n FROM (SELECT id, replace(replace(coalesce(transcription_text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM sample_multiline) GROUP BY 1""",
)(lambda s, d: _read(s, d).groupBy("id").agg(F.sum(segments.separator_count(F.col("transcription_text"))).alias("n")))
_query("content_category", oracles.CATEGORY)(
    lambda s, d: _texts(s, d).select("id", category.classify(segments.parse_segments(F.col("transcription_text"))).alias("c")).select("id", "c.*")
)

# ---- raw summary ----

_RAW = f"SELECT strftime({_AT_TRIMMED}, '%Y-%m') AS month, lower(coalesce(transcription_text, '')) AS t FROM sample_multiline WHERE {_AT_TRIMMED} IS NOT NULL"
_STOPPED = ", ".join(f"'{w}'" for w in raw_summary.STOPWORDS)
_RAW_WORDS = f"SELECT month, unnest(list_filter(regexp_extract_all(t, '[A-Za-zА-Яа-яЁёІіЇїЄє''-]{{3,}}'), lambda w: w NOT IN ({_STOPPED}) AND length(w) <= 25)) AS word FROM ({_RAW})"


def _raw(s: SparkSession, d: str) -> DataFrame:
    return raw_summary.raw_rows(_texts(s, d))


_query("raw_monthly", oracles.raw_monthly(_AT_TRIMMED))(lambda s, d: raw_summary.monthly(_raw(s, d)))
_query("raw_overall", oracles.raw_overall(_AT_TRIMMED))(lambda s, d: raw_summary.monthly(_raw(s, d), overall=True))
_query("raw_trend", oracles.raw_trend(_AT_TRIMMED))(lambda s, d: raw_summary.month_trend(raw_summary.monthly(_raw(s, d))))
_query("raw_primary_labels", oracles.raw_primary_labels(_AT_TRIMMED))(lambda s, d: raw_summary.label_distribution(_raw(s, d), ["month"]))
_query("top_tokens", f"SELECT word, count(*) AS n FROM ({_RAW_WORDS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 25")(lambda s, d: raw_summary.frequent_words(_raw(s, d), k=25))
_query(
    "top_tokens_per_month",
    f"SELECT month, word, n FROM (SELECT month, word, count(*) AS n, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, word) AS r FROM ({_RAW_WORDS}) GROUP BY 1, 2) WHERE r <= 12",
)(lambda s, d: raw_summary.frequent_words(_raw(s, d), ["month"]))
_LABEL_LIST = ", ".join(f"CASE WHEN {' OR '.join(f"contains(t, '{w}')" for w in words)} THEN '{c}' END" for c, words in category.RAW_KEYWORDS.items())
_N_WORDS = "len(regexp_extract_all(t, '[A-Za-zА-Яа-яЁёІіЇїЄє''-]{3,}'))"
_query(
    "multi_label_hits",
    f"""WITH l AS (SELECT month, list_filter([{_LABEL_LIST}], lambda x: x IS NOT NULL) AS own, {_N_WORDS} AS n FROM ({_RAW}))
        SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN len(own) > 0 THEN own ELSE [CASE WHEN n < 8 THEN 'very_short_notes' WHEN n < 40 THEN 'quick_messages' ELSE 'general_speech' END] END) AS label FROM l) GROUP BY 1""",
)(lambda s, d: raw_summary.label_hits(_raw(s, d), k=12))
_query(
    "script_dominance",
    rf"""WITH c AS (SELECT month, len(regexp_extract_all(t, '[а-яёіїє]')) AS cyr, len(regexp_extract_all(t, '[a-z]')) AS lat FROM ({_RAW}))
         SELECT month, CASE WHEN cyr > 1.3 * lat THEN 'cyr' WHEN lat > 1.3 * cyr THEN 'lat' ELSE 'mixed' END AS dominance, count(*) AS n FROM c GROUP BY 1, 2""",
)(lambda s, d: _raw(s, d).groupBy("month", "dominance").agg(F.count("*").alias("n")))

# ---- sampling ----

_query(
    "length_bins",
    rf"""WITH t AS (SELECT DISTINCT ON (trim(id)) trim(id) AS transcript_id, len(regexp_extract_all(coalesce(transcription_text, ''), '\p{{L}}{{2,}}(?:[''-]\p{{L}}+)?')) AS n FROM sample_multiline WHERE {_AT_TRIMMED} IS NOT NULL)
         SELECT transcript_id, CAST(n AS BIGINT) AS total_tokens, CASE WHEN n < 20 THEN 'very_short' WHEN n < 120 THEN 'short' WHEN n < 500 THEN 'medium' WHEN n < 1200 THEN 'long' ELSE 'very_long' END AS length_bin FROM t""",
)(lambda s, d: sampling.candidates(_texts(s, d)).select("transcript_id", "total_tokens", "length_bin"))
_query("sample_candidates", oracles.sample_candidates(_AT_TRIMMED, _CLASSES["latin"]))(lambda s, d: rounded(sampling.scored(stash(sampling.candidates(_texts(s, d)), "candidates"))))
_query("month_center", oracles.month_center(_AT_TRIMMED, _CLASSES["latin"]))(lambda s, d: rounded(sampling.month_center(sampling.candidates(_texts(s, d)))))


def _sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(sampling.exclude(sampling.candidates(_texts(s, d)), _read(s, d, "excluded_ids")))


_query("stratified_sample", oracles.stratified_sample(_AT_TRIMMED, _CLASSES["latin"]))(lambda s, d: rounded(_sample(s, d)))
_query("sample_excerpts", oracles.sample_excerpts(_AT_TRIMMED, _CLASSES["latin"]))(lambda s, d: rounded(sampling.with_excerpts(_sample(s, d), _read(s, d))))
_ELIGIBLE = f"SELECT DISTINCT ON (trim(id)) trim(id) AS transcript_id, strftime({_AT_TRIMMED}, '%Y-%m') AS month FROM sample_multiline WHERE {_AT_TRIMMED} IS NOT NULL"
_KEPT = f"SELECT * FROM ({_ELIGIBLE}) c ANTI JOIN (SELECT trim(transcript_id) AS transcript_id FROM excluded_ids WHERE trim(transcript_id) <> '') x USING (transcript_id)"
_query("sample_quota", f"SELECT month, least(count(*), 8) AS n FROM ({_KEPT}) GROUP BY 1")(lambda s, d: _sample(s, d).groupBy("month").agg(F.count("*").alias("n")))
_query("exclude_prior_samples", f"SELECT transcript_id FROM ({_KEPT})")(lambda s, d: sampling.exclude(sampling.candidates(_texts(s, d)), _read(s, d, "excluded_ids")).select("transcript_id"))

# ---- review scores ----

_S = ", ".join(judge.SCORES)
_VALID = " + ".join(f"(CASE WHEN {c} BETWEEN 1 AND 5 THEN 1 ELSE 0 END)" for c in (*judge.SCORES, "judge_confidence"))
_JUDGED = f"SELECT DISTINCT trim(transcript_id) AS transcript_id, month, {_S}, judge_confidence, primary_failure_modes, trim(coalesce(evidence, '')) AS evidence, {_VALID} AS n_valid FROM judge_scores WHERE trim(coalesce(transcript_id, '')) <> ''"
_IX = "trim(transcript_id)"
_I = ", ".join(("month", *judge.INDEX_COLUMNS))
_INDEX = f"""SELECT transcript_id, {_I} FROM (SELECT {_IX} AS transcript_id, {_I}, row_number() OVER (PARTITION BY {_IX} ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in ("month", *judge.INDEX_COLUMNS))}) AS r FROM judge_index WHERE trim(coalesce(transcript_id, '')) <> '') WHERE r = 1"""
_FLAT = f"""SELECT j.transcript_id, coalesce(CASE WHEN trim(j.month) <> '' THEN trim(j.month) END, trim(i.month)) AS month, coalesce(i.selection_reason, '') AS selection_reason,
                   CASE WHEN i.selection_reason = 'quality_sentinel' THEN 'sentinel' ELSE 'representative_or_contrastive' END AS sample_group, {', '.join(f"coalesce(i.{c}, '') AS {c}" for c in judge.INDEX_COLUMNS[1:])},
                   j.judge_confidence, array_to_string(list_filter(list_transform(coalesce(j.primary_failure_modes, []), lambda m: trim(m)), lambda m: m <> ''), '|') AS primary_failure_modes, j.evidence, {', '.join(f'j.{c}' for c in judge.SCORES)}
            FROM ({_JUDGED}) j LEFT JOIN ({_INDEX}) i USING (transcript_id) WHERE j.n_valid = 5 AND coalesce(CASE WHEN trim(j.month) <> '' THEN trim(j.month) END, trim(i.month)) <> ''"""


def _flat(s: SparkSession, d: str) -> DataFrame:
    return judge.flatten(_read(s, d, "judge_scores"), _read(s, d, "judge_index"))


_query("judge_join", _FLAT)(_flat)
_query("judge_missing", f"SELECT transcript_id FROM ({_INDEX}) ANTI JOIN ({_JUDGED}) j USING (transcript_id)")(lambda s, d: judge.missing_reviews(_read(s, d, "judge_scores"), _read(s, d, "judge_index")))
_query("judge_extra", f"SELECT DISTINCT transcript_id FROM ({_JUDGED}) ANTI JOIN ({_INDEX}) i USING (transcript_id)")(lambda s, d: judge.extra_reviews(_read(s, d, "judge_scores"), _read(s, d, "judge_index")))
_query("judge_duplicates", f"SELECT transcript_id, count(*) AS n FROM ({_JUDGED}) GROUP BY 1 HAVING count(*) > 1")(lambda s, d: judge.duplicate_reviews(_read(s, d, "judge_scores")))
_MEANS = ", ".join(f"round_even(coalesce(avg({c}), 0.0), 3) AS mean_{c}, round_even(coalesce(sum({c} * judge_confidence) / nullif(sum(judge_confidence), 0), 0.0), 3) AS confidence_weighted_mean_{c}" for c in judge.SCORES)
_MONTHLY = f"""SELECT month, g AS sample_group, count(*) AS n_evaluated, count(*) FILTER (sample_group = 'sentinel') AS n_sentinel, count(*) FILTER (lower(excerpt_limited) = 'true') AS n_excerpt_limited, {_MEANS}
               FROM (SELECT *, unnest(CASE WHEN sample_group = 'sentinel' THEN ['all_selected'] ELSE ['all_selected', '{judge.REPRESENTATIVE}'] END) AS g FROM ({_FLAT})) GROUP BY 1, 2"""
_query("judge_monthly_scores", _MONTHLY)(lambda s, d: judge.monthly_summaries(_flat(s, d)))
_MODES = "list_filter(string_split(primary_failure_modes, '|'), lambda m: m NOT IN ('', 'none', 'excerpt_limited'))"
_MODE_ROWS = f"SELECT month, sample_group, unnest(CASE WHEN len({_MODES}) > 0 THEN {_MODES} ELSE ['(none)'] END) AS failure_mode FROM ({_FLAT})"
_query("failure_mode_counts", f"SELECT month, sample_group, failure_mode, count(*) AS count FROM ({_MODE_ROWS}) GROUP BY 1, 2, 3")(lambda s, d: judge.failure_modes(_flat(s, d)))
_query(
    "failure_mode_cards",
    f"""WITH c AS (SELECT month, replace(failure_mode, '(none)', 'none') AS failure_mode, count(*) AS count FROM ({_MODE_ROWS}) GROUP BY 1, 2)
        SELECT month, failure_mode, count, round(100 * count / max(count) OVER (PARTITION BY month), 6) AS pct_of_max, round(100 * count / sum(count) OVER (PARTITION BY month), 6) AS pct_of_mentions,
               CAST(row_number() OVER (PARTITION BY month ORDER BY count DESC, failure_mode) AS INTEGER) AS place FROM c""",
)(lambda s, d: rounded(judge.failure_cards(_flat(s, d))))
_query("top_failure_modes", f"SELECT failure_mode, count(*) AS n FROM ({_MODE_ROWS}) WHERE failure_mode <> '(none)' GROUP BY 1 ORDER BY n DESC, failure_mode LIMIT 8")(lambda s, d: judge.top_failure_modes(_flat(s, d)))
_query("selection_reason_counts", f"SELECT selection_reason, count(*) AS n FROM ({_FLAT}) GROUP BY 1")(lambda s, d: judge.reason_counts(_flat(s, d)))
_query(
    "worst_per_month",
    f"""SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY transcription_quality_score + diarization_quality_score + artifact_severity_score, timestamp_structure_score, judge_confidence DESC, transcript_id, evidence, primary_failure_modes) AS r FROM ({_FLAT})) WHERE r = 1""",
)(lambda s, d: judge.worst_of_month(_flat(s, d)))
_WM = "confidence_weighted_mean_transcription_quality_score"
_query("judge_score_deltas", f"SELECT sample_group, CASE WHEN count(*) < 2 THEN 0.0 ELSE round_even(arg_max({_WM}, month) - arg_min({_WM}, month), 3) END AS delta FROM ({_MONTHLY}) GROUP BY 1")(lambda s, d: judge.score_deltas(judge.monthly_summaries(_flat(s, d))))
_query(
    "judge_best_weakest",
    f"WITH m AS ({_MONTHLY}) SELECT (SELECT month FROM m WHERE sample_group = '{judge.REPRESENTATIVE}' ORDER BY {_WM} DESC, month LIMIT 1) AS best_month, (SELECT month FROM m WHERE sample_group = '{judge.REPRESENTATIVE}' ORDER BY {_WM}, month LIMIT 1) AS weakest_month",
)(lambda s, d: judge.best_and_weakest(judge.monthly_summaries(_flat(s, d))))
_WT = "confidence_weighted_mean_timestamp_structure_score"
_query(
    "last_two_vs_prev_two",
    f"""WITH r AS (SELECT {_WT} AS x, row_number() OVER (ORDER BY month DESC) AS r FROM ({_MONTHLY}) WHERE sample_group = '{judge.REPRESENTATIVE}')
        SELECT round(avg(x) FILTER (r <= 2), 6) AS last_avg, round(avg(x) FILTER (r IN (3, 4)), 6) AS prev_avg, round(avg(x) FILTER (r <= 2) - avg(x) FILTER (r IN (3, 4)), 6) AS delta FROM r HAVING count(*) >= 4""",
)(lambda s, d: rounded(judge.last_two_against_previous(judge.monthly_summaries(_flat(s, d)))))

# ---- reports ----

_query("sample_months", f"SELECT month, count(*) AS n FROM ({_FLAT}) GROUP BY 1")(lambda s, d: trends.month_counts(_flat(s, d)))
_query(
    "biggest_mover",
    SQL["share_spans"].split("SELECT _category, round(total_share")[0]
    + """SELECT _category, round(total_share, 6) AS total_share, round(max(share) - min(share), 6) AS span FROM f JOIN t USING (_category) WHERE _category <> 'ru' GROUP BY 1, total_share
         HAVING total_share >= 0.005 AND max(share) - min(share) >= 0.008 ORDER BY max(share) - min(share) DESC, total_share DESC, _category LIMIT 1""",
)(lambda s, d: rounded(trends.biggest_mover(_month_shares(s, d), "bucket_month")))
_query(
    "month_labels",
    f"""SELECT month, ['{"', '".join(trends.MONTHS_RU)}'][CAST(substr(month, 6, 2) AS INTEGER)] || ' ' || substr(month, 1, 4) AS label, n_evaluated FROM ({_MONTHLY}) WHERE sample_group = 'all_selected'""",
)(lambda s, d: judge.monthly_summaries(_flat(s, d)).filter("sample_group = 'all_selected'").select("month", trends.month_label_ru(F.col("month")).alias("label"), "n_evaluated"))
_query(
    "aligned_months",
    f"""SELECT m.month, j.n_evaluated FROM (SELECT DISTINCT strftime(created_at_parsed, '%Y-%m') AS month FROM feature_rows WHERE created_at_parsed IS NOT NULL) m LEFT JOIN (SELECT * FROM ({_MONTHLY}) WHERE sample_group = 'all_selected') j USING (month)""",
)(
    lambda s, d: trends.align_months(_features(s, d).select(F.date_format("created_at_parsed", "yyyy-MM").alias("month")), judge.monthly_summaries(_flat(s, d)).filter("sample_group = 'all_selected'").select("month", "n_evaluated"))
)
_query(
    "last_month_panel",
    f"""WITH f AS ({_FLAT}), m AS ({_MONTHLY}), r AS (SELECT month, {_WM} AS x, confidence_weighted_mean_artifact_severity_score AS a, lag({_WM}) OVER (ORDER BY month) AS px, lag(confidence_weighted_mean_artifact_severity_score) OVER (ORDER BY month) AS pa FROM m WHERE sample_group = '{judge.REPRESENTATIVE}'),
        l AS (SELECT * FROM r ORDER BY month DESC LIMIT 1)
        SELECT l.month, round_even(x - px, 3) AS text_delta, round_even(a - pa, 3) AS artefact_delta, round_even((SELECT {_WM} FROM m WHERE sample_group = 'all_selected' AND m.month = l.month) - x, 3) AS gap,
               count(*) FILTER (least({_S}) >= 4) AS n_strong, count(*) FILTER (least({_S}) <= 2) AS n_low, count(*) FILTER (list_contains(string_split(primary_failure_modes, '|'), 'coarse_timestamps')) AS n_coarse
        FROM l JOIN f ON f.month = l.month GROUP BY ALL""",
)(lambda s, d: trends.last_month_panel(_flat(s, d), judge.monthly_summaries(_flat(s, d))))
_TEXTS = ", ".join(f"printf('%.6f', {c} + 0.0) AS {c}" for c in ("mean", "median", "variance", "stddev", "min", "max", *(f"p{round(q * 100):02d}" for q in aggregates.PERCENTILES)))
_query("duration_stats_text", f"SELECT month, n, {_TEXTS} FROM (SELECT strftime(created_at_parsed, '%Y-%m') AS month, {_SUMMARY} FROM feature_rows WHERE {_SANE} GROUP BY 1)")(
    lambda s, d: trends.as_text(_summary(_durations(s, d), ["month"]))
)
_query(
    "exact_language",
    f"WITH src AS (SELECT row_number() OVER () AS rid, id, coalesce(transcription_text, '') AS t FROM sample_multiline), {oracles.language_rows('src', 'rid', 't')} SELECT id, iso AS language, round(confidence, 6) AS language_confidence FROM lang JOIN src USING (rid) WHERE iso IN ('ru', 'uk') AND confidence >= 0.5",
)(lambda s, d: rounded(trends.exact_language(_texts(s, d), ["ru", "uk"]).select("id", "language", "language_confidence")))

# ---- files ----


_COUNTED = "SELECT id, count(*) AS n, count(transcription_text) FILTER (transcription_text <> '') AS with_text FROM sample_multiline GROUP BY 1"


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("transcription_text") != "").alias("with_text"))


def _as_csv(df: DataFrame, what: str = "csv") -> str:
    """The table as CSV with quoted line ends; the place it went to."""
    path = scratch(df.sparkSession, what)
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _in_order(s: SparkSession, d: str) -> DataFrame:
    """One row per id, in one file and in the order of the ids."""
    return _read(s, d).groupBy("id").agg(F.min("created_at").alias("created_at")).withColumn("transcription_text", F.lit("a\nb")).orderBy("id").coalesce(1)


@_query("csv_round_trip", _COUNTED)
def _csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The transcripts written as CSV with quoted line ends and read back."""
    return _counted(files.require_columns(files.read_csv(s, _as_csv(_read(s, d)))))


@_query("csv_marked_header", "SELECT 'id' AS first_column, count(*) AS n FROM sample_multiline")
def _csv_marked_header(s: SparkSession, d: str) -> DataFrame:
    """A CSV whose header starts with a byte order mark."""
    df = files.read_csv(s, _as_csv(_read(s, d).withColumnRenamed("id", "\ufeffid")))
    return df.agg(F.lit(df.columns[0]).alias("first_column"), F.count("id").alias("n"))


@_query("csv_first_rows", "SELECT DISTINCT id FROM sample_multiline ORDER BY id LIMIT 250")
def _csv_first_rows(s: SparkSession, d: str) -> DataFrame:
    """The row cap of the batch run."""
    return files.read_csv(s, _as_csv(_in_order(s, d)), 250).select("id")


@_query("csv_row_numbers", "SELECT id, row_number() OVER (ORDER BY id) AS source_row_number FROM (SELECT DISTINCT id FROM sample_multiline)")
def _csv_row_numbers(s: SparkSession, d: str) -> DataFrame:
    return files.with_row_number(files.read_csv(s, _as_csv(_in_order(s, d)))).select("id", "source_row_number")


@_query("csv_logical_rows", "SELECT count(*) AS n FROM sample_multiline")
def _csv_logical_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of a CSV whose cells hold line ends."""
    return s.createDataFrame([(files.logical_rows(s, _as_csv(_read(s, d))),)], "n bigint")


@_query("missing_columns", "SELECT unnest(['created_at', 'transcription_text']) AS missing")
def _missing_columns(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(c,) for c in files.missing_columns(_read(s, d).select("id"))], "missing string")


@_query("staged_csv", _COUNTED)
def _staged_csv(s: SparkSession, d: str) -> DataFrame:
    """CSV to Parquet without features."""
    path = scratch(s, "staged")
    files.stage_csv(s, _as_csv(_read(s, d)), path)
    return _counted(files.read_source(s, path))


@_query("parquet_parts", _COUNTED)
def _parquet_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts of at most 1,000 rows, read back from their folder."""
    path = scratch(s, "parts")
    files.write_parts(_read(s, d), path, 1000)
    return _counted(files.read_source(s, path))


@_query("merged_rows", _COUNTED)
def _merged_rows(s: SparkSession, d: str) -> DataFrame:
    """All rows as one file."""
    path = scratch(s, "merged") + ".parquet"
    files.write_merged(_read(s, d), path, 1)
    return _counted(files.read_source(s, path))


@_query("json_lines", _COUNTED)
def _json_lines(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "lines")
    files.write_jsonl(_read(s, d), path)
    return _counted(s.read.schema(_read(s, d).schema).json(path))


@_query("both_sinks", "SELECT sink, _category, n FROM (SELECT coalesce(nullif(layer_b_primary_language, ''), '(null)') AS _category, count(*) AS n FROM feature_rows WHERE created_at_parsed IS NOT NULL GROUP BY 1), (SELECT unnest(['csv', 'parquet']) AS sink)")
def _both_sinks(s: SparkSession, d: str) -> DataFrame:
    """An aggregate written as Parquet and CSV, both read back."""
    path = scratch(s, "both")
    counts = reshape.category_totals(_month_shares(s, d)).select("_category", F.col("total").alias("n"))
    files.write_both(counts, path)
    csv = files.read_csv(s, f"{path}.csv").select(F.lit("csv").alias("sink"), F.col("_category"), F.col("n").cast("bigint").alias("n"))
    return csv.unionByName(s.read.parquet(f"{path}.parquet").select(F.lit("parquet").alias("sink"), "_category", "n"))


# ---- filters, labels and numbers ----

_CAND = oracles.candidates(_AT_TRIMMED, _CLASSES["latin"])
_query("language_filter", f"WITH {_CAND} SELECT transcript_id FROM cand WHERE language IN ('ru', 'cyrillic_dominant', 'mixed_cyrillic_latin')")(
    lambda s, d: sampling.candidates(_texts(s, d)).filter(sampling.language_matches(F.col("language"), sampling.language_filters("Russian, RUS"))).select("transcript_id")
)
_query("dialogue_bins", f"WITH {_CAND} SELECT dialogue_bin, count(*) AS n FROM cand GROUP BY 1")(lambda s, d: sampling.candidates(_texts(s, d)).groupBy("dialogue_bin").agg(F.count("*").alias("n")))
_query("quality_bins", f"WITH {_CAND} SELECT quality_bin, count(*) AS n FROM cand GROUP BY 1")(lambda s, d: sampling.candidates(_texts(s, d)).groupBy("quality_bin").agg(F.count("*").alias("n")))
_query(
    "exclusion_union",
    "SELECT DISTINCT trim(transcript_id) AS transcript_id FROM (SELECT transcript_id FROM excluded_ids UNION ALL SELECT transcript_id FROM judge_index) WHERE trim(transcript_id) <> ''",
)(lambda s, d: sampling.excluded_ids([_read(s, d, "excluded_ids"), _read(s, d, "judge_index")]))
_query("failure_mode_names", f"SELECT CASE failure_mode WHEN 'coarse_timestamps' THEN 'Coarse timestamps' ELSE failure_mode END AS failure_mode, count(*) AS n FROM ({_MODE_ROWS}) GROUP BY 1")(
    lambda s, d: trends.renamed_modes(judge.failure_modes(_flat(s, d)), {"coarse_timestamps": "Coarse timestamps"}).groupBy("failure_mode").agg(F.sum("count").alias("n"))
)
_query(
    "normalised_modes",
    "SELECT regexp_replace(lower(trim(m)), '[\\s-]+', '_', 'g') AS mode, count(*) AS n FROM (SELECT unnest(primary_failure_modes) AS m FROM judge_scores) WHERE m IS NOT NULL GROUP BY 1",
)(lambda s, d: _read(s, d, "judge_scores").select(F.explode("primary_failure_modes").alias("m")).filter("m IS NOT NULL").groupBy(judge.normalised_mode(F.col("m")).alias("mode")).agg(F.count("*").alias("n")))
_query(
    "metric_texts",
    "SELECT metric, count(*) AS n, bool_or(metric = 'layer_a_segment_count') AS described FROM (SELECT DISTINCT telegram_user_internal_id, date_trunc('month', created_at_parsed) AS m FROM feature_rows WHERE created_at_parsed IS NOT NULL), (SELECT unnest(['layer_a_segment_count', 'layer_b_total_tokens']) AS metric) GROUP BY 1",
)(
    lambda s, d: trends.describe(
        aggregates.quantiles_long(_features(s, d), ["telegram_user_internal_id", "bucket_month"], ["layer_a_segment_count", "layer_b_total_tokens"]), [{"name": "layer_a_segment_count", "description": "segments"}]
    ).groupBy("metric").agg(F.count("*").alias("n"), F.max(F.col("description").isNotNull()).alias("described"))
)
_query("safe_numbers", "SELECT transcript_id, coalesce(try_cast(trim(transcription_quality_score::VARCHAR) AS DOUBLE), 0.0) AS score, CAST(round_even(coalesce(judge_confidence / 2.0, 0.0), 0) AS BIGINT) AS half FROM judge_scores")(
    lambda s, d: _read(s, d, "judge_scores").select("transcript_id", judge.number(F.col("transcription_quality_score").cast("string")).alias("score"), judge.whole(F.col("judge_confidence") / 2.0).alias("half"))
)
