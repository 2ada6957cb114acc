"""Rollups over time buckets, users and categories; distributions and histograms.

Exact percentiles with linear interpolation, nulls ignored, by ``skew.ranked_quantiles``: no group's values are gathered in one
task. Shares use a window over counts, never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.dates import bucket_day, bucket_iso_week, bucket_month, parse_created_at
from turnwise.operators.skew import ranked_quantiles

QUARTILES = (0.5, 0.25, 0.75)
EDGES_MINUTES = (0, 1, 2, 3, 5, 8, 12, 20, 30, 45, 60, 90, 120, 180)
PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def add_buckets(df: DataFrame, ts: str = "created_at_parsed") -> DataFrame:
    """Adds bucket_day, bucket_iso_week and bucket_month."""
    return df.withColumns({"bucket_day": bucket_day(F.col(ts)), "bucket_iso_week": bucket_iso_week(F.col(ts)), "bucket_month": bucket_month(F.col(ts))})


def valid_times(df: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Rows with a readable time, with created_at_parsed and the three buckets."""
    return add_buckets(df.withColumn("created_at_parsed", parse_created_at(F.col(created_at))).filter(F.col("created_at_parsed").isNotNull()))


def aggregate_buckets(df: DataFrame, keys: str | list[str], metrics: Sequence[str], nan_last: bool = False) -> DataFrame:
    """Per group ``n_rows`` (all rows) and the median and quartiles of each metric that is there. A null key is a group.

    NaN is ignored, or, with ``nan_last``, the largest value, as in SQL.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    there = [m for m in metrics if m in df.columns]
    if not there:
        return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    long = ranked_quantiles(df, keys, there, nan_last=nan_last)
    wide = [F.max(F.when(F.col("metric") == m, F.col(f"q_{i}"))).alias(f"{m}_{name}") for m in there for i, name in enumerate(("median", "q1", "q3"))]
    return long.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), *wide)


def quantiles_long(df: DataFrame, keys: str | list[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, n_rows, median, q1, q3): the same numbers, one row per group and metric."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return ranked_quantiles(df, keys, [m for m in metrics if m in df.columns]).withColumnsRenamed({"q_0": "median", "q_1": "q1", "q_2": "q3"})


def aggregate_user_month(df: DataFrame, metrics: Sequence[str], user: str = "telegram_user_internal_id", month: str = "bucket_month") -> DataFrame:
    return aggregate_buckets(df, [user, month], metrics)


def category_share(df: DataFrame, bucket: str, category: str) -> DataFrame:
    """(bucket, _category, n_in_category, n_in_bucket, share); a null or empty category counts as ``(null)``."""
    named = F.when(F.col(category).isNull() | (F.col(category) == ""), "(null)").otherwise(F.col(category))
    counts = df.groupBy(bucket, named.alias("_category")).agg(F.count("*").alias("n_in_category"))
    total = F.sum("n_in_category").over(Window.partitionBy(bucket))
    return counts.withColumn("n_in_bucket", total).withColumn("share", F.col("n_in_category") / F.col("n_in_bucket"))


def daily_total(df: DataFrame, value: str = "layer_a_duration_covered_seconds", ts: str = "created_at_parsed") -> DataFrame:
    """(bucket_day, total_seconds, n_rows) of rows with a time."""
    rows = df.filter(F.col(ts).isNotNull())
    return rows.groupBy(bucket_day(F.col(ts)).alias("bucket_day")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total_seconds"), F.count("*").alias("n_rows"))


def created_range(df: DataFrame, created_at: str = "created_at") -> DataFrame:
    """One row: rows read, rows without a readable time, earliest and latest time as text."""
    at = parse_created_at(F.col(created_at))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.agg(
        F.count("*").alias("rows_read"), F.count_if(at.isNull()).alias("rows_dropped_null_ts"), text(F.min(at)).alias("created_at_min"), text(F.max(at)).alias("created_at_max")
    )


def _beside_quantiles(df: DataFrame, keys: list[str], value: str, at: Sequence[float], *columns: Column) -> DataFrame:
    """Aggregates of the rows that have a value, per group (or one row for all), beside its quantiles ``q_0``, ``q_1``, ..."""
    rows = df.filter(F.col(value).isNotNull())
    quantiles = ranked_quantiles(rows, keys, [value], tuple(at)).drop("metric", "n_rows")
    plain = rows.groupBy(*keys).agg(*columns)
    if not keys:  # one row on either side
        return plain.withColumn("_one", F.lit(1)).join(quantiles.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    named = quantiles.withColumnsRenamed({k: f"_{k}" for k in keys})
    return plain.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, median, population variance and deviation, min, max and nine percentiles per group (or of all rows)."""
    x = F.col(value).cast("double")
    gathered = _beside_quantiles(
        df, keys or [], value, PERCENTILES, F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    points = [F.col(f"q_{i}").alias(f"p{round(q * 100):02d}") for i, q in enumerate(PERCENTILES)]
    return gathered.select(*(keys or []), "n", "mean", F.col("q_4").alias("median"), "variance", "stddev", "min", "max", *points)


def trailing_days(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` before the latest time, which is read first, so that the filter reaches the scan."""
    latest = df.agg(F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    if latest is None:
        return df.limit(0)
    return df.filter(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{latest}' - INTERVAL {int(days)} DAYS"))


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    return df.filter(F.col(ts).between(start, end))


def minutes_bin(minutes: Column, edges: Sequence[int] = EDGES_MINUTES) -> Column:
    """Index of the bin [left, right) a value falls in, the last bin closed; null outside."""
    out = F.when((minutes >= edges[-2]) & (minutes <= edges[-1]), F.lit(len(edges) - 2))
    for i in range(len(edges) - 3, -1, -1):
        out = F.when((minutes >= edges[i]) & (minutes < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, seconds: str, keys: list[str] | None = None, edges: Sequence[int] = EDGES_MINUTES) -> DataFrame:
    """(keys, bin, left, right, count) of durations in minutes over fixed edges; values outside are dropped."""
    bins = F.array(*[F.lit(e) for e in edges])
    counted = df.withColumn("bin", minutes_bin(F.col(seconds) / 60.0, edges)).filter(F.col("bin").isNotNull()).groupBy(*(keys or []), "bin").agg(F.count("*").alias("count"))
    return counted.withColumns({"left": bins[F.col("bin")], "right": bins[F.col("bin") + 1]}).select(*(keys or []), "bin", "left", "right", "count")


def tail_shares(df: DataFrame, seconds: str, keys: list[str] | None = None) -> DataFrame:
    """Short and long shares from the histogram bins (values beyond the last edge count only in n), tail ratio and spread."""
    rows = df.withColumn("_bin", minutes_bin(F.col(seconds) / 60.0))
    out = _beside_quantiles(rows, keys or [], seconds, (0.25, 0.5, 0.75, 0.95), F.count("*").alias("n"), F.count_if(F.col("_bin") < 3).alias("_short"), F.count_if(F.col("_bin") >= 8).alias("_long"))
    return out.select(
        *(keys or []), "n", (F.col("_short") / F.col("n")).alias("share_3min_or_less"), (F.col("_long") / F.col("n")).alias("share_30min_or_more"),
        F.when(F.col("q_1") != 0, F.col("q_3") / F.col("q_1")).alias("tail_ratio"), (F.col("q_2") - F.col("q_0")).alias("iqr"),
    )


def top_k(counts: DataFrame, label: str, k: int, keys: list[str] | None = None, n: str = "n") -> DataFrame:
    """The k largest labels (per group), ties by label."""
    if not keys:
        return counts.orderBy(F.desc(n), F.asc(label)).limit(k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), F.asc(label)))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def first_last_delta(df: DataFrame, value: str, order: str, keys: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Last minus first value by ``order``, rounded; 0.0 with fewer than two rows."""
    out = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.max_by(value, order).alias("_last"), F.min_by(value, order).alias("_first"))
    return out.select(*(keys or []), "n", F.when(F.col("n") < 2, 0.0).otherwise(F.bround(F.col("_last") - F.col("_first"), digits)).alias("delta"))
