"""Wide to long and long to wide, and small tables for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(wide: DataFrame, bucket: str) -> DataFrame:
    """(time_bucket, metric, median, q1, q3, n_rows_per_bucket) from an aggregate with ``{metric}_median``, ``_q1`` and ``_q3``.

    Metrics without all three are left out; without any metric the result is empty. Times print as text, years outside 0 to 9999 as
    plain numbers.
    """
    names = set(wide.columns)
    metrics = [c[: -len("_median")] for c in wide.columns if c.endswith("_median") and {c[:-7] + "_q1", c[:-7] + "_q3"} <= {*names, *(x for x in names)}]
    metrics = [m for m in metrics if f"{m}_q1" in names and f"{m}_q3" in names]
    kind = dict(wide.dtypes)[bucket]
    year = F.when(F.year(bucket).between(0, 9999), F.lpad(F.year(bucket).cast("string"), 4, "0")).otherwise(F.year(bucket).cast("string"))
    label = F.concat(year, F.date_format(bucket, "-MM-dd HH:mm:ss")) if kind.startswith("timestamp") else F.col(bucket).cast("string")
    entries = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{p}").cast("double").alias(p) for p in ("median", "q1", "q3")]) for m in metrics]
    if not entries:
        empty = F.struct(F.lit("").alias("metric"), *[F.lit(0.0).alias(p) for p in ("median", "q1", "q3")])
        entries = [F.slice(F.array(empty), 1, 0)[0]]
        rows = wide.limit(0).select(label.alias("time_bucket"), F.explode(F.array(*entries)).alias("m"), F.col("n_rows").alias("n_rows_per_bucket"))
    else:
        rows = wide.select(label.alias("time_bucket"), F.explode(F.array(*entries)).alias("m"), F.col("n_rows").alias("n_rows_per_bucket"))
    return rows.select("time_bucket", "m.metric", "m.median", "m.q1", "m.q3", "n_rows_per_bucket")


def share_pivot(shares: DataFrame, bucket: str, categories: list[str] | None = None, percent: bool = False) -> DataFrame:
    """One row per bucket and one column per category; a missing share is 0. ``percent`` gives rounded percentages."""
    value = F.bround(F.first("share") * 100, 2) if percent else F.first("share")
    return shares.groupBy(bucket).pivot("_category", categories).agg(value).na.fill(0.0)


def top_categories_and_other(shares: DataFrame, bucket: str, k: int = 12, other: str = "(other languages)") -> DataFrame:
    """(bucket, _category, share): the k categories with the largest sum of shares keep their names, the rest are folded."""
    totals = shares.groupBy("_category").agg(F.sum("share").alias("total"))
    rank = F.row_number().over(Window.orderBy(F.desc("total"), F.asc("_category")))  # a row per category, not per record
    kept = totals.withColumn("keep", rank <= k).select("_category", "keep")
    named = shares.join(kept, "_category").withColumn("_category", F.when(F.col("keep"), F.col("_category")).otherwise(F.lit(other)))
    return named.groupBy(bucket, "_category").agg(F.sum("share").alias("share"))


def category_totals(shares: DataFrame) -> DataFrame:
    """(_category, total) over all buckets."""
    return shares.groupBy("_category").agg(F.sum("n_in_category").alias("total"))


def filled_shares(shares: DataFrame, bucket: str) -> DataFrame:
    """Every category in every bucket, 0 where it is missing: buckets and categories are few, unlike rows."""
    seen = shares.groupBy().agg(F.collect_set("_category").alias("_c"), F.collect_set(bucket).alias("_b"))
    every = seen.select(F.explode("_c").alias("_category"), "_b").select("_category", F.explode("_b").alias(bucket))
    return every.join(shares.select(bucket, "_category", "share"), [bucket, "_category"], "left").na.fill(0.0, ["share"])


def share_spans(shares: DataFrame, bucket: str, min_total_share: float = 0.02, min_span: float = 0.025, k: int = 3) -> DataFrame:
    """(_category, total_share, span): the categories whose share moves most between buckets, those large enough only."""
    totals = category_totals(shares)
    whole = totals.withColumn("total_share", F.col("total") / F.sum("total").over(Window.partitionBy()))
    spans = filled_shares(shares, bucket).groupBy("_category").agg((F.max("share") - F.min("share")).alias("span"))
    return spans.join(whole, "_category").filter((F.col("total_share") >= min_total_share) & (F.col("span") >= min_span)).select("_category", "total_share", "span").orderBy(F.desc("span"), "_category").limit(k)
