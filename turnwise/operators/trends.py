"""Small tables for reports: months side by side, movers, labels and descriptions. All inputs are aggregates, a row a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.judge import REPRESENTATIVE, SCORES, modes_list
from turnwise.operators.language import detect
from turnwise.operators.reshape import category_totals, filled_shares

# fixed values: short month names
MONTHS_RU = ("Янв", "Фев", "Мар", "Апр", "Май", "Июн", "Июл", "Авг", "Сен", "Окт", "Ноя", "Дек")


def month_label_ru(month: Column) -> Column:
    """``2024-01`` or a longer date text as ``Янв 2024``; other text stays as it is."""
    number = F.regexp_extract(month, r"^\d{4}-(\d{2})", 1)
    names = F.array(*[F.lit(m) for m in MONTHS_RU])
    known = number.rlike("^(?:0[1-9]|1[0-2])$")
    return F.when(known, F.concat(F.try_element_at(names, F.when(known, number.cast("int")).otherwise(1)), F.lit(" "), F.substring(month, 1, 4))).otherwise(month)


def align_months(months: DataFrame, table: DataFrame, month: str = "month") -> DataFrame:
    """Every listed month with the columns of ``table``, null where it has none."""
    return months.select(month).distinct().join(table, month, "left")


def month_counts(df: DataFrame, month: str = "month") -> DataFrame:
    return df.groupBy(month).agg(F.count("*").alias("n"))


def biggest_mover(shares: DataFrame, bucket: str, leave_out: str = "ru", min_total_share: float = 0.005, min_span: float = 0.008) -> DataFrame:
    """(_category, total_share, span): of all other categories large enough the one whose share moves most; the larger one on ties."""
    whole = category_totals(shares).withColumn("total_share", F.col("total") / F.sum("total").over(Window.partitionBy()))
    spans = filled_shares(shares, bucket).groupBy("_category").agg((F.max("share") - F.min("share")).alias("span"))
    rows = spans.join(whole, "_category").filter((F.col("_category") != leave_out) & (F.col("total_share") >= min_total_share) & (F.col("span") >= min_span))
    return rows.orderBy(F.desc("span"), F.desc("total"), "_category").select("_category", "total_share", "span").limit(1)


def describe(long: DataFrame, entries: list[dict]) -> DataFrame:
    """A long aggregate with the ``description`` of each metric; null for metrics without an entry."""
    texts = long.sparkSession.createDataFrame([(e["name"], e["description"]) for e in entries], "metric string, description string")
    return long.join(F.broadcast(texts), "metric", "left")


def as_text(df: DataFrame) -> DataFrame:
    """Doubles as text with six decimals, for CSV files."""
    return df.select(*[F.format_string("%.6f", F.bround(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def renamed_modes(df: DataFrame, names: dict[str, str], column: str = "failure_mode") -> DataFrame:
    """Failure modes by their given names: as written, else in lower case with underscores, else unchanged."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    plain = F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.trim(column)), F.try_element_at(table, plain), F.trim(column)))


def last_month_panel(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row: the last month against the one before it: weighted text and artefact deltas, the gap between all and typical
    transcripts, how many are strong (every score at least 4) and low (any score at most 2), and how many have coarse times."""
    text, artefact = f"confidence_weighted_mean_{SCORES[0]}", f"confidence_weighted_mean_{SCORES[3]}"
    typical = summaries.filter(F.col("sample_group") == REPRESENTATIVE)
    order = Window.orderBy("month")  # a row per month
    steps = typical.withColumns({"text_delta": F.bround(F.col(text) - F.lag(text).over(order), 3), "artefact_delta": F.bround(F.col(artefact) - F.lag(artefact).over(order), 3)})
    last = steps.orderBy(F.desc("month")).limit(1).select("month", "text_delta", "artefact_delta", F.col(text).alias("_typical"))
    every = summaries.filter(F.col("sample_group") == "all_selected").select("month", F.col(text).alias("_all"))
    low, strong = F.least(*SCORES) <= 2, F.least(*SCORES) >= 4
    counts = rows.groupBy("month").agg(
        F.count_if(strong).alias("n_strong"), F.count_if(low).alias("n_low"), F.count_if(F.array_contains(modes_list(F.col("primary_failure_modes")), "coarse_timestamps")).alias("n_coarse")
    )
    return last.join(every, "month").join(counts, "month").select("month", "text_delta", "artefact_delta", F.bround(F.col("_all") - F.col("_typical"), 3).alias("gap"), "n_strong", "n_low", "n_coarse")


def exact_language(df: DataFrame, filters: list[str], min_confidence: float = 0.5, text: str = "transcription_text") -> DataFrame:
    """Rows whose detected language is listed with enough confidence; adds ``language`` and ``language_confidence``."""
    if not 0 <= min_confidence <= 1:
        raise ValueError("confidence must be between 0 and 1")
    found = df.withColumn("_l", detect(F.col(text)))
    return found.filter(F.col("_l.iso").isin(filters) & (F.col("_l.confidence") >= min_confidence)).withColumns({"language": F.col("_l.iso"), "language_confidence": F.col("_l.confidence")}).drop("_l")
