"""The ad-hoc summary of raw transcripts: quality flags, labels and frequent words per month and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions.dates import month_key, parse_created_at
from turnwise.operators.aggregates import top_k
from turnwise.operators.category import raw_labels, raw_primary, raw_tokens

# fixed values: words that are not counted
STOPWORDS = (
    "это", "как", "что", "или", "для", "все", "только", "когда", "если", "уже", "надо", "будет", "после", "потому",
    "так", "просто", "очень", "меня", "тебя", "себя", "оно", "она", "они", "его", "and", "the", "you", "are",
    "was", "were", "not", "but", "for", "can", "has", "had", "this", "that", "have", "from", "your", "about",
    "there", "they", "them", "then", "also", "just", "into",
)
# fixed values: patterns of the quality flags and the longest counted word
NOISE = r"(?iU)\b(?:ээ+|мм+|uh+|um+|aaa+|ага+)\b|\[(?:noise|music|silence|applause)\]|\b(?:неразборчиво|inaudible|unintelligible)\b"
PLACEHOLDER = r"(?iU)\b(?:тест|test|sample|пример|пусто|без текста)\b"
SPEAKER = r"(?U)\[?SPEAKER_\d{2}\]?"
TIMES = r"(?U)\[\d{2}:\d{2}:\d{2}\s*-\s*\d{2}:\d{2}:\d{2}\]|\d{2}:\d{2}:\d{2}\s*-\s*\d{2}:\d{2}:\d{2}\s*:"
MAX_TOKEN = 25
FLAGS = ("has_speaker", "has_timestamp", "malformed", "noise", "empty", "placeholder")


def quality_flags(text: Column) -> dict[str, Column]:
    """0/1 flags and counts of a raw text. An empty text is empty and malformed, the rest 0."""
    body = T.strip(text)
    full = body != ""
    flag = lambda c: F.when(full & c, 1).otherwise(0)
    speaker, timed = body.rlike(SPEAKER), body.rlike(TIMES)
    dashes = F.contains(body, F.lit("-" * 80))
    size = lambda c: F.when(full, c).otherwise(0).cast("bigint")
    return {
        "empty": F.when(full, 0).otherwise(1),
        "placeholder": flag(body.rlike(PLACEHOLDER)),
        "has_speaker": flag(speaker),
        "has_timestamp": flag(timed),
        "malformed": F.when(~full | (speaker & ~timed) | (dashes & ~speaker), 1).otherwise(0),
        "noise": flag(body.rlike(NOISE)),
        "word_count": F.size(raw_tokens(body)).cast("bigint"),
        "char_count": size(F.length(body)),
        "line_count": size(F.regexp_count(body, F.lit("\n")) + 1),
        "cyr": T.count_chars(F.lower(body), "[а-яёіїє]"),
        "lat": T.count_chars(F.lower(body), "[a-z]"),
    }


def dominance(cyr: Column, lat: Column) -> Column:
    return F.when(cyr > 1.3 * lat, "cyr").when(lat > 1.3 * cyr, "lat").otherwise("mixed")


def raw_rows(df: DataFrame, created_at: str = "created_at", text: str = "transcription_text", tokens_a_row: int | None = None) -> DataFrame:
    """Rows with a readable time: month, flags, counts, labels, primary label and counted words (all, or the first ``tokens_a_row``)."""
    at = parse_created_at(F.col(created_at), trim=True)
    rows = df.select(month_key(at).alias("month"), F.coalesce(text, F.lit("")).alias("_t")).filter(F.col("month").isNotNull())
    kept = F.filter(raw_tokens(F.col("_t")), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) <= MAX_TOKEN))
    kept = kept if tokens_a_row is None else F.slice(kept, 1, tokens_a_row)
    rows = rows.withColumns(quality_flags(F.col("_t"))).withColumns({"labels": raw_labels(F.col("_t")), "words": kept})
    return rows.withColumns({"primary_label": raw_primary(F.col("_t"), F.col("labels")), "dominance": dominance(F.col("cyr"), F.col("lat"))}).drop("_t")


def monthly(rows: DataFrame, overall: bool = False) -> DataFrame:
    """Per month (or of all rows): rows, average words, characters and lines, shares of flags and of script dominance."""
    share = lambda c: F.bround(F.avg(c.cast("double")), 4)
    out = rows.groupBy(*([] if overall else ["month"])).agg(
        F.count("*").alias("n"), *[F.bround(F.avg(c), 2).alias(f"avg_{c}") for c in ("word_count", "char_count", "line_count")],
        *[share(F.col(c)).alias(f"{c}_share") for c in FLAGS],
        *[share(F.when(F.col("dominance") == d, 1).otherwise(0)).alias(f"{d}_dominant_share") for d in ("cyr", "lat", "mixed")],
    )
    return out


def label_distribution(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, primary_label, n, share)."""
    counts = rows.groupBy(*(keys or []), "primary_label").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*(keys or [])))  # over a row per label
    return counts.withColumn("share", F.bround(F.col("n") / whole, 4))


def label_hits(rows: DataFrame, keys: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k labels most rows have; a row can have several."""
    return top_k(rows.select(*(keys or []), F.explode("labels").alias("label")).groupBy(*(keys or []), "label").agg(F.count("*").alias("n")), "label", k, keys)


def frequent_words(rows: DataFrame, keys: list[str] | None = None, k: int = 12) -> DataFrame:
    """The k most frequent words (stop words left out)."""
    return top_k(rows.select(*(keys or []), F.explode("words").alias("word")).groupBy(*(keys or []), "word").agg(F.count("*").alias("n")), "word", k, keys)


def month_trend(months: DataFrame) -> DataFrame:
    """Last minus first month: words, and five shares in percentage points, rounded to 2 places."""
    shares = ("has_speaker_share", "has_timestamp_share", "malformed_share", "noise_share", "empty_share")
    delta = lambda c, f: F.bround((F.max_by(c, "month") - F.min_by(c, "month")) * f, 2)
    return months.agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), delta("avg_word_count", 1).alias("words_delta"), *[delta(c, 100).alias(f"{c}_pp") for c in shares])
