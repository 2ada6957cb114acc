"""The queries of the training-text operators over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.dates import bucket_day, parse_created_at
from turnwise.llm import language, linespam, markup, mixing, percentiles, pii, quality, repetition, tokens, turns
from turnwise.session import spread

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
LATEST = 253402300799  # the last second of the year 9999; a digest gives the upper end of a range of values


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "sample_multiline"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "documents"))


def _common(spark: SparkSession, d: str) -> list[str]:
    return quality.common_words(spark, f"{d}/common_words.parquet")


def _language_model(spark: SparkSession, d: str) -> dict:
    return language.fit(language.references(spark, f"{d}/lang_reference.parquet", f"{d}/common_words.parquet"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    spoken = _transcripts(spark, d).select("id", markup.spoken(F.col("transcription_text")).alias("_spoken"))
    return language.label_languages(spoken, _language_model(spark, d)).dropDuplicates(["id"])


def _times(spark: SparkSession, d: str) -> DataFrame:
    """(user, day, at): each distinct transcript with a valid time; at in seconds since 1970."""
    at = parse_created_at(F.col("created_at"))
    rows = _read(spark, d, "sample_multiline").select("id", F.col("telegram_user_internal_id").alias("user"), at.alias("ts")).filter(F.col("ts").isNotNull()).distinct()
    return rows.select(F.when(F.trim("user") != "", F.col("user")).alias("user"), bucket_day(F.col("ts")).alias("day"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


def _as_times(q: DataFrame, name: str) -> DataFrame:
    return q.select(F.col("grp").alias(name), "n", "q", F.timestamp_seconds(F.least("value", F.lit(LATEST))).cast("timestamp_ntz").alias("created_at"), "max_rank_error")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of created_at per user and, under the user ``*``, of all transcripts with a time."""
    rows = _times(spark, d).withColumn("user", F.coalesce("user", F.lit("")))
    users = percentiles.build(rows, "at", "user")
    every = percentiles.regroup(users, F.lit("*"))
    return _as_times(percentiles.quantiles(users.filter("grp <> ''").unionByName(every), QUANTILES), "user")


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of created_at per month, merged from the digests of single days."""
    days = percentiles.build(_times(spark, d).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "at", "day")
    return _as_times(percentiles.quantiles(percentiles.regroup(days, F.substring("grp", 1, 7)), QUANTILES), "month")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of ``p3_quality`` that SQL can count too, rounded, and two of the published rules."""
    names = ("mean_word_length", "symbol_ratio", "punctuated_share", "ellipsis_share", "letter_share", "common_share")
    found = quality.text_quality(_transcripts(spark, d), _common(spark, d)).dropDuplicates(["id"])
    rules = [F.array_contains("reasons", r).alias(r) for r in ("too_few_words", "no_common_words")]
    return found.select("id", "n_words", "n_lines", "n_common", *[F.round(c, 6).alias(c) for c in names], *rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": lambda s, d: language.mislabelled(_transcripts(s, d), _read(s, d, "feature_rows"), _language_model(s, d), _common(s, d)),
        "p2_documents": lambda s, d: language.document_languages(_labelled(s, d)),
        "p2_segments": lambda s, d: language.segments(_labelled(s, d)),
        "p3_found": lambda s, d: quality.junk_transcripts(_transcripts(s, d), _common(s, d)),
        "p3_quality": lambda s, d: quality.text_quality(_transcripts(s, d), _common(s, d)).dropDuplicates(["id"]),
        "p3_statistics": p3_statistics,
        "p4_percentiles": p4_percentiles,
        "p4_days": p4_days,
        "p5_found": lambda s, d: pii.personal_information(_transcripts(s, d)),
        "p5_redacted": lambda s, d: pii.redacted(_transcripts(s, d)),
        "p6_found": lambda s, d: turns.speaker_turns(_transcripts(s, d), _common(s, d), with_text=False),
        "p6_turns": lambda s, d: turns.speaker_turns(_transcripts(s, d), _common(s, d)),
        "p6_templates": lambda s, d: turns.mine(_transcripts(s, d)),
        "p7_found": lambda s, d: repetition.repetitive(_transcripts(s, d)),
        "p7_shares": lambda s, d: repetition.repetition_report(_transcripts(s, d)).withColumn("repeated_share", F.round("repeated_share", 6)),
        "p7_lines": lambda s, d: repetition.line_frequency(_read(s, d, "sample_multiline")),
        "p8_ids": lambda s, d: tokens.token_ids(_documents(s, d)),
        "p9_mix": lambda s, d: mixing.mix(mixing.sized(_documents(s, d)), _read(s, d, "mix_targets")),
        "p9_report": lambda s, d: mixing.mix_report(mixing.sized(_documents(s, d)), _read(s, d, "mix_targets")),
        "p10_found": lambda s, d: linespam.spam_pages(_documents(s, d), _common(s, d)),
        "p10_shapes": lambda s, d: linespam.line_shapes(_documents(s, d), _common(s, d)),
    }
