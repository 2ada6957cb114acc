"""Per-transcript features: layer A (structure and time) and layer B (text, script, language, file and category).

Everything is an expression on the transcript's own row, so features are one scan and one projection however large the
table is. Segments are bound once and every feature reads the bound array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import category
from turnwise.operators.language import detect
from turnwise.operators.segments import body_text, bodies, parse_segments, separator_count

LAYER_A = (
    "segment_count", "separator_count", "distinct_speakers", "median_words_per_segment", "median_chars_per_segment", "max_words_per_segment",
    "malformed_timestamp_ratio", "duplicate_adjacent_segment_ratio", "speaker_switch_count", "speaker_switch_rate", "unreasonable_speaker_churn",
    "duration_covered_seconds", "duration_span_seconds", "duration_coverage_ratio", "segments_with_duration_ratio",
)
LAYER_A_VERSION, LAYER_B_VERSION = "layer_a_v3", "layer_b_v3"


def _pairs(items: Column, equal) -> Column:
    """How many neighbours of an array satisfy ``equal``."""
    after = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    before = F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))
    return F.size(F.filter(F.zip_with(before, after, equal), lambda x: x)).cast("bigint")


def layer_a(segments: Column, text: Column) -> dict[str, Column]:
    """The 15 structural columns by name, without prefix. Blank text: counts 0, medians null, ratios 0.0."""
    n = F.size(segments).cast("bigint")
    least_one = F.greatest(n, F.lit(1))
    named = F.filter(F.transform(segments, lambda s: s["speaker"]), lambda x: x.isNotNull())
    words = F.transform(segments, lambda s: F.size(T.tokens(s["body"])).cast("bigint"))
    chars = F.transform(segments, lambda s: F.length(s["body"]).cast("bigint"))
    broken = F.filter(segments, lambda s: s["speaker"].isNotNull() & (s["malformed"] | ~s["has_timestamp"]))
    said = F.filter(F.transform(segments, lambda s: T.normalise_body(s["body"])), lambda b: b != "")
    switches = _pairs(named, lambda a, b: a != b)
    timed = F.filter(segments, lambda s: s["start_s"].isNotNull() & s["end_s"].isNotNull() & (s["end_s"] > s["start_s"]))
    covered = F.aggregate(timed, F.lit(0.0), lambda a, s: a + s["end_s"] - s["start_s"])
    span = F.coalesce(F.array_max(F.transform(timed, lambda s: s["end_s"])) - F.array_min(F.transform(timed, lambda s: s["start_s"])), F.lit(0.0))
    return {
        "segment_count": n,
        "separator_count": F.when(T.strip(text) == "", F.lit(0)).otherwise(separator_count(text)).cast("bigint"),
        "distinct_speakers": F.size(F.array_distinct(named)).cast("bigint"),
        "median_words_per_segment": T.array_median(words),
        "median_chars_per_segment": T.array_median(chars),
        "max_words_per_segment": F.array_max(words),
        "malformed_timestamp_ratio": F.size(broken) / least_one,
        "duplicate_adjacent_segment_ratio": F.when(F.size(said) > 1, _pairs(said, lambda a, b: a == b) / (F.size(said) - 1)).otherwise(0.0),
        "speaker_switch_count": switches,
        "speaker_switch_rate": switches / least_one,
        # kept as defined although switches never exceed segments: always false
        "unreasonable_speaker_churn": (switches > F.greatest(F.lit(5), n)) & (switches / least_one > 0.8),
        "duration_covered_seconds": covered,
        "duration_span_seconds": span,
        "duration_coverage_ratio": F.when(span > 0, covered / span).otherwise(0.0),
        "segments_with_duration_ratio": F.size(timed) / least_one,
    }


def layer_b(segments: Column, text: Column, body: Column, words: Column, types: Column, scripts: Column, lang: Column, file_name: Column, cat: Column) -> dict[str, Column]:
    """The 28 text columns by full name. ``words`` are the tokens of ``body``, ``types`` their type counts; blank bodies have the category ``unknown``."""
    empty = body == ""
    n = F.size(words).cast("bigint")
    lengths = T.word_lengths(words)
    out = {
        "layer_b_unicode_replacement_count": T.replacement_count(body),
        "layer_b_control_char_count": T.control_count(body),
        "layer_b_zero_width_count": T.zero_width_count(body),
        "layer_b_nonprintable_ratio": T.nonprintable_ratio(body),
        "layer_b_repeated_char_run_ratio": T.repeated_char_run_ratio(body),
        "layer_b_total_tokens": n,
        "layer_b_unique_tokens": F.size(F.array_distinct(words)).cast("bigint"),
        "layer_b_type_token_ratio": T.type_token_ratio(words),
        "layer_b_hapax_ratio": T.hapax_ratio(words, types),
        "layer_b_word_entropy_bits": T.entropy_bits(words, types),
        "layer_b_mean_word_length": T.array_mean(lengths),
        "layer_b_median_word_length": T.array_median(lengths),
        "layer_b_long_word_ratio": T.long_word_ratio(words),
        "layer_b_short_utterance_ratio": T.short_utterance_ratio(bodies(segments)),
        "layer_b_primary_language": F.when(empty, "").otherwise(lang["iso"]),
        "layer_b_primary_language_confidence": F.when(empty, 0.0).otherwise(lang["confidence"]),
        "layer_b_language_mixed": F.when(empty, False).otherwise(lang["mixed"]),
    }
    out |= {f"content_script_{s}_ratio": scripts[s] for s in ("cyrillic", "latin", "cjk", "arabic", "digit", "other")}
    return out | {
        "content_file_extension": T.file_extension(file_name),
        "content_file_basename_token_count": T.basename_token_count(file_name),
        "content_file_path_depth": T.path_depth(file_name),
        "content_primary_category": F.when(empty, "unknown").otherwise(cat["primary"]),
        "content_category_confidence": F.when(empty, 0.0).otherwise(cat["confidence"]),
    }


LAYER_B_NUMERIC = tuple(
    f"layer_b_{c}" for c in ("unicode_replacement_count", "control_char_count", "zero_width_count", "nonprintable_ratio", "repeated_char_run_ratio", "total_tokens", "unique_tokens", "type_token_ratio", "hapax_ratio", "word_entropy_bits", "mean_word_length", "median_word_length", "long_word_ratio", "short_utterance_ratio", "primary_language_confidence", "language_mixed")
) + tuple(f"content_script_{s}_ratio" for s in ("cyrillic", "latin", "cjk", "arabic", "digit", "other")) + ("content_file_basename_token_count", "content_category_confidence")


DOUBLES = tuple(
    [f"layer_a_{c}" for c in LAYER_A if c.startswith(("median", "duration")) or c.endswith(("_ratio", "_rate"))]
    + [c for c in LAYER_B_NUMERIC if not c.endswith(("_count", "_tokens", "_mixed"))]
)


def metric_columns(with_b: bool = True) -> list[str]:
    """The numeric columns that roll up into quantiles."""
    return [f"layer_a_{c}" for c in LAYER_A] + (list(LAYER_B_NUMERIC) if with_b else [])


def add_features(df: DataFrame, text: str = "transcription_text", file_name: str | None = "file_name", with_b: bool = True, languages: dict[str, list[str]] | None = None, max_chars: int = 0) -> DataFrame:
    """``df`` with the layer A and, if asked for, layer B columns. Booleans become 0 and 1. Other columns pass through.

    Languages are told from whole texts, or from samples of ``max_chars`` characters if that is positive.
    """
    out = df.withColumn("_segs", parse_segments(F.col(text)))
    out = out.withColumns({f"layer_a_{k}": v for k, v in layer_a(F.col("_segs"), F.col(text)).items()})
    if with_b:
        named = F.col(file_name) if file_name and file_name in df.columns else F.lit(None).cast("string")
        out = (
            out.withColumn("_body", body_text(F.col("_segs")))
            .withColumns({"_words": T.tokens(F.col("_body")), "_scripts": T.script_ratios(F.col("_body")), "_lang": detect(T.detection_sample(F.col("_body"), max_chars), languages), "_cat": category.classify(F.col("_segs"))})
            .withColumn("_types", T.type_counts(F.col("_words")))
            .withColumns(layer_b(F.col("_segs"), F.col(text), F.col("_body"), F.col("_words"), F.col("_types"), F.col("_scripts"), F.col("_lang"), named, F.col("_cat")))
            .drop("_body", "_words", "_types", "_scripts", "_lang", "_cat")
        )
    flags = {c: F.col(c).cast("tinyint") for c in out.columns if c in ("layer_a_unreasonable_speaker_churn", "layer_b_language_mixed")}
    return out.withColumns(flags).drop("_segs")
