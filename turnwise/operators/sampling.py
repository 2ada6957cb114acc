"""A deterministic stratified sample of transcripts per month for review.

Cheap features come from the raw text by pattern counts. Per month, strata are (category, language, length, dialogue); the
sample takes the most typical transcript of the largest strata, then of the month, then of the rarest strata, then one
outlier, then fills up. Ties are settled by a seeded hash of the transcript id, so the sample does not depend on the order
of rows or the number of tasks. Every step is a window over (month, stratum) with row numbers; no month is gathered in Python.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions.dates import month_key, parse_created_at
from turnwise.operators.category import KEYWORDS
from turnwise.operators.skew import ranked_quantiles
from turnwise.session import small, stash

# fixed values: patterns of the cheap features
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:\.\d+)?"
TIMES = rf"\[\s*{_CLOCK}\s*[-–—]\s*{_CLOCK}\s*\]|(?m:^)\s*{_CLOCK}\s*[-–—]\s*{_CLOCK}:"
SPEAKERS = r"(?im)^\s*\[?\s*(SPEAKER_\d+|SPEAKER_[A-Z]{1,3})\s*\]?\s*$"
SEPARATORS = r"(?m)^-{20,}\s*$"
WORDS = r"\p{L}{2,}(?:['-]\p{L}+)?"

# fixed values: other names of language filters
LANGUAGE_ALIASES = {"russian": "ru", "rus": "ru", "ru-ru": "ru", "cyrillic": "cyrillic_dominant", "cyrillic-heavy": "cyrillic_dominant"}


def length_bin(n: Column) -> Column:
    """The limits of this and the two bins below are fixed values."""
    return F.when(n < 20, "very_short").when(n < 120, "short").when(n < 500, "medium").when(n < 1200, "long").otherwise("very_long")


def dialogue_bin(speakers: Column, segments: Column) -> Column:
    return F.when(speakers <= 1, "monologue_or_single_speaker").when(speakers > 2, "multi_speaker").when(segments < 20, "two_speaker_light").otherwise("two_speaker_dense")


def quality_bin(malformed: Column, replaced: Column, nonprintable: Column, churn: Column, runs: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    bad = (zero(malformed) > 0.2) | (zero(replaced) > 0) | (zero(nonprintable) > 0.01) | F.coalesce(churn, F.lit(False))
    return F.when(bad, "structural_or_text_anomaly").when((zero(malformed) > 0) | (zero(runs) > 0.05), "minor_artifact_signal").otherwise("typical")


def windows_sample(text: Column, max_chars: int) -> Column:
    """The whole text or, with a positive ``max_chars``, three windows of a longer one."""
    if max_chars <= 0:
        return text
    wing = max_chars // 3
    start = F.greatest(F.lit(0), F.floor(F.length(text) / 2) - wing // 2).cast("int")
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, wing), F.substring(text, start + 1, F.lit(wing)), F.right(text, F.lit(wing))))


def script_proxy(sample: Column) -> Column:
    """(language, confidence, mixed) by scripts only."""
    classes = {"cyrillic": r"[\x{0400}-\x{052F}]", "latin": T.LATIN, "cjk": r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]", "arabic": r"[\x{0600}-\x{08FF}&&[^\p{Nd}]]", "rest": r"[\p{L}\p{Nd}]"}

    def pick(s: Column) -> Column:
        total = F.greatest(F.lit(1), s["cyrillic"] + s["latin"] + s["cjk"] + s["arabic"] + s["rest"])
        share = {k: s[k] / total for k in ("cyrillic", "latin", "cjk", "arabic")}
        mixed = (share["cyrillic"] >= 0.2) & (share["latin"] >= 0.2)
        best = F.greatest(*share.values())
        name = F.lit("unknown")
        for k in reversed(share):
            name = F.when((share[k] == best) & (best > 0), f"{k}_dominant").otherwise(name)
        return F.struct(
            F.when(mixed, "mixed_cyrillic_latin").otherwise(name).alias("language"),
            F.when(mixed, F.least(F.lit(1.0), share["cyrillic"] + share["latin"])).otherwise(best).alias("confidence"),
            mixed.alias("mixed"),
        )

    return T.class_counts(sample, classes, lambda counts: T.bind(counts, pick))


def cheap_category(sample: Column, n_words: Column, speakers: Column, switches: Column) -> Column:
    """(category, confidence) by stems that occur anywhere; ties go to the later name."""
    def best_of(low: Column) -> Column:
        rows = []
        for name, words in KEYWORDS.items():
            hits = F.lit(0)
            for w in words:
                hits = hits + F.contains(low, F.lit(w)).cast("int")
            rows.append(F.struct(hits.alias("n"), F.lit(name).alias("c")))
        return F.array_max(F.array(*rows))

    talk = (speakers >= 2) & (switches >= 3)

    def name(best: Column) -> Column:
        hit = best["n"] > 0
        return F.struct(
            F.when(hit, best["c"]).when(talk, "dialogue_meeting").when(n_words < 15, "short_note").when(n_words < 60, "quick_message").otherwise("general_monologue").alias("category"),
            F.when(hit, F.least(F.lit(1.0), best["n"] / 4)).when(talk, F.least(F.lit(1.0), F.log1p(switches) / math.log1p(20))).when(n_words < 15, 0.6).when(n_words < 60, 0.5).otherwise(0.4).alias("confidence"),
        )

    return T.bind(T.bind(F.lower(sample), best_of), name)


def _identified(df: DataFrame, key: str, created_at: str, text: str) -> DataFrame:
    """(transcript_id, month, created_at, text) of rows with a readable time."""
    base = df.withColumn("_at", parse_created_at(F.col(created_at), trim=True)).filter(F.col("_at").isNotNull())
    fallback = F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string"))  # the row's place in the table
    return base.select(
        F.when(F.trim(key) != "", F.trim(key)).otherwise(fallback).alias("transcript_id"), month_key(F.col("_at")).alias("month"), F.trim(created_at).alias("created_at"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def candidates(df: DataFrame, key: str = "id", created_at: str = "created_at", text: str = "transcription_text", sample_chars: int = 0) -> DataFrame:
    """Rows with a readable time as candidates: transcript_id, month, created_at, cheap features and strata.

    Scripts, categories and oddities are told from whole texts, or from windows of ``sample_chars`` characters if that is positive.

    A missing id falls back to the row's place. Of rows of one id the one with the least hash of its content stays; texts are not
    shuffled for that.
    """
    base = _identified(df, key, created_at, text)
    heads = F.transform(F.regexp_extract_all("text", F.lit(SPEAKERS), 1), lambda x: F.upper(x))
    base = base.withColumns({"_rank": F.xxhash64("created_at", "text"), "_sample": windows_sample(F.col("text"), sample_chars), "_heads": heads, "n_times": T.count(F.col("text"), TIMES), "n_separators": T.count(F.col("text"), SEPARATORS), "total_tokens": T.count(F.col("text"), WORDS)})
    before, after = F.slice("_heads", 1, F.greatest(F.size("_heads") - 1, F.lit(0))), F.slice("_heads", 2, F.greatest(F.size("_heads") - 1, F.lit(0)))
    base = base.withColumns(
        {
            "n_heads": F.size("_heads").cast("bigint"),
            "distinct_speakers": F.size(F.array_distinct("_heads")).cast("bigint"),
            "speaker_switch_count": F.size(F.filter(F.zip_with(before, after, lambda a, b: a != b), lambda x: x)).cast("bigint"),
            "nonprintable_ratio": T.nonprintable_ratio(F.col("_sample")),
            "repeated_char_run_ratio": T.repeated_char_run_ratio(F.col("_sample")),
            "unicode_replacement_count": T.replacement_count(F.col("_sample")),
            "_script": script_proxy(F.col("_sample")),
        }
    )
    base = base.withColumn("segment_count", F.greatest("n_times", "n_heads", "n_separators"))
    malformed = F.when(F.col("n_heads") == 0, 0.0).when(F.col("n_times") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), (F.col("n_heads") - F.col("n_times")) / F.col("n_heads")))
    base = base.withColumns(
        {
            "malformed_timestamp_ratio": malformed,
            "speaker_switch_rate": F.col("speaker_switch_count") / F.greatest(F.lit(1), F.col("segment_count")),
            "unreasonable_speaker_churn": F.col("speaker_switch_count") > F.greatest(F.lit(5), F.col("segment_count")),
            "_cat": cheap_category(F.col("_sample"), F.col("total_tokens"), F.col("distinct_speakers"), F.col("speaker_switch_count")),
        }
    )
    full = base.withColumns(
        {
            "language": F.col("_script.language"),
            "language_confidence": F.col("_script.confidence"),
            "content_category": F.col("_cat.category"),
            "category_confidence": F.col("_cat.confidence"),
            "length_bin": length_bin(F.col("total_tokens")),
            "dialogue_bin": dialogue_bin(F.col("distinct_speakers"), F.col("segment_count")),
            "quality_bin": quality_bin(F.col("malformed_timestamp_ratio"), F.col("unicode_replacement_count"), F.col("nonprintable_ratio"), F.col("unreasonable_speaker_churn"), F.col("repeated_char_run_ratio")),
        }
    ).drop("text", "_sample", "_heads", "_script", "_cat", "n_times", "n_separators", "n_heads")
    rest = [c for c in full.columns if c not in ("transcript_id", "_rank")]
    return full.groupBy("transcript_id").agg(F.min_by(F.struct(*rest), F.struct("_rank", *rest)).alias("_r")).select("transcript_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def excluded_ids(tables: list[DataFrame]) -> DataFrame:
    """The ids of several tables (column transcript_id) once each, trimmed; null and blank ids are left out."""
    ids = functools.reduce(DataFrame.union, [t.select(F.trim("transcript_id").alias("transcript_id")) for t in tables])
    return ids.filter("transcript_id <> ''").distinct()


def exclude(df: DataFrame, excluded: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Rows whose id is in none of the given ids (trimmed; null and blank ids exclude nothing)."""
    ids = excluded_ids([excluded]).withColumnRenamed("transcript_id", key)
    return df.join(ids, key, "left_anti")


def language_filters(text: str, russian_only: bool = False) -> list[str]:
    names = [LANGUAGE_ALIASES.get(x.strip().lower(), x.strip().lower()) for x in text.split(",") if x.strip()]
    return list(dict.fromkeys(names + (["ru"] if russian_only else [])))


def language_matches(language: Column, filters: list[str]) -> Column:
    """Whether a script label passes the filters; language codes pass the scripts they are written in."""
    ok = language.isin(filters) if filters else F.lit(True)
    if "ru" in filters:
        ok = ok | language.isin("cyrillic_dominant", "mixed_cyrillic_latin")
    if "en" in filters:
        ok = ok | language.isin("latin_dominant", "mixed_cyrillic_latin")
    return ok


def valid_run_id(run_id: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id))


def month_center(df: DataFrame) -> DataFrame:
    """Per month the medians of words, segments, speakers and malformed share, 0.0 where there are none."""
    names = {"total_tokens": "center_tokens", "segment_count": "center_segments", "distinct_speakers": "center_speakers", "malformed_timestamp_ratio": "center_malformed"}
    long = ranked_quantiles(df, ["month"], list(names), (0.5,))
    return long.groupBy("month").agg(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("q_0"))), F.lit(0.0)).alias(c) for m, c in names.items()])


def distance() -> Column:
    """How far a candidate is from its month's center; the weights are fixed values."""
    logs = lambda a, b: F.abs(F.log1p(F.col(a)) - F.log1p(F.col(b)))
    return logs("total_tokens", "center_tokens") + logs("segment_count", "center_segments") + 0.4 * F.abs(F.col("distinct_speakers") - F.col("center_speakers")) + 2.0 * F.abs(F.col("malformed_timestamp_ratio") - F.col("center_malformed"))


def anomaly() -> Column:
    """How odd a candidate is; the weights are fixed values."""
    outlier = F.abs(F.log1p("total_tokens") - F.log1p(F.greatest(F.col("center_tokens"), F.lit(1.0))))
    return (
        5.0 * F.col("malformed_timestamp_ratio") + 0.5 * F.col("speaker_switch_rate") + 3.0 * F.col("repeated_char_run_ratio") + 10.0 * F.col("nonprintable_ratio")
        + 0.5 * F.col("unicode_replacement_count") + F.when(F.col("unreasonable_speaker_churn"), 2.0).otherwise(0.0) + 0.2 * outlier
    )


def scored(df: DataFrame) -> DataFrame:
    """Candidates with their month's center, ``distance`` and ``anomaly``. The centers, a row a month, are read first to see that they are few."""
    return df.join(small(month_center(df)), "month").withColumns({"distance": distance(), "anomaly": anomaly()})


def stratified_sample(df: DataFrame, per_month: int = 8, seed: int = 42) -> DataFrame:
    """``per_month`` candidates of each month with a ``selection_reason``; all of a month that has no more.

    Quotas: round(0.65 k) representative, one quality sentinel from k = 4 on, the rest contrastive, then fill.
    """
    if per_month < 1:
        raise ValueError("samples per month must be at least 1")
    k = per_month
    sentinel = 1 if k >= 4 else 0
    representative = max(1, round(k * 0.65))
    contrastive = max(0, k - representative - sentinel)
    stratum = ["content_category", "language", "length_bin", "dialogue_bin"]
    # features are computed from the texts once; what follows reads them several times
    rows = scored(stash(df, "candidates")).withColumn("_tie", F.md5(F.concat(F.lit(f"{seed}:"), F.col("transcript_id"))))
    near = [F.round("distance", 9), F.asc("_tie"), F.asc("transcript_id")]  # what differs by less is a tie
    in_stratum = Window.partitionBy("month", *stratum)
    month = Window.partitionBy("month")
    # only the k best of each stratum and the k most anomalous and most central of a month can ever be chosen; these windows stand on
    # the bare rows, so that each task keeps k rows a group before anything is shuffled
    first = lambda window, *order: rows.withColumn("_c", F.row_number().over(window.orderBy(*order))).filter(F.col("_c") <= k).drop("_c")
    chosen = first(in_stratum, *near).unionByName(first(month, *near)).unionByName(first(month, F.round("anomaly", 9).desc(), F.asc("_tie"), F.asc("transcript_id")))
    sizes = rows.groupBy("month", *stratum).agg(F.count("*").alias("_size"))
    totals = sizes.groupBy("month").agg(F.sum("_size").alias("_month_n"))
    pool = chosen.dropDuplicates(["month", "transcript_id"]).join(sizes, ["month", *stratum]).join(totals, "month")
    # a stratum's best row is in the pool, so its place there is its place among all
    pool = pool.withColumn("_place", F.row_number().over(in_stratum.orderBy(*near)))
    pool = pool.withColumn("selection_reason", F.when(F.col("_month_n") <= k, F.lit("all_available_for_sparse_month")))
    dense = F.col("_month_n") > k

    def choose(p: DataFrame, reason: str, eligible: Column, order: list[Column], upto: Column) -> DataFrame:
        """Marks the first rows of each month in ``order`` among those still open and eligible, as many as ``upto``."""
        open_ = F.col("selection_reason").isNull() & dense & eligible
        rank = F.sum(open_.cast("int")).over(month.orderBy(F.when(open_, 0).otherwise(1), *order, F.asc("transcript_id")).rowsBetween(Window.unboundedPreceding, 0))
        return p.withColumn("_r", F.when(open_, rank)).withColumn("selection_reason", F.when(F.col("_r") <= upto, F.lit(reason)).otherwise(F.col("selection_reason"))).drop("_r")

    taken = F.sum(F.col("selection_reason").isNotNull().cast("int")).over(month)
    pool = choose(pool, "representative_dominant_stratum", F.col("_place") == 1, [F.desc("_size"), F.asc("_tie")], F.lit(representative))
    pool = pool.withColumn("_taken", taken)
    pool = choose(pool, "representative_month_center", F.lit(True), near, representative - F.col("_taken"))
    left = F.row_number().over(in_stratum.orderBy(F.when(F.col("selection_reason").isNull(), 0).otherwise(1), *near))
    pool = pool.withColumn("_first_open", (left == 1) & F.col("selection_reason").isNull())
    pool = choose(pool, "contrastive_rare_stratum", F.col("_first_open"), [F.asc("_size"), F.asc("_tie")], F.lit(contrastive))
    pool = choose(pool, "quality_sentinel", F.lit(True), [F.round("anomaly", 9).desc(), F.asc("_tie")], F.lit(sentinel))
    pool = pool.withColumn("_taken", taken)
    pool = choose(pool, "balanced_fill", F.lit(True), near, F.lit(k) - F.col("_taken"))
    return pool.filter(F.col("selection_reason").isNotNull()).drop("_tie", "_size", "_place", "_month_n", "_taken", "_first_open", "center_tokens", "center_segments", "center_speakers", "center_malformed")


def with_excerpts(sample: DataFrame, df: DataFrame, max_chars: int = 4500, key: str = "id", created_at: str = "created_at", text: str = "transcription_text") -> DataFrame:
    """The sample with ``excerpt`` and ``excerpt_limited`` from the transcripts ``df``; only texts of sampled ids are moved."""
    if max_chars < 1200:
        raise ValueError("excerpts need at least 1200 characters")
    ids = stash(sample, "sample")
    cut = _identified(df, key, created_at, text).join(ids.select("transcript_id"), "transcript_id", "left_semi").dropDuplicates(["transcript_id"]).select("transcript_id", T.excerpt(F.col("text"), max_chars).alias("_e"))
    return ids.join(cut, "transcript_id").withColumns({"excerpt": F.col("_e.excerpt"), "excerpt_limited": F.col("_e.limited")}).drop("_e")
