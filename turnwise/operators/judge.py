"""Review results joined to the sample they were made for: validation, monthly summaries, failure modes and trends."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ("transcription_quality_score", "diarization_quality_score", "timestamp_structure_score", "artifact_severity_score")
INDEX_COLUMNS = ("selection_reason", "content_category", "language", "length_bin", "dialogue_bin", "quality_bin", "excerpt_limited")
REPRESENTATIVE = "representative_excluding_sentinel"


def clean_id(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def valid_score(c: Column) -> Column:
    return F.coalesce(c.between(1, 5), F.lit(False))


def index_rows(index: DataFrame) -> DataFrame:
    """One row per transcript id of the sample index; blank ids are left out, of several rows of one id the last by its columns stays."""
    named = index.select(clean_id(F.col("transcript_id")).alias("transcript_id"), "month", *INDEX_COLUMNS).filter(F.col("transcript_id") != "")
    return named.groupBy("transcript_id").agg(F.max(F.struct("month", *INDEX_COLUMNS)).alias("i")).select("transcript_id", "i.*")


def judged_rows(scores: DataFrame) -> DataFrame:
    """Reviews with trimmed ids, each exact repeat once, and how many of their scores are valid (``n_valid``, out of five)."""
    named = scores.withColumn("transcript_id", clean_id(F.col("transcript_id"))).filter(F.col("transcript_id") != "")
    checks = [valid_score(F.col(c)).cast("int") for c in (*SCORES, "judge_confidence")]
    return named.select("transcript_id", "month", *SCORES, "judge_confidence", "primary_failure_modes", F.trim(F.coalesce("evidence", F.lit(""))).alias("evidence"), sum(checks[1:], checks[0]).alias("n_valid")).distinct()


def missing_reviews(scores: DataFrame, index: DataFrame) -> DataFrame:
    """Ids of the sample without a review."""
    return index_rows(index).select("transcript_id").join(judged_rows(scores).select("transcript_id"), "transcript_id", "left_anti")


def extra_reviews(scores: DataFrame, index: DataFrame) -> DataFrame:
    """Ids of reviews that are not in the sample."""
    return judged_rows(scores).select("transcript_id").distinct().join(index_rows(index).select("transcript_id"), "transcript_id", "left_anti")


def duplicate_reviews(scores: DataFrame) -> DataFrame:
    """(transcript_id, n): ids with more than one different review."""
    return judged_rows(scores).groupBy("transcript_id").agg(F.count("*").alias("n")).filter("n > 1")


def modes_text(modes: Column) -> Column:
    """The modes, trimmed and without blanks, joined by ``|``."""
    return F.array_join(F.filter(F.transform(F.coalesce(modes, F.array().cast("array<string>")), lambda m: F.trim(m)), lambda m: m != ""), "|")


def modes_list(text: Column) -> Column:
    """The modes of a joined text without the two that are none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda m: ~m.isin("", "none", "excerpt_limited"))


def number(text: Column) -> Column:
    """Text as a number; null and blank text is 0. Other text that is no number is null."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))


def whole(value: Column) -> Column:
    """A number rounded half to even; null is 0."""
    return F.bround(F.coalesce(value, F.lit(0.0)), 0).cast("bigint")


def normalised_mode(mode: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(mode)), r"[\s-]+", "_")


def flatten(scores: DataFrame, index: DataFrame) -> DataFrame:
    """Valid reviews with the columns of the sample index (empty text where the id is not in it) and their sample group.

    A review without month takes the index's month; reviews without any month or with a score outside 1 to 5 are left out
    (``strict_flatten`` raises for them).
    """
    joined = judged_rows(scores).filter(f"n_valid = {len(SCORES) + 1}").join(index_rows(index).withColumnRenamed("month", "_index_month"), "transcript_id", "left")
    month = F.coalesce(F.when(F.trim("month") != "", F.trim("month")), F.trim("_index_month"))
    out = joined.withColumn("month", month).filter(F.col("month") != "").withColumns({c: F.coalesce(c, F.lit("")) for c in INDEX_COLUMNS})
    group = F.when(F.col("selection_reason") == "quality_sentinel", "sentinel").otherwise("representative_or_contrastive")
    return out.select("transcript_id", "month", "selection_reason", group.alias("sample_group"), *INDEX_COLUMNS[1:], "judge_confidence", modes_text(F.col("primary_failure_modes")).alias("primary_failure_modes"), "evidence", *SCORES)


def strict_flatten(scores: DataFrame, index: DataFrame) -> DataFrame:
    """``flatten`` after the checks: raises ValueError for bad scores, several reviews of one id, missing and extra ids."""
    found = {
        "review(s) with a score outside 1 to 5": judged_rows(scores).filter(f"n_valid < {len(SCORES) + 1}"),
        "transcript(s) with several reviews": duplicate_reviews(scores),
        "sampled transcript(s) without a review": missing_reviews(scores, index),
        "reviewed transcript(s) not in the sample": extra_reviews(scores, index),
    }
    for what, rows in found.items():
        if n := rows.count():
            raise ValueError(f"{n} {what}")
    return flatten(scores, index)


def monthly_summaries(rows: DataFrame) -> DataFrame:
    """Per month and group (all, and all but the sentinels): counts, means and confidence-weighted means, rounded to 3 places."""
    groups = F.when(F.col("sample_group") == "sentinel", F.array(F.lit("all_selected"))).otherwise(F.array(F.lit("all_selected"), F.lit(REPRESENTATIVE)))
    means = []
    for c in SCORES:
        weighted = F.sum(F.col(c) * F.col("judge_confidence")) / F.nullif(F.sum("judge_confidence"), F.lit(0))
        means += [F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias(f"mean_{c}"), F.bround(F.coalesce(weighted, F.lit(0.0)), 3).alias(f"confidence_weighted_mean_{c}")]
    return rows.withColumn("_group", F.explode(groups)).groupBy("month", F.col("_group").alias("group")).agg(
        F.count("*").alias("n_evaluated"), F.count_if(F.col("sample_group") == "sentinel").alias("n_sentinel"), F.count_if(F.lower("excerpt_limited") == "true").alias("n_excerpt_limited"), *means
    ).withColumnRenamed("group", "sample_group")


def failure_modes(rows: DataFrame) -> DataFrame:
    """(month, sample_group, failure_mode, count); reviews without a mode count as ``(none)``."""
    listed = modes_list(F.col("primary_failure_modes"))
    named = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("(none)")))
    return rows.select("month", "sample_group", F.explode(named).alias("failure_mode")).groupBy("month", "sample_group", "failure_mode").agg(F.count("*").alias("count"))


def failure_cards(rows: DataFrame) -> DataFrame:
    """(month, failure_mode, count, pct_of_max, pct_of_mentions, place): modes of a month by falling count."""
    counts = failure_modes(rows).groupBy("month", F.when(F.col("failure_mode") == "(none)", "none").otherwise(F.col("failure_mode")).alias("failure_mode")).agg(F.sum("count").alias("count"))
    month = Window.partitionBy("month")
    return counts.withColumns(
        {
            "pct_of_max": 100 * F.col("count") / F.max("count").over(month),
            "pct_of_mentions": 100 * F.col("count") / F.sum("count").over(month),
            "place": F.row_number().over(month.orderBy(F.desc("count"), F.asc("failure_mode"))),
        }
    )


def top_failure_modes(rows: DataFrame, k: int = 8) -> DataFrame:
    return rows.select(F.explode(modes_list(F.col("primary_failure_modes"))).alias("failure_mode")).groupBy("failure_mode").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure_mode").limit(k)


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("selection_reason").agg(F.count("*").alias("n"))


def _from_worst():
    return Window.partitionBy("month").orderBy(F.col(SCORES[0]) + F.col(SCORES[1]) + F.col(SCORES[3]), F.col(SCORES[2]), F.desc("judge_confidence"), F.asc("transcript_id"), F.asc("evidence"), F.asc("primary_failure_modes"))


def worst_of_month(rows: DataFrame) -> DataFrame:
    """The review with the lowest scores of each month."""
    return rows.withColumn("_r", F.row_number().over(_from_worst())).filter("_r = 1").drop("_r")


def low_examples(rows: DataFrame, k: int = 4) -> DataFrame:
    """Of each month at most ``k`` reviews with a score of 2 or less, worst first, with their ``place``."""
    return rows.filter(F.least(*SCORES) <= 2).withColumn("place", F.row_number().over(_from_worst())).filter(F.col("place") <= k)


def score_deltas(summaries: DataFrame, score: str = SCORES[0]) -> DataFrame:
    """(sample_group, delta): last minus first month of the weighted mean, 0.0 with fewer than two months."""
    c = f"confidence_weighted_mean_{score}"
    out = summaries.groupBy("sample_group").agg(F.count("*").alias("n"), F.max_by(c, "month").alias("b"), F.min_by(c, "month").alias("a"))
    return out.select("sample_group", F.when(F.col("n") < 2, 0.0).otherwise(F.bround(F.col("b") - F.col("a"), 3)).alias("delta"))


def best_and_weakest(summaries: DataFrame, score: str = SCORES[0], group: str = REPRESENTATIVE) -> DataFrame:
    """(best_month, weakest_month) of a group; the earlier month on ties."""
    c = f"confidence_weighted_mean_{score}"
    rows = summaries.filter(F.col("sample_group") == group)
    pick = lambda sign: F.max_by("month", F.struct(sign * F.col(c), -F.unix_timestamp(F.concat("month", F.lit("-01")), "yyyy-MM-dd")))
    return rows.agg(pick(1).alias("best_month"), pick(-1).alias("weakest_month"))


def last_two_against_previous(summaries: DataFrame, score: str = SCORES[2], group: str = REPRESENTATIVE) -> DataFrame:
    """(last_avg, prev_avg, delta) of the last two months and the two before; no row with fewer than four months."""
    c = f"confidence_weighted_mean_{score}"
    rows = summaries.filter(F.col("sample_group") == group).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("month"))))  # a row per month
    means = rows.filter("_r <= 4").agg(F.avg(F.when(F.col("_r") <= 2, F.col(c))).alias("last_avg"), F.avg(F.when(F.col("_r") > 2, F.col(c))).alias("prev_avg"), F.count("*").alias("n"))
    return means.filter("n = 4").select("last_avg", "prev_avg", (F.col("last_avg") - F.col("prev_avg")).alias("delta"))


JUDGE_JSON = (
    "rubric_version string, per_transcript array<struct<transcript_id: string, month: string, transcription_quality_score: int, diarization_quality_score: int, "
    "timestamp_structure_score: int, artifact_severity_score: int, judge_confidence: int, primary_failure_modes: array<string>, evidence: string>>"
)


def load_judge_json(text: str) -> dict:
    """A judge's JSON; raw quotes inside strings are repaired first if it does not parse. ValueError if it is none."""
    for attempt in (text, quoted_evidence(text), quoted_strings(quoted_evidence(text))):
        try:
            data = json.loads(attempt)
            break
        except json.JSONDecodeError as error:
            data, last = None, error
    if data is None:
        raise ValueError(f"not JSON, even after repair: {last}")
    if not isinstance(data, dict) or not isinstance(data.get("per_transcript"), list):
        raise ValueError("a JSON object with a list per_transcript is needed")
    return data


def _escape_until(text: str, at: int, closing: str) -> tuple[str, int]:
    """Reads a string value from ``at``: a quote ends it only before the end or one of ``closing``; other quotes are escaped."""
    out = []
    while at < len(text):
        c = text[at]
        if c == "\\":
            out.append(text[at : at + 2])
            at += 2
            continue
        if c == '"':
            following = text[at + 1 :].lstrip()[:1]
            if not following or following in closing:
                return "".join(out) + c, at + 1
            out.append('\\"')
        else:
            out.append(c)
        at += 1
    return "".join(out), at


def quoted_evidence(text: str) -> str:
    """Escapes quotes inside values of ``evidence``, the last field of a review."""
    out, at = [], 0
    while (found := text.find('"evidence"', at)) >= 0:
        colon = text[found + 10 :].lstrip()
        opening = text.find('"', found + 10)
        if not colon.startswith(":") or opening < 0 or text[found + 10 : opening].strip() != ":":
            out.append(text[at : found + 10])
            at = found + 10
            continue
        out.append(text[at : opening + 1])
        value, at = _escape_until(text, opening + 1, "}")
        out.append(value)
    return "".join(out) + text[at:]


def quoted_strings(text: str) -> str:
    """Escapes quotes inside any string: a quote ends a string only before a colon, a comma or a closing bracket."""
    out, at = [], 0
    while (opening := text.find('"', at)) >= 0:
        out.append(text[at : opening + 1])
        value, at = _escape_until(text, opening + 1, ":,}]")
        out.append(value)
    return "".join(out) + text[at:]
