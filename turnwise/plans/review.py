"""The other batch programs: review samples, review analysis, duration distributions and the raw summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import aggregates, judge, raw_summary, reshape, sampling, trends
from turnwise.plans import report
from turnwise.sources import files

INDEX = ("transcript_id", "month", *judge.INDEX_COLUMNS)


def build_sample(spark: SparkSession, transcripts: DataFrame, out: str, *, per_month: int = 8, seed: int = 42, max_chars: int = 4500, excluded: list[str] | None = None, languages: str = "", russian_only: bool = False, exact: bool = False, min_confidence: float = 0.5) -> DataFrame:
    """Draws the stratified sample and writes the prompt packet, the index CSV and the excerpts as JSON lines.

    ``excluded`` are index CSV files of earlier samples; their ids are left out. ``exact`` filters by the detected language
    instead of the script.
    """
    filters = sampling.language_filters(languages, russian_only)
    rows = transcripts
    if filters and exact:
        rows = trends.exact_language(rows, filters, min_confidence).drop("language", "language_confidence")
    found = sampling.candidates(rows)
    if filters and not exact:
        found = found.filter(sampling.language_matches(F.col("language"), filters))
    if excluded:
        found = sampling.exclude(found, sampling.excluded_ids([files.read_csv(spark, path) for path in excluded]))
    chosen = sampling.with_excerpts(sampling.stratified_sample(found, per_month, seed), rows, max_chars)
    files.write_text(files.join(out, "llm_judge_prompt.md"), report.packet(chosen, seed, per_month, max_chars))
    index = chosen.select(*[F.col(c).cast("string").alias(c) for c in INDEX]).orderBy("month", "transcript_id")
    index.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(files.join(out, "llm_judge_sample_index.csv"))
    files.write_jsonl(chosen.withColumnRenamed("excerpt", "transcript_excerpt"), files.join(out, "llm_judge_transcripts.jsonl"))
    return chosen


def scores_frame(spark: SparkSession, data: dict) -> DataFrame:
    """The reviews of a loaded judge JSON as a table; a mode given as text becomes a list of one."""
    names = ("transcript_id", "month", *judge.SCORES, "judge_confidence", "primary_failure_modes", "evidence")
    rows = []
    for item in data["per_transcript"]:
        if not isinstance(item, dict) or not str(item.get("transcript_id") or "").strip():
            raise ValueError("every review needs a transcript_id")
        modes = item.get("primary_failure_modes") or []
        modes = [modes] if isinstance(modes, str) else [str(m) for m in modes]
        number = lambda c: None if item.get(c) in (None, "") else round(float(item[c]))  # noqa: B023, E731
        rows.append((str(item["transcript_id"]), str(item.get("month") or ""), *[number(c) for c in (*judge.SCORES, "judge_confidence")], modes, str(item.get("evidence") or "")))
    kinds = ", ".join(f"{n} {'array<string>' if n == 'primary_failure_modes' else 'int' if n in judge.SCORES or n == 'judge_confidence' else 'string'}" for n in names)
    return spark.createDataFrame(rows, kinds)


def analyze(spark: SparkSession, judge_json: str, index_csv: str, out: str) -> DataFrame:
    """Checks and joins a judge's JSON to its sample index; writes joined scores, monthly scores, failure modes and a Markdown report."""
    data = judge.load_judge_json(files.read_text(judge_json))
    rows = judge.strict_flatten(scores_frame(spark, data), files.read_csv(spark, index_csv))
    months, modes = judge.monthly_summaries(rows), judge.failure_modes(rows)
    for name, table in (("joined_scores", rows), ("monthly_scores", months), ("failure_modes", modes)):
        files.write_both(table, files.join(out, name))
    cards, worst = judge.failure_cards(rows), judge.worst_of_month(rows)
    files.write_text(files.join(out, "report.md"), report.judge_report(months, cards, judge.score_deltas(months), worst, judge.top_failure_modes(rows)))
    files.write_text(files.join(out, "report.html"), report.judge_page(months, cards, trends.last_month_panel(rows, months), worst, judge.low_examples(rows), judge.reason_counts(rows)))
    return months


def durations(parts: DataFrame, out: str, start=None, end=None, seconds: str = "layer_a_duration_covered_seconds") -> DataFrame:
    """Duration summaries per month, of the last 30 days and overall, with histogram and report, from feature parts."""
    rows = parts.filter(F.col("created_at_parsed").isNotNull())
    if start is not None and end is not None:
        rows = aggregates.between(rows, "created_at_parsed", start, end)
    rows = rows.withColumn("month", F.date_format("created_at_parsed", "yyyy-MM"))
    months = aggregates.summary(rows, seconds, ["month"])
    scopes = [("month", months), ("last_30_days", aggregates.summary(aggregates.trailing_days(rows, "created_at_parsed"), seconds)), ("overall", aggregates.summary(rows, seconds))]
    for name, table in scopes:
        files.write_both(trends.as_text(table), files.join(out, f"duration_{name}"))
    bins = aggregates.histogram(rows, seconds)
    files.write_both(bins, files.join(out, "duration_histogram"))
    files.write_text(files.join(out, "durations.html"), report.duration_report(months, bins, aggregates.tail_shares(rows, seconds, ["month"])))
    return months


def research(parts: DataFrame, out: str, seconds: str = "layer_a_duration_covered_seconds") -> None:
    """The closing report over feature parts: monthly shares of languages and categories, what moves, months that stand out, durations."""
    rows = aggregates.add_buckets(parts.filter(F.col("created_at_parsed").isNotNull())).withColumn("month", F.date_format("created_at_parsed", "yyyy-MM"))
    shares = {c: aggregates.category_share(rows, "bucket_month", c) for c in ("layer_b_primary_language", "content_primary_category")}
    folded = [reshape.top_categories_and_other(x, "bucket_month") for x in shares.values()]
    months = aggregates.summary(rows, seconds, ["month"])
    first = lambda df: (df.collect() or [None])[0]
    stand_out = first(months.agg(F.max_by("month", F.struct("median", "month")).alias("longest"), F.min_by("month", F.struct("median", "month")).alias("shortest"), F.min_by("month", F.struct("n", "month")).alias("thinnest")))
    mover = first(trends.biggest_mover(shares["layer_b_primary_language"], "bucket_month"))
    facts = {f"{k} month": stand_out[k] for k in ("longest", "shortest", "thinnest")} | {"language that moves most beside Russian": mover and mover["_category"]}
    moved = reshape.share_spans(shares["content_primary_category"], "bucket_month")
    files.write_text(files.join(out, "research.html"), report.research_report(*folded, facts, months, moved))


def summarize_raw(transcripts: DataFrame, to: str) -> dict:
    """The raw summary as one JSON: per month and overall figures, labels, frequent words and the trend. A row a month is collected."""
    rows = raw_summary.raw_rows(transcripts)
    months = raw_summary.monthly(rows)
    listed = lambda df: [r.asDict() for r in df.collect()]
    value = {
        "months": listed(months.orderBy("month")), "overall": listed(raw_summary.monthly(rows, overall=True)), "primary_labels": listed(raw_summary.label_distribution(rows, ["month"])),
        "labels": listed(raw_summary.label_hits(rows, ["month"])), "labels_overall": listed(raw_summary.label_hits(rows, k=12)), "words": listed(raw_summary.frequent_words(rows, ["month"])),
        "words_overall": listed(raw_summary.frequent_words(rows, k=25)), "trend": listed(raw_summary.month_trend(months)),
    }
    files.write_json(to, value)
    return value
