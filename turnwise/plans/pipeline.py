"""The batch run: transcripts to feature parts, rollups, shares, manifest, dictionary and report."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import __version__
from turnwise.functions.dates import parse_created_at
from turnwise.operators import aggregates, reshape, sampling
from turnwise.operators.language import SMALL_WORDS, language_codes
from turnwise.operators.layers import LAYER_A_VERSION, LAYER_B_VERSION, add_features, metric_columns
from turnwise.plans import report, review
from turnwise.plans.dictionary import descriptions, dictionary
from turnwise.plans.progress import Tasks, configure, log, wanted
from turnwise.session import get_spark, spread
from turnwise.sources import files

USER = "telegram_user_internal_id"
BUCKETS = {"day": "bucket_day", "week": "bucket_iso_week", "month": "bucket_month"}


def versions(with_b: bool) -> str:
    return f"{LAYER_A_VERSION}+{LAYER_B_VERSION}" if with_b else LAYER_A_VERSION


def build_parts(df: DataFrame, to: str, with_b: bool = True, languages: list[str] | None = None, max_chars: int = 0) -> None:
    """Features of every row, rows without a readable time included, as Parquet."""
    files.require_columns(df)
    words = {c: SMALL_WORDS[c].split() for c in languages} if languages else None
    rows = add_features(spread(df), with_b=with_b, languages=words, max_chars=max_chars).withColumn("created_at_parsed", parse_created_at(F.col("created_at")))
    files.write_parts(rows, to)


def rollups(parts: DataFrame, with_b: bool = True, with_users: bool = True) -> dict[str, DataFrame]:
    """All aggregates of a run by name, from feature parts. Without a user column there is no user rollup."""
    rows = aggregates.add_buckets(parts.filter(F.col("created_at_parsed").isNotNull()))
    metrics = metric_columns(with_b)
    out = {f"aggregate_by_{name}": aggregates.aggregate_buckets(rows, column, metrics) for name, column in BUCKETS.items()}
    if with_b:
        for name, column in BUCKETS.items():
            out[f"language_share_by_{name}"] = aggregates.category_share(rows, column, "layer_b_primary_language")
            out[f"content_category_share_by_{name}"] = aggregates.category_share(rows, column, "content_primary_category")
        out["file_extension_share_by_month"] = aggregates.category_share(rows, "bucket_month", "content_file_extension")
    if with_users and USER in parts.columns:
        out["aggregate_by_user_month"] = aggregates.aggregate_user_month(rows, metrics, USER)
    return out


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _lock_hash(root: Path) -> str | None:
    for name in ("uv.lock", "requirements-lock.txt"):
        if (root / name).is_file():
            return hashlib.sha256((root / name).read_bytes()).hexdigest()
    return None


def manifest(run_id: str, source: dict, facts: dict, with_b: bool, root: Path = Path(".")) -> dict:
    head = root / ".git" / "HEAD"
    commit = None
    if head.is_file():
        ref = head.read_text().strip().removeprefix("ref: ")
        commit = (root / ".git" / ref).read_text().strip() if (root / ".git" / ref).is_file() else ref
    return {
        "run_id": run_id, "created_utc": _now(), "package_version": __version__, "metrics_definition_version": versions(with_b), "rows_read": facts["rows_read"],
        "rows_dropped_null_ts": facts["rows_dropped_null_ts"], "created_at_min": facts["created_at_min"], "created_at_max": facts["created_at_max"],
        "dependency_lock_hash": _lock_hash(root), "git_commit": commit, "docker_image_digest": os.environ.get("DOCKER_IMAGE_DIGEST"),
        "notes": "created_at is taken as naive wall time", "input": source,
    }


def visual_bundle(folder: str, manifest: dict, texts: dict[str, str] | None = None, buckets: tuple[str, ...] = tuple(BUCKETS)) -> list[str]:
    """Charts of a run from its rollups: an SVG per metric and bucket, language shares, daily length, and ``report.html``.

    What is missing (a rollup that was not written, an unknown bucket) is skipped and named in the warnings that come back.
    """
    spark = SparkSession.active()
    warnings: list[str] = []

    def rollup(name: str) -> DataFrame | None:
        path = files.join(folder, f"{name}.parquet")
        if files.exists(path):
            return spark.read.parquet(path)
        warnings.append(f"{name}.parquet is missing")
        return None

    daily: dict[str, str] = {}
    language = ""
    for name in buckets:
        if name not in BUCKETS:
            warnings.append(f"unknown bucket {name}")
            continue
        column = BUCKETS[name]
        wide, shares = rollup(f"aggregate_by_{name}"), rollup(f"language_share_by_{name}")
        figures = report.trend_figures(wide, column, texts) if wide is not None else {}
        if shares is not None:
            drawn = report.share_figure(reshape.top_categories_and_other(shares, column), column, f"Доли языков ({name})")
            figures["primary_language_share"] = drawn
            language = drawn if name == "day" or not language else language
        for metric, figure in figures.items():
            svg = figure[figure.index("<svg") : figure.index("</svg>") + 6] if "<svg" in figure else ""
            if svg:
                files.write_text(files.join(folder, "figures", f"{report.slug(metric)}_{name}.svg"), svg)
        if name == "day":
            daily = {m: f for m, f in figures.items() if m != "primary_language_share"}
    parts = files.join(folder, "parts")
    totals = aggregates.daily_total(spark.read.parquet(parts)) if files.exists(parts) else spark.createDataFrame([], "bucket_day timestamp_ntz, total_seconds double, n_rows bigint")
    files.write_text(files.join(folder, "report.html"), report.run_report(manifest, daily, language, totals, warnings))
    return warnings


def run(spark: SparkSession, source: str, out: str, *, run_id: str | None = None, with_b: bool = True, max_rows: int | None = None, merge: bool = False, merge_max_rows: int = 200_000, with_report: bool = True, with_users: bool = True, languages: list[str] | None = None, max_chars: int = 0, progress: bool = False) -> dict:
    """Runs the batch over a CSV or Parquet source; returns the manifest. A run without rows writes manifest and dictionary only.

    ``languages`` are the codes told apart (all for none), ``max_chars`` a positive bound of the text they are told from.
    """
    run_id = run_id or str(uuid.uuid4())
    folder = files.run_folder(out, run_id)
    with Tasks(spark, "features", progress):
        build_parts(files.read_source(spark, source, max_rows), files.join(folder, "parts"), with_b, languages, max_chars)
    parts = spark.read.parquet(files.join(folder, "parts"))
    facts = aggregates.created_range(parts).first().asDict()
    made = manifest(run_id, files.fingerprint(source), facts, with_b)
    if facts["rows_read"]:
        with Tasks(spark, "rollups", progress):
            for name, table in rollups(parts, with_b, with_users).items():
                files.write_both(table, files.join(folder, name))
        if merge:
            files.write_merged(parts, files.join(folder, "per_row_features.parquet"), facts["rows_read"], merge_max_rows)
        if with_report:
            with Tasks(spark, "report", progress):
                for warning in visual_bundle(folder, made, descriptions(dictionary(with_b))):
                    log(warning=warning)
                review.research(parts, folder) if with_b else None
    files.write_json(files.join(folder, "manifest.json"), made)
    files.write_json(files.join(folder, "metrics_dictionary.json"), dictionary(with_b))
    return made


# environment variable, option, and the value that switches it on (None: the value is passed on)
ENVIRONMENT = (
    ("INPUT_CSV", "--input", None), ("OUTPUT_DIR", "--output", None), ("MAX_ROWS", "--max-rows", None), ("RUN_ID", "--run-id", None), ("LANG_DETECT_MAX_CHARS", "--lang-detect-max-chars", None),
    ("LANG_DETECT_LANGUAGES", "--lang-detect-languages", None), ("LAYER_B", "--no-layer-b", "0"), ("USER_STRATIFY", "--no-user-stratify", "0"), ("EXPORT_REPORT", "--no-report", "0"), ("PROGRESS", "--no-progress", "0"), ("PROGRESS", "--progress", "1"),
)


def from_environment(env: dict[str, str]) -> list[str]:
    """Arguments of a ``run`` from environment variables; empty ones count as not set. Batch sizes and row totals have no use here."""
    out = ["run"]
    for name, option, switch in ENVIRONMENT:
        value = env.get(name, "")
        if switch is None and value:
            out += [option, value]
        elif switch is not None and value == switch:
            out.append(option)
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="turnwise", description="Features and rollups of diarized speech transcripts")
    commands = parser.add_subparsers(dest="command", required=True)
    batch = commands.add_parser("run", help="features, rollups, manifest and report")
    batch.add_argument("--input")
    batch.add_argument("--output", default="outputs")
    batch.add_argument("--run-id")
    batch.add_argument("--max-rows", type=int)
    batch.add_argument("--no-layer-b", action="store_true")
    batch.add_argument("--no-report", action="store_true")
    batch.add_argument("--no-user-stratify", action="store_true", help="no rollup by user and month")
    batch.add_argument("--lang-detect-max-chars", type=int, default=0, help="tell languages from so many characters of a text; 0 for whole texts")
    batch.add_argument("--lang-detect-languages", default="", help="codes of the languages told apart, with commas")
    batch.add_argument("--progress", action="store_true", help="progress on standard error (by default if that is a terminal)")
    batch.add_argument("--no-progress", action="store_true")
    batch.add_argument("--merge", action="store_true")
    batch.add_argument("--merge-max-rows", type=int, default=200_000)
    staging = commands.add_parser("stage", help="CSV to Parquet without features")
    staging.add_argument("--input")
    staging.add_argument("--output", required=True)
    sample = commands.add_parser("sample", help="draw a stratified sample for review")
    sample.add_argument("--input")
    sample.add_argument("--output", required=True)
    sample.add_argument("--samples-per-month", type=int, default=8)
    sample.add_argument("--seed", type=int, default=42)
    sample.add_argument("--max-transcript-chars", type=int, default=4500)
    sample.add_argument("--exclude-index", action="append", default=[])
    sample.add_argument("--languages", default="")
    sample.add_argument("--russian-only", action="store_true")
    sample.add_argument("--exact-language", action="store_true")
    sample.add_argument("--min-language-confidence", type=float, default=0.5)
    analysis = commands.add_parser("analyze", help="join review scores to their sample")
    analysis.add_argument("--judge-json", required=True)
    analysis.add_argument("--index", required=True)
    analysis.add_argument("--output", required=True)
    lengths = commands.add_parser("durations", help="duration distributions of a run")
    lengths.add_argument("--run", required=True, help="folder of a run, with parts")
    lengths.add_argument("--output", required=True)
    lengths.add_argument("--start", help="first time, YYYY-MM-DD HH:MM:SS")
    lengths.add_argument("--end", help="last time, YYYY-MM-DD HH:MM:SS")
    lengths.add_argument("--manifest", help="manifest of the run; its input is checked to be there")
    raw = commands.add_parser("raw", help="summary of raw transcripts as JSON")
    raw.add_argument("--input")
    raw.add_argument("--output", required=True)
    given = parser.parse_args(args)
    if getattr(given, "max_rows", None) is not None and given.max_rows < 0:
        parser.error("--max-rows must not be negative")
    if getattr(given, "progress", False) and given.no_progress:
        parser.error("--progress and --no-progress exclude each other")
    if given.command == "run" and given.run_id and not sampling.valid_run_id(given.run_id):
        parser.error("not a run id")
    if given.command == "durations" and (given.start is None) != (given.end is None):
        parser.error("--start and --end belong together")
    configure()
    if given.command == "sample" and not (given.samples_per_month >= 1 and given.max_transcript_chars >= 1200 and 0 <= given.min_language_confidence <= 1):
        parser.error("samples per month from 1, characters from 1200, confidence from 0 to 1")
    spark = get_spark()
    if given.command == "analyze":
        return 0 if review.analyze(spark, given.judge_json, given.index, given.output) is not None else 1
    if given.command == "durations":
        if given.manifest:
            log(input=files.resolve_from_manifest(json.loads(files.read_text(given.manifest)), given.run))
        times = [F.lit(t).try_cast("timestamp_ntz") if t else None for t in (given.start, given.end)]
        return 0 if review.durations(spark.read.parquet(files.join(given.run, "parts")), given.output, *times) is not None else 1
    source = files.resolve_csv(given.input)
    if given.command == "stage":
        print(f"rows={files.stage(files.read_source(spark, source), given.output)}")
        return 0
    if given.command in ("sample", "raw"):
        rows = files.require_columns(files.read_source(spark, source))
        if given.command == "raw":
            review.summarize_raw(rows, given.output)
        else:
            review.build_sample(
                spark, rows, given.output, per_month=given.samples_per_month, seed=given.seed, max_chars=given.max_transcript_chars, excluded=given.exclude_index, languages=given.languages,
                russian_only=given.russian_only, exact=given.exact_language, min_confidence=given.min_language_confidence,
            )
        return 0
    made = run(
        spark, source, given.output, run_id=given.run_id, with_b=not given.no_layer_b, max_rows=given.max_rows, merge=given.merge, merge_max_rows=given.merge_max_rows, with_report=not given.no_report, with_users=not given.no_user_stratify,
        languages=language_codes(given.lang_detect_languages) if given.lang_detect_languages else None, max_chars=given.lang_detect_max_chars, progress=wanted(given.progress, given.no_progress),
    )
    log(run_id=made["run_id"], rows_read=made["rows_read"], rows_dropped=made["rows_dropped_null_ts"], at=_now())
    print(f"run_id={made['run_id']} rows={made['rows_read']}")
    return 0
