import json

import pytest

from turnwise.operators import judge
from turnwise.plans import pipeline, report, review
from turnwise.sources import files


@pytest.fixture(scope="module")
def transcripts(spark, small):
    return spark.read.parquet(f"{small}/sample_multiline.parquet")


def test_sample_then_analysis(spark, transcripts, tmp_path):
    chosen = review.build_sample(spark, transcripts, str(tmp_path / "s"), per_month=2, russian_only=True)
    rows = chosen.collect()
    assert rows and all(r["language"] in ("cyrillic_dominant", "mixed_cyrillic_latin") for r in rows)
    meta = files.packet_metadata((tmp_path / "s" / "llm_judge_prompt.md").read_text())
    assert meta["selected_transcripts"] == len(rows) and sum(meta["selected_by_month"].values()) == len(rows)
    index = str(tmp_path / "s" / "llm_judge_sample_index.csv")
    assert files.read_csv(spark, index).columns == list(review.INDEX)
    data = {"rubric_version": "v1", "per_transcript": [{"transcript_id": r["transcript_id"], "month": r["month"], **{c: 4 for c in judge.SCORES}, "judge_confidence": 3, "primary_failure_modes": "asr_errors", "evidence": 'said "so"'} for r in rows]}
    path = tmp_path / "judge.json"
    path.write_text(json.dumps(data).replace('\\"', '"'))
    months = review.analyze(spark, str(path), index, str(tmp_path / "a")).collect()
    assert all(r["mean_transcription_quality_score"] == 4.0 for r in months)
    page = (tmp_path / "a" / "report.html").read_text()
    assert "<svg" in page and "Last month" in page and "Weakest transcript" in (tmp_path / "a" / "report.md").read_text()
    prompt = (tmp_path / "s" / "llm_judge_prompt.md").read_text()
    assert "rubric_version" in prompt and "`judge_confidence`" in prompt and '"selection_reason"' in prompt
    assert {"joined_scores.csv", "monthly_scores.parquet", "failure_modes.csv", "report.md"} <= {p.name for p in (tmp_path / "a").iterdir()}
    again = review.build_sample(spark, transcripts, str(tmp_path / "s2"), per_month=2, excluded=[index])
    assert not {r["transcript_id"] for r in rows} & {r["transcript_id"] for r in again.collect()}
    data["per_transcript"].pop()
    path.write_text(json.dumps(data))
    with pytest.raises(ValueError, match="without a review"):
        review.analyze(spark, str(path), index, str(tmp_path / "a"))


def test_durations_and_raw_summary(spark, transcripts, tmp_path):
    pipeline.build_parts(transcripts.limit(60), str(tmp_path / "parts"), with_b=False)
    months = review.durations(spark.read.parquet(str(tmp_path / "parts")), str(tmp_path / "d"))
    assert months.count() > 0 and (tmp_path / "d" / "durations.html").is_file() and (tmp_path / "d" / "duration_overall.csv").is_dir()
    value = review.summarize_raw(transcripts, str(tmp_path / "raw.json"))
    assert value["overall"][0]["n"] == sum(m["n"] for m in value["months"]) and len(value["words_overall"]) == 25


def test_packet_holds_the_whole_sample(spark):
    from pyspark.sql import functions as F

    n = 6_000
    sample = spark.range(n).select(F.format_string("t%05d", "id").alias("transcript_id"), F.format_string("2024-%02d", F.col("id") % 12 + 1).alias("month"), F.lit("x").alias("selection_reason"), F.lit("words").alias("excerpt"))
    text = report.packet(sample, 1, 500, 100)
    meta = files.packet_metadata(text)
    assert meta["selected_transcripts"] == n == text.count("\n## t") and meta["selected_by_month"]["2024-12"] == 500
