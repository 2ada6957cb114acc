import json

import pytest

from turnwise.operators import judge
from turnwise.sources import files

GOOD = {"rubric_version": "v1", "per_transcript": [{"transcript_id": "a", "evidence": "plain"}, {"transcript_id": "b", "evidence": 'he said "yes", then'}]}


@pytest.mark.parametrize("indent", [None, 2])
def test_raw_quotes_are_repaired(indent):
    text = json.dumps(GOOD, indent=indent).replace('\\"', '"')
    assert judge.load_judge_json(text)["per_transcript"][1]["evidence"] == 'he said "yes", then'
    assert judge.load_judge_json(json.dumps(GOOD, indent=indent)) == GOOD


def test_quotes_in_other_strings():
    text = '{"per_transcript": [], "note": "a "quoted" word", "x": 1}'
    assert judge.load_judge_json(text)["note"] == 'a "quoted" word'


@pytest.mark.parametrize("text", ["[]", "{}", '{"per_transcript": 1}', "nothing"])
def test_bad_json(text):
    with pytest.raises(ValueError):
        judge.load_judge_json(text)


SCORE = "rubric_version string, transcript_id string, month string, transcription_quality_score int, diarization_quality_score int, timestamp_structure_score int, artifact_severity_score int, judge_confidence int, primary_failure_modes array<string>, evidence string"
INDEX = "transcript_id string, month string, selection_reason string, content_category string, language string, length_bin string, dialogue_bin string, quality_bin string, excerpt_limited string"


def tables(spark, scores, index):
    return spark.createDataFrame(scores, SCORE), spark.createDataFrame(index, INDEX)


def row(i, month, a=4, conf=3, modes=("x",), b=4):
    return ("v1", i, month, a, b, 4, 4, conf, list(modes) if modes is not None else None, "e")


def idx(i, month, reason="representative_month_center", limited="False"):
    return (i, month, reason, "c", "ru", "short", "d", "typical", limited)


def test_monthly_scores_and_modes(spark):
    s, i = tables(spark, [row(" a ", "2024-01", 5, 1), row("b", None, 2, 4, ("none",)), row("c", "2024-01", 1, 5, None), row("c", "2024-01", 1, 5, None)], [idx("a", "2024-01", limited="True"), idx("b", "2024-01"), idx("c", "2024-01", "quality_sentinel")])
    flat = judge.strict_flatten(s, i)
    got = {r["sample_group"]: r for r in judge.monthly_summaries(flat).collect()}
    every, rep = got["all_selected"], got[judge.REPRESENTATIVE]
    assert (every["n_evaluated"], every["n_sentinel"], every["n_excerpt_limited"], rep["n_evaluated"]) == (3, 1, 1, 2)
    assert rep["mean_transcription_quality_score"] == 3.5 and rep["confidence_weighted_mean_transcription_quality_score"] == 2.6
    modes = {(r["sample_group"], r["failure_mode"]): r["count"] for r in judge.failure_modes(flat).collect()}
    assert modes == {("representative_or_contrastive", "x"): 1, ("representative_or_contrastive", "(none)"): 1, ("sentinel", "(none)"): 1}
    assert judge.worst_of_month(flat).first()["transcript_id"] == "c"


@pytest.mark.parametrize(
    "scores, index, what",
    [
        ([row("a", "2024-01", 9)], [idx("a", "2024-01")], "outside"),
        ([row("a", "2024-01", 4), row("a", "2024-01", 3)], [idx("a", "2024-01")], "several"),
        ([row("a", "2024-01")], [idx("a", "2024-01"), idx("b", "2024-01")], "without a review"),
        ([row("a", "2024-01"), row("z", "2024-01")], [idx("a", "2024-01")], "not in the sample"),
    ],
)
def test_strict_checks(spark, scores, index, what):
    with pytest.raises(ValueError, match=what):
        judge.strict_flatten(*tables(spark, scores, index))


def test_nulls_and_empty_tables(spark):
    s, i = tables(spark, [("v", None, None, None, None, None, None, None, None, None), row("a", "2024-01")], [(None,) * 9, idx("a", None)])
    assert judge.flatten(s, i).count() == 1
    assert judge.monthly_summaries(judge.flatten(s.limit(0), i.limit(0))).count() == 0


def test_packet_metadata():
    assert files.packet_metadata('## Packet Metadata\n\n```json\n{"a": 1}\n```\n') == {"a": 1}
    assert files.packet_metadata("nothing") == {} and files.packet_metadata("## Packet Metadata\n```json\n{\n```") == {}
