import pytest
from pyspark.sql import functions as F

from turnwise.operators import layers, segments

DASHES = "-" * 80


def parse(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(segments.parse_segments(F.col("t")).alias("s")).first()["s"]
    return [(r["speaker"], r["body"], r["has_timestamp"], r["malformed"], r["start_s"], r["end_s"]) for r in rows]


CASES = {
    "blocks": (
        f"{DASHES}\nSPEAKER_00\n[00:00:00 - 00:00:02]\nHello there\n\n{DASHES}\nSPEAKER_01\n[00:00:02 - 00:00:05]\nHi\n",
        [("SPEAKER_00", "Hello there", True, False, 0.0, 2.0), ("SPEAKER_01", "Hi", True, False, 2.0, 5.0)],
    ),
    "no time": ("SPEAKER_00\n[bad ts line]\nbody", [("SPEAKER_00", "[bad ts line]\nbody", False, True, None, None)]),
    "inline turns": (
        "[SPEAKER_01]\n00:00:01 - 00:00:03: one\n00:00:03 - 00:00:06: two\n\n[SPEAKER_00]\n00:00:07 - 00:00:09: three",
        [("SPEAKER_01", "one", True, False, 1.0, 3.0), ("SPEAKER_01", "two\n", True, False, 3.0, 6.0), ("SPEAKER_00", "three", True, False, 7.0, 9.0)],
    ),
    "prose first": ("before\nSPEAKER_00\nbroken\nstill talking", [(None, "before", False, False, None, None), ("SPEAKER_00", "broken\nstill talking", False, True, None, None)]),
    "bracket line is consumed": ("speaker_ab\n[0:00:01.9 – 0:00:02] lost\nkept", [("SPEAKER_AB", "kept", True, False, 1.0, 2.0)]),
    "later bracket is body": ("SPEAKER_0\n[00:00:01 - 00:00:02]\na\n[00:00:03 - 00:00:04]\nb", [("SPEAKER_0", "a\n[00:00:03 - 00:00:04]\nb", True, False, 1.0, 2.0)]),
    "blank lines wait": ("SPEAKER_0\n\n[00:00:01 - 00:00:02]\na", [("SPEAKER_0", "\na", True, False, 1.0, 2.0)]),
    "empty header stays": ("SPEAKER_0\nSPEAKER_1\n[00:00:01 - 00:00:02]\nx", [("SPEAKER_0", "", False, False, None, None), ("SPEAKER_1", "x", True, False, 1.0, 2.0)]),
    "inline without speaker": ("00:00:01 - 00:00:03: one", [(None, "00:00:01 - 00:00:03: one", False, False, None, None)]),
    "inline without words": ("SPEAKER_0\n00:00:01 - 00:00:03:\nnext", [("SPEAKER_0", "next", True, False, 1.0, 3.0)]),
    "not headers": ("[SPEAKER_01\nSPEAKER_ABCD\nx", [(None, "[SPEAKER_01\nSPEAKER_ABCD\nx", False, False, None, None)]),
    "carriage returns": ("SPEAKER_0\r\n[00:00:01 - 00:00:02]\r\na\r\nb", [("SPEAKER_0", "a\nb", True, False, 1.0, 2.0)]),
    "empty": ("", []),
    "blank": (" \n ", []),
    "null": (None, []),
}


@pytest.mark.parametrize("name", CASES)
def test_parser(spark, name):
    text, want = CASES[name]
    assert parse(spark, text) == want


def one(spark, text):
    df = spark.createDataFrame([(text, "folder/sub/Voice memo.WAV")], "transcription_text string, file_name string")
    return layers.add_features(df).first()


def test_layer_a_durations(spark):
    r = one(spark, "SPEAKER_0\n[00:00:00 - 00:00:03]\nx y\nSPEAKER_1\n[00:00:04 - 00:00:05]\nz")
    assert (r["layer_a_duration_covered_seconds"], r["layer_a_duration_span_seconds"], r["layer_a_duration_coverage_ratio"], r["layer_a_segments_with_duration_ratio"]) == (4.0, 5.0, 0.8, 1.0)
    r = one(spark, "SPEAKER_0\n[00:00:10 - 00:00:08]\nx\nSPEAKER_1\n[00:00:12 - 00:00:15]\nz")
    assert (r["layer_a_duration_covered_seconds"], r["layer_a_duration_span_seconds"], r["layer_a_segments_with_duration_ratio"]) == (3.0, 3.0, 0.5)


def test_layer_a_structure(spark):
    r = one(spark, "intro\nSPEAKER_0\n[00:00:00 - 00:00:03]\nSame  words\nSPEAKER_1\n[00:00:04 - 00:00:05]\nsame words\nSPEAKER_0\nno time here at all")
    assert r["layer_a_segment_count"] == 4 and r["layer_a_distinct_speakers"] == 2
    assert r["layer_a_speaker_switch_count"] == 2 and r["layer_a_speaker_switch_rate"] == 0.5
    assert r["layer_a_malformed_timestamp_ratio"] == 0.25
    assert abs(r["layer_a_duplicate_adjacent_segment_ratio"] - 1 / 3) < 1e-9
    assert (r["layer_a_median_words_per_segment"], r["layer_a_max_words_per_segment"], r["layer_a_unreasonable_speaker_churn"]) == (2.0, 5, 0)


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_defaults_of_blank_text(spark, text):
    r = one(spark, text)
    assert r["layer_a_segment_count"] == 0 and r["layer_a_median_words_per_segment"] is None and r["layer_a_max_words_per_segment"] is None
    assert r["layer_a_malformed_timestamp_ratio"] == r["layer_a_duration_coverage_ratio"] == 0.0
    assert r["layer_b_total_tokens"] == 0 and r["layer_b_type_token_ratio"] is None and r["layer_b_word_entropy_bits"] is None
    assert (r["layer_b_primary_language"], r["content_primary_category"], r["content_file_extension"]) == ("", "unknown", "wav")
    assert (r["content_file_path_depth"], r["content_file_basename_token_count"]) == (2, 3)


def test_layer_b_text(spark):
    r = one(spark, "a�b​ a b soooo Привет")
    assert r["layer_b_unicode_replacement_count"] == 1 and r["layer_b_zero_width_count"] == 1 and r["layer_b_repeated_char_run_ratio"] > 0
    r = one(spark, "a b a b")
    assert r["layer_b_word_entropy_bits"] == 1.0 and r["layer_b_hapax_ratio"] == 0.0 and r["layer_b_type_token_ratio"] == 0.5
    assert abs(r["content_script_latin_ratio"] - 1.0) < 1e-9


@pytest.mark.parametrize(
    "text, category",
    [
        ("api python sql docker github prompt", "tech_it"),
        ("SPEAKER_0\n[00:00:01 - 00:00:02]\nпривет как дела\nSPEAKER_1\n[00:00:02 - 00:00:03]\nвсе хорошо", "dialogue_meeting"),
        ("слово", "short_note"),
        ("слово " * 30, "quick_message"),
        ("слово " * 80, "general_monologue"),
        ("урок курс", "education"),
    ],
)
def test_categories(spark, text, category):
    assert one(spark, text)["content_primary_category"] == category


@pytest.mark.parametrize("text, iso", [("The quick brown fox jumps over the lazy dog and it was not the only one", "en"), ("Это очень простое предложение на русском языке, и мы его понимаем", "ru"), ("Ich habe das nicht gewusst und wir sind auch noch nicht da", "de"), ("Я ще не знаю, чи це їхня теорія", "uk")])
def test_languages(spark, text, iso):
    assert one(spark, text)["layer_b_primary_language"] == iso
