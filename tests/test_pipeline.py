import json

import pytest

from turnwise.operators import sampling
from turnwise.plans import pipeline, report
from turnwise.sources import files

CSV = 'id,telegram_user_internal_id,created_at,file_name,transcription_text\nu1,i1,2024-01-15 10:00:00,a.wav,"SPEAKER_00\n[00:00:00 - 00:00:02]\nhello ""you"""\nu2,i2,2024-02-20 12:30:00,b.wav,"SPEAKER_00\n[bad]\nbody"\nu3,i2,bad,,\n'


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿" + CSV, encoding="utf-8")
    return str(path)


def test_csv_source(spark, source, tmp_path):
    df = files.read_csv(spark, source)
    assert df.columns[0] == "id" and df.count() == 3 == files.logical_rows(spark, source)
    assert df.filter("id = 'u1'").first()["transcription_text"].endswith('hello "you"')
    assert [files.read_csv(spark, source, n).count() for n in (0, 2, 9)] == [0, 2, 3]
    assert [r["source_row_number"] for r in files.with_row_number(df).orderBy("id").collect()] == [1, 2, 3]
    assert files.missing_columns(df.select("id")) == ["created_at", "transcription_text"]
    with pytest.raises(ValueError):
        files.require_columns(df.select("id"))
    assert files.stage_csv(spark, source, str(tmp_path / "staged")) == 3
    assert files.fingerprint(source)["size_bytes"] > 0 and files.fingerprint("/none")["sha256_first_8mib"] is None
    assert files.resolve_csv(None, str(tmp_path)) == source
    with pytest.raises(FileNotFoundError):
        files.resolve_csv(None, str(tmp_path / "staged"))


def test_run_writes_everything(spark, source, tmp_path):
    made = pipeline.run(spark, source, str(tmp_path / "out"), run_id="r1", merge=True)
    folder = tmp_path / "out" / "r1"
    assert (made["rows_read"], made["rows_dropped_null_ts"], made["created_at_min"]) == (3, 1, "2024-01-15 10:00:00")
    names = {p.name for p in folder.iterdir()}
    assert {"manifest.json", "metrics_dictionary.json", "report.html", "parts", "per_row_features.parquet"} <= names
    for name in ("aggregate_by_day", "aggregate_by_week", "aggregate_by_month", "language_share_by_month", "content_category_share_by_week", "file_extension_share_by_month", "aggregate_by_user_month"):
        assert {f"{name}.parquet", f"{name}.csv"} <= names
    assert json.loads((folder / "manifest.json").read_text())["metrics_definition_version"] == "layer_a_v3+layer_b_v3"
    parts = spark.read.parquet(str(folder / "parts"))
    assert parts.filter("id = 'u2'").first()["layer_a_malformed_timestamp_ratio"] == 1.0
    assert spark.read.parquet(str(folder / "aggregate_by_month.parquet")).count() == 2


def test_run_without_users_and_without_rows(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("created_at,transcription_text\n2024-01-15 10:00:00,hello\n")
    pipeline.run(spark, str(path), str(tmp_path / "o"), run_id="m", with_b=False, with_report=False)
    assert not (tmp_path / "o" / "m" / "aggregate_by_user_month.parquet").exists()
    made = pipeline.run(spark, str(path), str(tmp_path / "o"), run_id="none", max_rows=0)
    assert made["rows_read"] == 0 and not (tmp_path / "o" / "none" / "aggregate_by_day.parquet").exists()
    with pytest.raises(ValueError):
        files.run_folder("x", "../y")


def test_bundle_warns_about_what_is_missing(spark, source, tmp_path):
    pipeline.run(spark, source, str(tmp_path), run_id="b")
    folder = str(tmp_path / "b")
    names = {p.name for p in (tmp_path / "b" / "figures").iterdir()}
    assert {"layer_a_segment_count_month.svg", "primary_language_share_week.svg"} <= names
    page = (tmp_path / "b" / "report.html").read_text()
    assert "Отчёт" in page and "Число сегментов диаризации" in page and '<rect class="n"' in page and "Доли языков" in page
    assert (tmp_path / "b" / "research.html").is_file()
    import shutil

    shutil.rmtree(tmp_path / "b" / "aggregate_by_week.parquet")
    assert pipeline.visual_bundle(folder, {"run_id": "b"}, buckets=("week", "year")) == ["aggregate_by_week.parquet is missing", "unknown bucket year"]


def test_dictionary_and_names():
    from turnwise.operators.layers import metric_columns
    from turnwise.plans.dictionary import descriptions, dictionary

    value = dictionary()
    assert len(value["metrics"]) == 42 and set(metric_columns(True)) <= {m["name"] for m in value["metrics"]}
    assert "диаризации" in descriptions(value)["layer_a_segment_count"] and all(m["description"] and m["description_ru"] for m in value["metrics"])
    assert {m["layer"] for m in dictionary(False)["metrics"]} == {"A"}
    assert report.slug("a b/c") == "a_b_c" and report.title("layer_a_segment_count") == "segment count"
    assert report.metric_names(["x_median", "x_q1", "x_q3", "y_median"]) == ["x"]


def test_progress_and_environment(spark, caplog):
    from turnwise.plans import progress

    assert [progress.target_rows(*x) for x in ((100, 50), (100, None), (None, 10), (None, None))] == [50, 100, 10, None]
    assert progress.line("features", 50, 100, 10.0) == "[features] rows=50 rows_a_second=5 elapsed=10s left=50 eta=10s"
    assert progress.pairs(a=1, b=None, c="x\ny") == "a=1 c=x y" and progress.wanted(True, True) is False
    with progress.Tasks(spark, "x", True, 0.01):
        spark.range(10).count()
    assert pipeline.from_environment({"INPUT_CSV": "a.csv", "LAYER_B": "0", "PROGRESS": "1", "MAX_ROWS": "", "RUN_ID": "r"}) == ["run", "--input", "a.csv", "--run-id", "r", "--no-layer-b", "--progress"]
    with pytest.raises(SystemExit):
        pipeline.main(["run", "--run-id", "../x"])


def test_durations_print():
    assert [report.format_duration(x) for x in (45, 90, 3700, -1, None, float("nan"))] == ["45s", "1m30s", "1h01m40s", "?", "?", "?"]
    assert report.line_chart([("a", None, None, None)], "x") == "" and "<svg" in report.line_chart([("a", 1.0, 0.5, 2.0), ("b", 2.0, None, None)], "x")


def test_sample_is_deterministic_and_meets_quotas(spark, small):
    rows = sampling.candidates(spark.read.parquet(f"{small}/sample_multiline.parquet"))
    a = {(r["transcript_id"], r["selection_reason"]) for r in sampling.stratified_sample(rows, 8, 7).collect()}
    b = {(r["transcript_id"], r["selection_reason"]) for r in sampling.stratified_sample(rows.repartition(7), 8, 7).collect()}
    assert a == b and len({i for i, _ in a}) == len(a)
    months = sampling.stratified_sample(rows, 8, 7).groupBy("month", "selection_reason").count().collect()
    sizes = {r["month"]: r["count"] for r in rows.groupBy("month").count().collect()}
    by = {}
    for r in months:
        by.setdefault(r["month"], {})[r["selection_reason"]] = r["count"]
    for m, n in sizes.items():
        assert sum(by[m].values()) == min(n, 8)
        if n > 8:
            rep = by[m].get("representative_dominant_stratum", 0) + by[m].get("representative_month_center", 0)
            assert rep == 5 and by[m].get("quality_sentinel") == 1 and by[m].get("contrastive_rare_stratum", 0) <= 2
        else:
            assert set(by[m]) == {"all_available_for_sparse_month"}


def test_exclusions_and_filters(spark):
    df = spark.createDataFrame([("ru_old",), ("en_row",), ("ru_new",)], "transcript_id string")
    gone = spark.createDataFrame([(" ru_old ",), (None,), ("",)], "transcript_id string")
    assert {r[0] for r in sampling.exclude(df, gone).collect()} == {"en_row", "ru_new"}
    assert sampling.language_filters("Russian, en,ru", True) == ["ru", "en"]
    assert sampling.valid_run_id("a.b-1") and not sampling.valid_run_id("../a")


def test_command_line(spark, source, tmp_path, small, capsys):
    assert pipeline.main(["stage", "--input", source, "--output", str(tmp_path / "st")]) == 0
    assert pipeline.main(["run", "--input", source, "--output", str(tmp_path / "o"), "--run-id", "c", "--no-layer-b", "--no-report"]) == 0
    assert "rows=3" in capsys.readouterr().out
    assert pipeline.main(["durations", "--run", str(tmp_path / "o" / "c"), "--output", str(tmp_path / "d")]) == 0
    assert pipeline.main(["raw", "--input", source, "--output", str(tmp_path / "raw.json")]) == 0
    assert pipeline.main(["sample", "--input", source, "--output", str(tmp_path / "s")]) == 0
    with pytest.raises(SystemExit):
        pipeline.main(["sample", "--input", source, "--output", "x", "--samples-per-month", "0"])


def test_registered_month_rollup_covers_both_layers(spark, small):
    from turnwise.operators import layers
    from turnwise.queries import QUERIES

    columns = QUERIES["features_month"](spark, small).columns
    assert all(f"{m}_median" in columns for m in layers.metric_columns(True))
    assert "_category" in QUERIES["content_category_share_month"](spark, small).columns
