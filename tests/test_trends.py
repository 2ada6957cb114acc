import pytest
from pyspark.sql import functions as F

from turnwise.operators import trends


def test_labels_and_names(spark):
    df = spark.createDataFrame([("2024-01",), ("2025-12-31",), ("2024-13",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(trends.month_label_ru(F.col("m"))).collect()] == ["Янв 2024", "Дек 2025", "2024-13", "x", None]
    modes = spark.createDataFrame([("Coarse Timestamps",), ("other",), (" a-b ",)], "failure_mode string")
    assert [r[0] for r in trends.renamed_modes(modes, {"coarse_timestamps": "X", "a_b": "Y"}).collect()] == ["X", "other", "Y"]


def test_descriptions_and_alignment(spark):
    long = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, median double")
    got = {r["metric"]: r["description"] for r in trends.describe(long, [{"name": "a", "description": "about a"}]).collect()}
    assert got == {"a": "about a", "b": None}
    months = spark.createDataFrame([("1",), ("2",), ("2",)], "month string")
    assert sorted((r["month"], r["n"]) for r in trends.align_months(months, spark.createDataFrame([("2", 5)], "month string, n int")).fillna(0).collect()) == [("1", 0), ("2", 5)]
    with pytest.raises(ValueError):
        trends.exact_language(months, ["ru"], 2.0)
