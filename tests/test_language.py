"""The light detector of the feature pass against labelled sentences."""

from pyspark.sql import functions as F

from turnwise.operators.language import detect, language_codes


def test_accuracy_on_reference_sentences(spark, small):
    rows = spark.read.parquet(f"{small}/lang_reference.parquet").select("lang", detect(F.col("text")).alias("l"))
    assert rows.agg(F.avg((F.col("l.iso") == F.col("lang")).cast("double"))).first()[0] > 0.93


def test_blank_foreign_and_mixed(spark):
    df = spark.createDataFrame([("n", None), ("b", " \n"), ("g", "Αύριο το πρωί"), ("m", "We agreed on the plan and then мы решили что это всё")], "id string, text string")
    got = {r["id"]: r["l"] for r in df.select("id", detect(F.col("text")).alias("l")).collect()}
    assert all((got[k]["iso"], got[k]["confidence"], got[k]["mixed"]) == ("", 0.0, False) for k in "nbg") and got["m"]["mixed"]


def test_codes():
    assert language_codes(" RU, en,xx ") == ["en", "ru"] and len(language_codes("")) == 6
