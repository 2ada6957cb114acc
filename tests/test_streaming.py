from turnwise.streaming.daily import SCHEMA, daily_counts, read_stream


def test_daily_counts_drop_repeats_and_close_days(spark, tmp_path):
    day = lambda n, i, user="a": (i, user, None, f"2024-03-{n:02d} 10:00:00", None, None)
    rows = [day(1, "u1"), day(1, "u1"), day(1, "u2"), day(1, "u3", "b"), ("x", "a", None, "bad", None, None), day(20, "u9")]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    q = daily_counts(read_stream(spark, folder), "2 days").writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r["bucket_day"])[:10], r["telegram_user_internal_id"], r["n"]) for r in spark.table("daily").collect()}
    assert got == {("2024-03-01", "a", 2), ("2024-03-01", "b", 1)}
