import random
from collections import defaultdict
from datetime import datetime, timedelta

from turnwise.operators import skew


def test_activity_matches_brute_force_with_a_hot_user(transcripts):
    rng = random.Random(5)
    start = datetime(2024, 3, 1)
    rows = []
    for i in range(900):
        user = rng.choice(["hot"] * 6 + ["a", "b", None, "", "  "])
        at = (start + timedelta(minutes=rng.randint(0, 60 * 24 * 40))).strftime("%Y-%m-%d %H:%M:%S")
        rows.append((f"u{i}", user, rng.choice([at] * 9 + [None, "", "2024-13-01 00:00:00", "n/a"]), "x"))
    rows += rows[:40]  # repeated deliveries
    got = {r["telegram_user_internal_id"]: r for r in skew.user_activity(transcripts(rows), chunk_rows=17).collect()}
    groups = defaultdict(list)
    for i, user, at, _ in rows:
        try:
            t = datetime.strptime(at, "%Y-%m-%d %H:%M:%S")
        except (TypeError, ValueError):
            t = None
        groups[user if user and user.strip() else None].append((t, i))
    assert set(got) == set(groups)
    for user, own in groups.items():
        own.sort(key=lambda x: (x[0] or datetime.min, x[1]))
        times = [t for t, _ in own if t]
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        r = got[user]
        assert r["n_rows"] == len(own)
        assert r["n_transcripts"] == len(set(own))
        assert (r["first_at"], r["last_at"]) == ((times[0], times[-1]) if times else (None, None))
        assert r["n_sessions"] == (1 + sum(g > 6 * 3600 for g in gaps) if times else 0)
        assert r["max_pause_s"] == (max(gaps) if gaps else None)


def test_ranks_are_dense_and_chunks_equal(spark):
    df = spark.createDataFrame([("k" if i % 3 else "m", i % 7, "other") for i in range(1000)], "k string, v int, n string")
    numbered, counts = skew.number_rows(df, "k", ["v"], chunk_rows=50)
    for key, n in ((r["k"], r["n"]) for r in counts.collect()):
        rows = sorted((r["_rank"], r["v"], r["_chunk"]) for r in numbered.filter(numbered.k == key).collect())
        assert [r[0] for r in rows] == list(range(n))
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert all(c == rank // 50 for rank, _, c in rows)


def test_heavy_users_and_empty_table(transcripts):
    rows = [(f"u{i}", "big" if i < 30 else f"s{i}", None, None) for i in range(100)] + [("z", None, None, None)] * 5
    assert [r[0] for r in skew.heavy_users(transcripts(rows), share=0.2).collect()] == ["big"]
    assert skew.heavy_users(transcripts(rows).limit(0)).count() == 0
    assert skew.user_activity(transcripts(rows).limit(0)).count() == 0


def test_ranked_quantiles_equal_percentile(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["b", None, "one"]), rng.choice([None, float(rng.randint(-9, 9)), rng.random(), -rng.random() * 1e-3, -0.0, 1e12 * rng.random(), float("nan")]), None) for _ in range(700)] + [("solo", 3.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {(r["k"], r["metric"]): (r["n_rows"], r["q_0"], r["q_1"]) for r in skew.ranked_quantiles(df, ["k"], ["x", "y"], (0.5, 0.9)).collect()}
    for k in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == k and r[1] is not None and r[1] == r[1])
        n, *qs = got[k, "x"]
        assert n == sum(r[0] == k for r in rows) and got[k, "y"] == (n, None, None)
        for q, v in zip((0.5, 0.9), qs):
            p = (len(own) - 1) * q
            lo, hi = own[int(p)], own[min(int(p) + (p > int(p)), len(own) - 1)]
            assert abs(v - (lo + (hi - lo) * (p - int(p)))) <= 1e-9 * max(1, abs(v))
    assert skew.ranked_quantiles(df.limit(0), ["k"], ["x"]).count() == 0


def test_ranked_quantiles_stay_lazy_and_spread_a_hot_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"), (F.col("id") % 7001).cast("double").alias("x"))
    got = skew.ranked_quantiles(df, ["k"], ["x"], (0.5,))
    want = df.groupBy("k").agg(F.percentile("x", 0.5).alias("q")).collect()
    assert {(r["k"], r["q_0"]) for r in got.collect()} == {(r["k"], r["q"]) for r in want}
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan
