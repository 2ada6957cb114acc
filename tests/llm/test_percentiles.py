import random

import pytest
from pyspark.sql import functions as F

from turnwise.llm import percentiles as P

QS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def ranks_hold(values, got, error):
    values = sorted(values)
    for q, v in got.items():
        below, upto = sum(x < v for x in values), sum(x <= v for x in values)
        slack = error * len(values) + 1
        assert below - slack <= q * len(values) <= upto + slack, (q, v, below, upto)


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_rank_error_is_bounded_for_skewed_groups(spark, error):
    rng = random.Random(3)
    rows = [("hot", int(rng.lognormvariate(14, 2))) for _ in range(20_000)] + [("same", 7)] * 500 + [("few", x) for x in (1, 5, 9)] + [("hot", None), (None, 4), ("edge", -5), ("edge", 1 << 40), ("edge", -(1 << 63)), ("edge", (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "g string, v bigint").withColumn("n", F.lit("clash")).repartition(6)
    d = P.build(df, "v", "g", error)
    got = {}
    for r in P.quantiles(d, QS, error).collect():
        got.setdefault(r["grp"], {})[r["q"]] = r["value"]
    for g in ("hot", "same", "few", "edge"):
        ranks_hold([v for k, v in rows if k == g and v is not None], got[g], error)
    assert set(got) == {"hot", "same", "few", "edge"}
    assert got["few"][0.5] == 5 and got["same"][0.5] == 7
    assert d.filter("grp = 'hot'").count() <= 3 * P.BITS / error


@pytest.mark.parametrize("kind", ["double", "float", "decimal(20,4)"])
def test_numbers_that_are_no_integers(spark, kind):
    rng = random.Random(5)
    values = [round(rng.gauss(0, 1) * 10 ** rng.randint(-3, 6), 3) for _ in range(20_000)] + [0.0, -0.0, -5.0, -4.0, float(1 << 33)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 1.5)], "g string, v double").withColumn("v", F.col("v").cast(kind)).repartition(5)
    kept = [float(r[0]) for r in df.filter("g = 'a' and v is not null").select("v").collect()]
    if kind != "decimal(20,4)":
        df = df.union(spark.createDataFrame([("a", float("nan"))], "g string, v double"))
    got = {(r["grp"], r["q"]): r["value"] for r in P.quantiles(P.build(df, "v", "g"), QS, floating=True).collect()}
    ranks_hold(kept, {q: v for (g, q), v in got.items() if g == "a"}, P.ERROR)
    assert got["b", 0.5] == 1.5


def test_what_a_task_holds_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "FLUSH", 30_000)
    m = P._Merger(P.BITS / 0.05, True)
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    out, sent = [], 0
    for name, batches in (("a", 1), ("hot", 40), ("z", 1)):
        for _ in range(batches):
            out += list(m.add(pa.array([name] * 5000), np.zeros(5000, np.int32), rng.integers(-(10**12), 10**12, 5000), np.ones(5000, np.int64)))
            assert m.count <= 30_000
            sent += 5000
    out += list(m.emit())
    rows = [r for b in out for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == sent and len([r for r in rows if r["grp"] == "hot"]) <= 3 * P.BITS / 0.05
    assert len({(r["grp"], r["level"], r["node"]) for r in rows}) == len(rows)


def test_merging_days_keeps_counts_and_bound(spark):
    rng = random.Random(4)
    rows = [(f"d{i % 9}", rng.randint(0, 10**9)) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    days = [P.build(df.filter(F.col("g") == f"d{i}"), "v", "g") for i in range(3)] + [P.build(df.filter(F.col("g") > "d2"), "v", "g")]
    whole = P.regroup(P.merge(*days), F.lit("*"))
    assert whole.agg(F.sum("n")).first()[0] == 9000
    ranks_hold([v for _, v in rows], {r["q"]: r["value"] for r in P.quantiles(whole, QS).collect()}, P.ERROR)


def test_empty(spark):
    assert P.quantiles(P.build(spark.createDataFrame([], "g string, v bigint"), "v", "g"), QS).count() == 0
