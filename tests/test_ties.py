"""Queries over values that end on ties of the sixth place, or have none: every bit as DuckDB has it."""

import datetime as dt
import math
import random

import duckdb
import pytest

from turnwise.operators import reshape, skew
from turnwise.queries import METRICS, QUERIES, SQL, rounded

START = dt.datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """A table of features with few six-place values a day, and days of infinities, equal, huge, tiny and missing values."""
    rng = random.Random(3)
    days = [[(rng.random(), rng.random() * 5000) for _ in range(rng.randint(1, 9))] for _ in range(400)]
    days += [[(0.428571, 0.428571), (1.0, 1.0), (1.0, 1.0)]]
    inf = math.inf
    days += [[(x, x) for x in xs] for xs in ([inf] * 3, [-inf, 1.0, 2.0], [-inf, inf], [0.1] * 10, [1e300, 1.7e308], [5e-324, 1e-320], [-0.0, 0.0], [None, None])]
    place = lambda x: round(x, 6) if x is not None and 1e-6 < x < 1e6 else x
    rows = [(START + dt.timedelta(days=i), 3, place(a), place(b), None) for i, day in enumerate(days) for a, b in day]
    path = tmp_path_factory.mktemp("tied")
    df = spark.createDataFrame(rows, "created_at_parsed timestamp_ntz, " + ", ".join(f"{m} {'double' if 'ratio' in m or 'seconds' in m else 'bigint'}" for m in METRICS))
    df.withColumn("bucket_day", df.created_at_parsed.cast("string")).write.parquet(f"{path}/feature_rows.parquet")
    return str(path)


def both(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW feature_rows AS SELECT * FROM '{path}/feature_rows.parquet/*.parquet'")
    got = con.execute(SQL[name])
    names = [c[0] for c in got.description]
    order = lambda rows: sorted((tuple("nan" if x != x else x for x in r) for r in rows), key=lambda r: str([x for x in r if not isinstance(x, float)]))
    want = order(got.fetchall())
    return [order([tuple(r) for r in QUERIES[name](spark, path).select(names).collect()]), want]


def test_bucket_day_quantiles_on_ties(spark, tied):
    got, want = both(spark, tied, "bucket_day_quantiles")
    assert len(got) == 409
    assert {r[0]: r for r in got} == {r[0]: r for r in want}


def test_quantiles_of_ties(spark):
    df = spark.createDataFrame([(0.428571,), (1.0,), (1.0,)], "x double")
    assert [tuple(r) for r in skew.ranked_quantiles(df, [], ["x"], (0.25, 0.5)).select("q_0", "q_1").collect()] == [(0.7142855, 1.0)]


def test_rounded_as_duckdb(spark):
    values = [0.0320655, 266.2450105, -0.5080815, 0.7142855, math.nextafter(0.7142855, 0), 0.5e-6, math.nextafter(0.5e-6, 0), 1e303, -1.7e308, math.inf, -math.inf, 123456789012345.67, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    want = duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()
    assert [r[0] for r in rounded(df).collect()] == [r[0] for r in want]
    assert math.isnan(rounded(spark.createDataFrame([(math.nan,)], "x double")).first()[0])


def test_long_form_aggregate_on_ties(spark, tied):
    got, want = both(spark, tied, "long_form_aggregate")
    assert len(got) == 4 * 409
    assert {r[:2]: r for r in got} == {r[:2]: r for r in want}


def test_long_form_aggregate_on_signed_zeros_and_nan(spark, tmp_path):
    nan, inf = math.nan, math.inf
    days = [[-0.0], [-0.0] * 3, [-4e-7], [-4e-7, 4e-7, 4e-7], [-1.0, -0.0], [0.0, 0.0], [nan], [1.0, nan], [1.0, 2.0, 3.0, 4.0, nan], [inf, nan, -inf]]
    rows = [(START + dt.timedelta(days=i), 3, x, x, None) for i, day in enumerate(days) for x in day]
    df = spark.createDataFrame(rows, "created_at_parsed timestamp_ntz, " + ", ".join(f"{m} {'double' if 'ratio' in m or 'seconds' in m else 'bigint'}" for m in METRICS))
    df.withColumn("bucket_day", df.created_at_parsed.cast("string")).write.parquet(f"{tmp_path}/feature_rows.parquet")
    got, want = both(spark, str(tmp_path), "long_form_aggregate")
    assert len(got) == 4 * len(days)
    assert {r[:2]: repr(r) for r in got} == {r[:2]: repr(r) for r in want}  # 0.0 == -0.0, their texts differ


def test_long_form_of_odd_years(spark):
    years = (-43, 0, 7, 999, 2024, 9999, 12000)
    wide = spark.sql(" UNION ALL ".join(f"SELECT make_timestamp_ntz({y}, 3, 15, 0, 0, 0) AS bucket_day, 1L AS n_rows, 1D AS x_median, 1D AS x_q1, 1D AS x_q3" for y in years))
    want = duckdb.execute("SELECT strftime(make_timestamp(unnest(?::BIGINT[]), 3, 15, 0, 0, 0), '%Y-%m-%d %H:%M:%S')", [list(years)]).fetchall()
    assert sorted(r[0] for r in reshape.to_long(wide, "bucket_day").collect()) == sorted(r[0] for r in want)
