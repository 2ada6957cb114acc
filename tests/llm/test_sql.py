"""Training-text queries that SQL can say, compared with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tests.test_oracle import canonical
from turnwise.llm import oracle_sql, queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, small)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), names)
