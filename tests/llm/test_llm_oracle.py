"""The queries that SQL expresses, against DuckDB on the small tables."""

import duckdb
import pytest

from tickloom.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    got, want = queries()[name](spark, data).toPandas(), duck.execute(oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].astype(str).to_numpy())) == sorted(map(tuple, want[cols].astype(str).to_numpy()))


def test_names():
    names = list(queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
