"""Every query with SQL against DuckDB on the small tables; every other one runs and gives rows."""

import os

import duckdb
import pandas as pd
import pytest

from tickloom.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAY_BE_EMPTY = {"head_shoulders", "head_shoulders_early", "backtest_trades", "walk_forward", "insight_highlights", "spotlights", "insight_rules"}


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, ([None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v) for v in r] for r in df[cols].astype(object).itertuples(index=False))))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


#: On the smallest tables its bricks are over a million, which SQL's recursion takes minutes for.
LARGER = {"renko_auto"}


@pytest.mark.parametrize("name", sorted(LARGER))
def test_same_as_sql_on_more_bars(spark, name):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet')")
    assert _rows(QUERIES[name](spark, d).toPandas()) == _rows(c.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(SQL) - LARGER))
def test_same_as_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"trade_filter_model"}))
def test_runs(spark, data, name):
    n = QUERIES[name](spark, data).count()
    assert n > 0 or name in MAY_BE_EMPTY


def test_entry_runs_without_the_corpus_operators(spark, data, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    monkeypatch.setattr(e, "_llm", None)
    monkeypatch.setattr(e, "_pipeline", None)
    assert set(e.queries()) == set(QUERIES)
    assert set(e.oracle_sql()) == set(SQL)
