"""Equal buckets: of those with the same rate and trades the lowest limit is the best one, in whatever order they come."""

import duckdb
import pytest

from tickloom.operators import insights
from tickloom.plans.queries import QUERIES, SQL

COLUMNS = "symbol string, tf string, test string, label string, trades long, win_rate_pct double"


@pytest.mark.parametrize("backwards", [False, True])
def test_lowest_limit_of_equal_buckets(spark, backwards):
    rows = [("a", "1h", "adx_gt", str(k), 60, 50.0) for k in range(15, 55, 5)] + [("a", "1h", "rsi_extremes", str(k), 40, 45.0 + 5 * (k >= 85)) for k in range(70, 100, 5)]
    rows += [("b", "1h", "adx_gt", "15", 60, 50.0), ("b", "1h", "adx_gt", "20", 61, 50.0), ("b", "1h", "trend", "with", 30, 50.0), ("b", "1h", "trend", "counter", 30, 50.0)]
    got = insights.highlights(spark.createDataFrame(rows[::-1] if backwards else rows, COLUMNS).coalesce(1)).collect()
    assert {(r["symbol"], r["test"], r["label"]) for r in got} == {("a", "adx_gt", "15"), ("a", "rsi_extremes", "85"), ("b", "adx_gt", "20"), ("b", "trend", "with")}


def test_same_as_sql_that_takes_equal_buckets_in_order(spark, data, tmp_path):
    """Prices that nearly always rise: ADX is over the lower limits, so their buckets are equal. On one thread SQL, which leaves them
    open, takes the first."""
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + INTERVAL 20 MINUTES * event_id AS ts, user_id, 'x' AS event_type, 10.0 + event_id - CASE event_id % 60 WHEN 59 THEN 10 ELSE 0 END AS value, props FROM read_parquet('{data}/events.parquet')) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = c.execute(f"SELECT symbol, test, label, trades FROM ({SQL['insight_highlights']})").fetchall()
    assert ("x", "adx_gt", "15") in {x[:3] for x in want}
    assert sorted(want) == sorted(map(tuple, QUERIES["insight_highlights"](spark, str(tmp_path)).select("symbol", "test", "label", "trades").collect()))
