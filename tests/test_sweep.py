"""A sweep from exits alone against the metrics of whole equity curves."""

from pyspark.sql import functions as F

from tickloom.operators import tradefilter as T
from tickloom.operators.asof import equity_from_trades
from tickloom.operators.metrics import curve_metrics
from tickloom.plans.queries import KEYS, event_trades, hourly


def test_same_metrics_as_whole_curves(spark, data):
    trades = event_trades(spark, data).withColumn("score", (F.col("trade_id") % 60) / 55.0)
    curve = hourly(spark, data).select(*KEYS, "ts", "bar_seq")
    # A trade before the first bar, a symbol without bars, and one whose losses end at nothing.
    first = curve.agg(F.min("ts")).first()[0]
    more = trades.limit(3).withColumn("exit_time", F.lit(first).cast("timestamp_ntz") - F.expr("INTERVAL 9 DAYS")).withColumn("score", F.lit(0.9))
    gone = trades.limit(2).withColumn("symbol", F.lit("none"))
    ruin = trades.where("symbol = 'view'").orderBy("trade_id").limit(1).withColumn("pnl", F.lit(-100_000.0) - F.col("pnl")).withColumn("score", F.lit(0.99))
    trades = trades.unionByName(more).unionByName(gone).unionByName(ruin)
    got = {(r["symbol"], r["threshold"]): r for r in T.threshold_sweep(trades, curve, KEYS).collect()}
    grid = trades.select(*KEYS).distinct()
    for threshold in (0.02, 0.3, 0.5, 0.78, 0.98):
        kept = trades.where(F.col("score") >= threshold)
        eq = equity_from_trades(kept.select(*KEYS, "exit_time", "pnl"), curve, KEYS)
        whole = {r["symbol"]: r for r in curve_metrics(eq, KEYS).collect()}
        for r in grid.collect():
            x, y = got[r["symbol"], threshold], whole.get(r["symbol"])
            for name in ("total_return_pct", "sharpe_ratio", "max_drawdown_pct"):
                want = y[name] if y is not None else 0.0
                assert abs(x[name] - want) <= 1e-6 * max(1.0, abs(want)), (r["symbol"], threshold, name, x[name], want)
    assert len(got) == 49 * grid.count()
