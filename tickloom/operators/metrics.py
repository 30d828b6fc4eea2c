"""Performance of equity curves and trades, by any key, in aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ["initial_capital", "final_equity", "total_return_pct", "cagr_pct", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "n_trades", "long_trades", "short_trades", "win_rate_pct", "avg_win", "avg_loss", "avg_trade", "best_trade", "worst_trade", "profit_factor", "expectancy", "gross_profit", "gross_loss", "total_points", "avg_points", "avg_points_win", "avg_points_loss", "best_points", "worst_points"]


def profit_factor(won: Column, lost: Column) -> Column:
    """999 for gains without losses, 0 for neither."""
    return F.when(lost != 0, F.try_divide(won, F.abs(lost))).when(won > 0, 999.0).otherwise(0.0)


def trade_aggregates() -> list[Column]:
    """What trades add up to; a win is a pnl over 0."""
    x, pts = F.col("pnl"), F.col("points")
    win, loss = x > 0, x < 0
    z = F.lit(0.0)
    return [
        F.count("pnl").alias("n_trades"), F.count_if(F.col("side") == "long").alias("long_trades"), F.count_if(F.col("side") == "short").alias("short_trades"),
        F.coalesce(100.0 * F.try_divide(F.count_if(win), F.count("pnl")), z).alias("win_rate_pct"),
        F.coalesce(F.avg(F.when(win, x)), z).alias("avg_win"), F.coalesce(F.avg(F.when(loss, x)), z).alias("avg_loss"), F.coalesce(F.avg(x), z).alias("avg_trade"), F.coalesce(F.max(x), z).alias("best_trade"), F.coalesce(F.min(x), z).alias("worst_trade"),
        F.coalesce(F.sum(F.when(win, x)), z).alias("gross_profit"), F.coalesce(F.abs(F.sum(F.when(loss, x))), z).alias("gross_loss"),
        F.coalesce(F.sum(pts), z).alias("total_points"), F.coalesce(F.avg(pts), z).alias("avg_points"), F.coalesce(F.avg(F.when(pts > 0, pts)), z).alias("avg_points_win"), F.coalesce(F.avg(F.when(pts < 0, pts)), z).alias("avg_points_loss"),
        F.coalesce(F.max(pts), z).alias("best_points"), F.coalesce(F.min(pts), z).alias("worst_points"),
    ]


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    t = trades.groupBy(*keys).agg(*trade_aggregates())
    return t.withColumns({"profit_factor": profit_factor(F.col("gross_profit"), F.col("gross_loss")), "expectancy": F.col("avg_trade")})


def curve_metrics(curve: DataFrame, keys: list[str], initial_capital: float = 100_000.0) -> DataFrame:
    """From (keys, ts, bar_seq, equity): return, drawdown, growth a year, and the two ratios per bar, by 252."""
    w = Window.partitionBy(*keys).orderBy("bar_seq")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = curve.withColumns({"__r": F.try_divide(F.col("equity") - F.lag("equity").over(w), F.lag("equity").over(w)), "__dd": F.try_divide(F.col("equity") - peak, peak)})
    r = F.col("__r")
    a = c.groupBy(*keys).agg(F.min_by("equity", "bar_seq").alias("__first"), F.max_by("equity", "bar_seq").alias("final_equity"), F.min("ts").alias("__t0"), F.max("ts").alias("__t1"), F.min("__dd").alias("__dd"), F.count(r).alias("__n"), F.avg(r).alias("__m"), F.stddev_pop(r).alias("__s"), F.count_if(r < 0).alias("__dn"), F.stddev_pop(F.when(r < 0, r)).alias("__ds"), F.count("*").alias("__bars"))
    years = F.greatest(F.timestamp_diff("SECOND", F.col("__t0").cast("timestamp"), F.col("__t1").cast("timestamp")) / (365.25 * 86400), F.lit(1e-6))
    some = (F.col("__n") > 1) & (F.col("__s") > 0)
    z = F.lit(0.0)
    return a.select(
        *keys, F.lit(float(initial_capital)).alias("initial_capital"), "final_equity",
        F.coalesce((F.try_divide(F.col("final_equity"), F.lit(float(initial_capital))) - 1) * 100, z).alias("total_return_pct"),
        F.when((F.col("__bars") >= 2) & (F.col("__first") > 0), (F.pow(F.try_divide(F.col("final_equity"), F.col("__first")), 1 / years) - 1) * 100).otherwise(z).alias("cagr_pct"),
        F.coalesce(F.col("__dd") * 100, z).alias("max_drawdown_pct"),
        F.when(some, F.sqrt(F.lit(252.0)) * F.col("__m") / F.col("__s")).otherwise(z).alias("sharpe_ratio"),
        F.when(some & (F.col("__dn") > 0) & (F.col("__ds") > 0), F.sqrt(F.lit(252.0)) * F.col("__m") / F.col("__ds")).otherwise(z).alias("sortino_ratio"),
    )


def backtest_metrics(result: DataFrame, keys: list[str] | None = None, initial_capital: float = 100_000.0, digits: int = 2) -> DataFrame:
    """All of NAMES for each key of a simulation."""
    keys = keys or ["symbol", "tf"]
    from tickloom.operators.simulate import trades_of

    both = curve_metrics(result, keys, initial_capital).join(trade_metrics(trades_of(result, keys), keys), keys, "left")
    kinds = dict(both.dtypes)
    return both.select(*keys, *[(F.coalesce(F.col(n), F.lit(0)).cast("long") if kinds[n] == "bigint" else F.bround(F.coalesce(F.col(n), F.lit(0.0)), digits)).alias(n) for n in NAMES])


#: The objectives of searches.
OBJECTIVES = {"sharpe": "sharpe_ratio", "total_return": "total_return_pct", "profit_factor": "profit_factor", "expectancy": "expectancy", "cagr": "cagr_pct", "win_rate": "win_rate_pct"}


def objective(name: str) -> Column:
    """The score that a search ranks by; unknown names rank by the Sharpe ratio, as an unscored set ranks 0."""
    if name == "calmar":
        return F.coalesce(F.try_divide(F.col("total_return_pct"), F.abs("max_drawdown_pct")), F.lit(0.0))
    return F.coalesce(F.nanvl(F.col(OBJECTIVES.get(name, "sharpe_ratio")), F.lit(0.0)), F.lit(0.0))
