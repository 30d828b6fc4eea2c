"""Parameter search and walk-forward checks, distributed over parameter sets and series.

Every (series, parameter set) is one group: the bars are joined to the sets, the
recurrences and the simulation run in one grouped map, and sets are ranked by
aggregates. The bars of a series are sent once for each set; sets are what the
caller lists, so the product is bounded by both.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.operators import indicators as I
from tickloom.operators import simulate as S
from tickloom.operators.metrics import backtest_metrics, objective

KEYS = ["symbol", "tf", "combo_id"]
FAILED = -1e9


def param_sets(spark: SparkSession, ranges: dict[str, list], fixed: dict | None = None) -> DataFrame:
    """combo_id and params (map of doubles): all combinations, numbered in order of the lists; fixed values lie under."""
    names = list(ranges)
    rows = [(k, {**{a: float(b) for a, b in (fixed or {}).items()}, **dict(zip(names, map(float, v), strict=True))}) for k, v in enumerate(product(*ranges.values()))]
    return spark.createDataFrame(rows, "combo_id long, params map<string,double>")


def known_params(defaults: dict, given: dict) -> dict:
    """Overrides of parameters that exist; others are dropped."""
    return {k: v for k, v in given.items() if k in defaults}


def _cross(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a1, b1 = np.concatenate(([np.nan], a[:-1])), np.concatenate(([np.nan], b[:-1]))
    with np.errstate(invalid="ignore"):
        return (a > b) & (a1 <= b1), (a < b) & (a1 >= b1)


def ema_cross_signals(s: dict[str, np.ndarray], p: dict[str, float]) -> dict[str, np.ndarray]:
    """The crossover strategy's signals for one set: as its rules have them, on arrays."""
    c = s["close"]
    fast, slow = int(p.get("ema_fast", 9)), int(p.get("ema_slow", 21))
    up, down = _cross(K.ewma(c, 2 / (fast + 1)), K.ewma(c, 2 / (slow + 1)))
    live = np.arange(len(c)) >= slow + 1
    ok = np.ones(len(c), bool)
    if p.get("use_adx_filter"):
        with np.errstate(invalid="ignore"):
            ok = I._adx(s, int(p.get("adx_period", 14)))["adx"] >= p.get("adx_threshold", 20)
    dist = {k: np.full(len(c), p[v] if p.get(v) else np.nan) for k, v in (("stop_dist", "sl_points"), ("target_dist", "tp_points"))}
    if p.get("use_sl_tp") and not (p.get("sl_points") or p.get("tp_points")):
        a = I._atr(s, int(p.get("atr_period", 14)))["atr"]
        dist = {"stop_dist": a * p.get("atr_sl_mult", 1.5), "target_dist": a * p.get("atr_tp_mult", 2.5)}
    return {"go_long": up & live & ok, "go_short": down & live & ok, "leave_long": down & live, "leave_short": up & live, **dist}


def _level(x: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    return _cross(x, np.full(len(x), float(level)))


def _trend(c: np.ndarray, p: dict[str, float], on: bool) -> tuple[np.ndarray, np.ndarray]:
    if not p.get("use_trend_filter", on):
        return np.ones(len(c), bool), np.ones(len(c), bool)
    e = K.ewma(c, 2 / (int(p.get("ema_trend", 200)) + 1))
    return c > e, c < e


def _packed(s: dict, warmup: int, long, short, leave_long, leave_short, dist: dict | None = None) -> dict[str, np.ndarray]:
    n = len(s["close"])
    live = np.arange(n) >= warmup
    none = {"stop_dist": np.full(n, np.nan), "target_dist": np.full(n, np.nan)}
    return {"go_long": long & live, "go_short": short & live, "leave_long": leave_long & live, "leave_short": leave_short & live, **(dist or none)}


def ha_cross_signals(s: dict[str, np.ndarray], p: dict[str, float]) -> dict[str, np.ndarray]:
    c = I._heikin_ashi(s)["ha_close"]
    fast, slow, trend = (int(p.get(k, d)) for k, d in (("ema_fast", 9), ("ema_slow", 21), ("ema_trend", 55)))
    up, down = _cross(K.ewma(c, 2 / (fast + 1)), K.ewma(c, 2 / (slow + 1)))
    t = K.ewma(c, 2 / (trend + 1))
    dist = None
    if p.get("use_sl_tp"):
        a = I._atr(s, int(p.get("atr_period", 14)))["atr"]
        dist = {"stop_dist": a * p.get("atr_sl_mult", 1.5), "target_dist": a * p.get("atr_tp_mult", 3.0)}
    return _packed(s, max(trend, slow) + 1, up & (s["close"] > t), down & (s["close"] < t), down, up, dist)


def rsi_signals(s: dict[str, np.ndarray], p: dict[str, float]) -> dict[str, np.ndarray]:
    n = int(p.get("rsi_period", 14))
    r = I._rsi(s, n)["rsi"]
    up_ok, down_ok = _trend(s["close"], p, False)
    mid = p.get("rsi_exit_mid", 50)
    with np.errstate(invalid="ignore"):
        return _packed(s, n + 1, _level(r, p.get("rsi_lower", 30))[0] & up_ok, _level(r, p.get("rsi_upper", 70))[1] & down_ok, r >= mid, r <= mid)


def bollinger_signals(s: dict[str, np.ndarray], p: dict[str, float]) -> dict[str, np.ndarray]:
    n, k, c = int(p.get("bb_period", 20)), p.get("bb_std", 2.0), s["close"]
    roll = pd.Series(c).rolling(n)
    mid, sd = roll.mean().to_numpy(), roll.std().to_numpy()
    out = bool(p.get("exit_on_middle", True))
    with np.errstate(invalid="ignore"):
        return _packed(s, n + 1, _cross(c, mid + k * sd)[0], _cross(c, mid - k * sd)[1], out & (c < mid), out & (c > mid))


def macd_signals(s: dict[str, np.ndarray], p: dict[str, float]) -> dict[str, np.ndarray]:
    fast, slow, signal = (int(p.get(k, d)) for k, d in (("fast", 12), ("slow", 26), ("signal", 9)))
    up, down = _level(I._macd(s, fast, slow, signal)["macd_hist"], 0.0)
    up_ok, down_ok = _trend(s["close"], p, True)
    return _packed(s, max(slow, int(p.get("ema_trend", 200))) + 1, up & up_ok, down & down_ok, down, up)


#: The strategies' signals on arrays, for searches: the same as their rules have them.
SIGNALS = {"ema_crossover": ema_cross_signals, "heikin_ashi_ema_cross": ha_cross_signals, "rsi_mean_reversion": rsi_signals, "bollinger_breakout": bollinger_signals, "macd_trend": macd_signals}


def simulate_sets(bars: DataFrame, sets: DataFrame, costs: S.Costs = S.Costs(), signals=ema_cross_signals, keys: list[str] | None = None) -> DataFrame:
    """A row per bar of each set (see simulate), with ``error`` where a set failed."""
    keys = keys or KEYS
    kinds = dict(bars.dtypes) | dict(sets.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ts timestamp_ntz, bar_seq long, equity double, dd double, error string, trades array<struct<{', '.join(x.replace(' ', ':', 1) for x in S.TRADE.split(', '))}>>"

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable").reset_index(drop=True)
        s = {k: pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume")}
        ts, n = pdf["ts"], len(pdf)
        error = None
        try:
            trades, equity, dd = S.run(s | signals(s, dict(pdf["params"].iloc[0])), costs)
        except Exception as e:  # a set that can't run ranks last, the others go on
            trades, equity, dd, error = [], np.full(n, costs.initial_capital), np.zeros(n), f"{type(e).__name__}: {e}"
        closed: list[list[dict]] = [[] for _ in range(n)]
        for k, (side, a, ep, b, xp, pnl, pct, points, reason) in enumerate(trades):
            closed[b].append({"trade_id": k, "side": side, "entry_time": ts[a], "entry_price": ep, "exit_time": ts[b], "exit_price": xp, "pnl": pnl, "pnl_pct": pct, "points": points, "bars_held": 0, "exit_reason": reason})
        return pdf[[*keys, "ts", "bar_seq"]].assign(equity=equity, dd=dd, error=error, trades=closed)

    # Sets are a short list that the caller wrote; each row of bars meets each of them.
    paired = bars.withColumn("__sets", F.lit(1)).join(F.broadcast(sets.withColumn("__sets", F.lit(1))), "__sets").drop("__sets")
    return paired.groupBy(*keys).applyInPandas(group, schema)


def grid_search(bars: DataFrame, sets: DataFrame, goal: str = "sharpe", top_k: int = 50, costs: S.Costs = S.Costs(), signals=ema_cross_signals) -> DataFrame:
    """Ranked sets of each series: symbol, tf, combo_id, params, score, error, metrics. A failed set scores FAILED; ties go
    by combo_id."""
    result = simulate_sets(bars, sets, costs, signals)
    errors = result.groupBy(*KEYS).agg(F.max("error").alias("error"))
    m = backtest_metrics(result.drop("error"), KEYS, costs.initial_capital).join(errors, KEYS)
    m = m.withColumn("score", F.when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(objective(goal)))
    w = Window.partitionBy("symbol", "tf").orderBy(F.desc("score"), "combo_id")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).join(sets, "combo_id")


def walk_forward(bars: DataFrame, best: DataFrame, splits: int = 2, goal: str = "sharpe", costs: S.Costs = S.Costs(), signals=ema_cross_signals) -> DataFrame:
    """The best set (symbol, tf, combo_id, params) on equal runs of each series, in order, the rest left out; series under
    50 bars a run have none. Nothing is tuned again."""
    keys = ["symbol", "tf", "fold"]
    n = F.count("*").over(Window.partitionBy("symbol", "tf"))
    b = bars.withColumn("__n", n).where(F.col("__n") >= 50 * splits).withColumn("fold", F.floor(F.col("bar_seq") / F.floor(F.col("__n") / splits)).cast("long")).where(F.col("fold") < splits)
    w = Window.partitionBy(*keys).orderBy("bar_seq")
    b = b.withColumn("bar_seq", (F.row_number().over(w) - 1).cast("long")).drop("__n").join(best.select("symbol", "tf", "params"), ["symbol", "tf"])
    one = b.sparkSession.createDataFrame([(0,)], "combo_id long")
    result = simulate_sets(b, one, costs, signals, keys).drop("error")
    return backtest_metrics(result, keys, costs.initial_capital).withColumn("score", objective(goal))


def finder(bars: DataFrame, strategy: str, ranges: dict[str, list] | None = None, fixed: dict | None = None, goal: str = "sharpe", max_bars: int | None = None, splits: int = 2) -> tuple[DataFrame, DataFrame]:
    """All sets of a strategy on its own ranges (or these), and the best one on parts of the series. Parameters that the
    strategy doesn't have are dropped; ``max_bars`` keeps only the last bars of each series."""
    from tickloom.plans.strategies import get
    from tickloom.sources.bars import numbered, tail

    s = get(strategy)
    ranges, fixed = known_params(s.defaults, ranges or s.ranges), known_params(s.defaults, fixed or {})
    sets = param_sets(bars.sparkSession, ranges, {k: float(v) for k, v in (s.defaults | fixed).items()})
    b = bars if max_bars is None else numbered(tail(bars, max_bars))
    n = 1
    for v in ranges.values():
        n *= len(v)
    ranked = grid_search(b, sets, goal, max(n, 50), signals=SIGNALS[strategy])
    return ranked, walk_forward(b, ranked.where("rank = 1"), splits, goal, signals=SIGNALS[strategy])


def combo_table(ranked: DataFrame, by: str = "score", descending: bool = True, limit: int = 15) -> DataFrame:
    """The first rows of a search by any figure."""
    return ranked.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "combo_id").limit(limit)


def beats(best: float, original: float) -> bool:
    """A found score counts as better only beyond rounding."""
    return best > original + 1e-6
