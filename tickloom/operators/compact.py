"""The compact feature table: one grouped map for what has memory, windows for the rest, then a final fill."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.operators.indicators import RECURSIVE, bollinger_bands, per_series, true_range

#: The features by subject, in order.
GROUPS: dict[str, list[str]] = {
    "Trend": ["ema_8", "ema_21", "ema_50", "ema_200", "sma_20", "sma_50", "ema_8_21_diff_pct", "ema_21_50_diff_pct", "ema_50_200_diff_pct", "above_ema_50", "above_ema_200", "ma_bullish_alignment", "ma_bearish_alignment", "supertrend_dir"],
    "Momentum": ["rsi_14", "rsi_7", "rsi_21", "macd_line", "macd_signal", "macd_hist", "macd_hist_pos", "stoch_k", "stoch_d", "ret_1", "ret_3", "ret_5", "ret_10", "ret_20", "price_velocity_2", "price_change_4"],
    "Volatility": ["atr_14", "atr_pct", "bb_upper", "bb_lower", "bb_pos", "bb_width_pct", "true_range", "range_pct"],
    "Volume": ["volume", "volume_sma_20", "volume_ratio_20", "volume_momentum_4", "is_high_volume"],
    "Candle": ["body_pct", "upper_wick_pct", "lower_wick_pct", "is_bullish_candle", "is_bearish_candle", "is_doji"],
    "Direction": ["adx_14", "plus_di", "minus_di", "di_diff", "trend_strength"],
    "Heikin Ashi": ["ha_bull", "ha_bear", "ha_streak"],
    "Time": ["hour", "weekday", "session_asia", "session_london", "session_overlap", "session_ny"],
    "Structure": ["is_pivot_high", "is_pivot_low", "is_hh", "is_hl", "is_lh", "is_ll", "is_fvg_bull", "is_fvg_bear", "is_sweep_bull", "is_sweep_bear", "market_structure", "smc_activity_5", "smc_activity_10"],
}
NAMES = [n for g in GROUPS.values() for n in g]
_MEMORY = ["ema_8", "ema_21", "ema_50", "ema_200", "supertrend_dir", "rsi_14", "rsi_7", "rsi_21", "macd_line", "macd_signal", "macd_hist", "atr_14", "adx_14", "plus_di", "minus_di", "ha_open", "ha_close"]


def _memory(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    def run(name: str, **p) -> dict[str, np.ndarray]:
        f, _, defaults, _ = RECURSIVE[name]
        return f(s, **(defaults | p))

    from tickloom.operators.indicators import _heikin_ashi

    m, a, ha = run("macd"), run("adx"), _heikin_ashi(s)
    return {
        **{f"ema_{n}": run("ema", period=n)["ema"] for n in (8, 21, 50, 200)}, **{f"rsi_{n}": run("rsi", period=n)["rsi"] for n in (7, 14, 21)},
        "supertrend_dir": run("supertrend")["supertrend_dir"], "macd_line": m["macd"], "macd_signal": m["macd_signal"], "macd_hist": m["macd_hist"],
        "atr_14": run("atr")["atr"], "adx_14": a["adx"], "plus_di": a["plus_di"], "minus_di": a["minus_di"], "ha_open": ha["ha_open"], "ha_close": ha["ha_close"],
    }


def pivot_at(side: str, n: int = 5) -> Column:
    """n bars behind a bar that is its window's only extreme."""
    x, top = F.col(side), F.max if side == "high" else F.min
    best = top(x).over(W.frame(2 * n + 1))
    only = F.size(F.filter(F.collect_list(x).over(W.frame(2 * n + 1)), lambda v: v == best)) == 1
    return (F.col("bar_seq") >= 2 * n) & (W.lag(side, n) == best) & only


def compact_features(bars: DataFrame, structure: bool = True) -> DataFrame:
    """symbol, tf, ts, bar_seq, open, high, low, close and NAMES. Nulls are filled forward, then by 0."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))  # noqa: E741
    df = per_series(bars, _memory, _MEMORY)
    e = {n: F.col(f"ema_{n}") for n in (8, 21, 50, 200)}
    bb = bollinger_bands()
    low14, rng = W.rmin("low", 14), F.nullif(h - l, F.lit(0.0))
    body, top, bottom = F.abs(c - o), F.greatest(o, c), F.least(o, c)
    hour = F.hour("ts")
    df = df.withColumns({
        "sma_20": W.rmean("close", 20), "sma_50": W.rmean("close", 50),
        **{f"ema_{a}_{b}_diff_pct": F.try_divide(e[a] - e[b], c) for a, b in ((8, 21), (21, 50), (50, 200))},
        "above_ema_50": W.flag(c > e[50]), "above_ema_200": W.flag(c > e[200]),
        "ma_bullish_alignment": W.flag((e[8] > e[21]) & (e[21] > e[50]) & (e[50] > e[200])), "ma_bearish_alignment": W.flag((e[8] < e[21]) & (e[21] < e[50]) & (e[50] < e[200])),
        "macd_hist_pos": W.flag(F.col("macd_hist") > 0), "stoch_k": F.try_divide(100 * (c - low14), W.rmax("high", 14) - low14),
        **{f"ret_{n}": W.change("close", n) for n in (1, 3, 5, 10, 20)}, "price_velocity_2": W.change("close", 2), "price_change_4": W.change("close", 4),
        "atr_pct": F.try_divide(F.col("atr_14"), c), "bb_upper": bb["bb_upper"], "bb_lower": bb["bb_lower"], "true_range": true_range(), "range_pct": F.try_divide(h - l, c),
        "volume_sma_20": F.avg(v).over(W.frame(20)), "volume_momentum_4": W.change("volume", 4),
        "body_pct": F.try_divide(body, rng), "upper_wick_pct": F.try_divide(h - top, rng), "lower_wick_pct": F.try_divide(bottom - l, rng),
        "is_bullish_candle": W.flag(c > o), "is_bearish_candle": W.flag(c < o), "is_doji": W.flag(F.try_divide(body, rng) < 0.1),
        "di_diff": F.col("plus_di") - F.col("minus_di"), "trend_strength": F.when(F.col("adx_14").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("adx_14") / 50))),
        "ha_bull": W.flag(F.col("ha_close") > F.col("ha_open")), "ha_bear": W.flag(F.col("ha_close") < F.col("ha_open")),
        "hour": hour, "weekday": F.weekday("ts"),
        **{f"session_{n}": W.flag((hour >= a) & (hour < b)) for n, a, b in (("asia", 0, 7), ("london", 7, 12), ("overlap", 12, 16), ("ny", 16, 22))},
        **({"is_pivot_high": W.flag(pivot_at("high")), "is_pivot_low": W.flag(pivot_at("low")), "is_fvg_bull": W.flag(W.lag("high", 2) < l), "is_fvg_bear": W.flag(W.lag("low", 2) > h)} if structure else {n: F.lit(0) for n in GROUPS["Structure"]}),
    })
    width = F.nullif(F.col("bb_upper") - F.col("bb_lower"), F.lit(0.0))
    ph, pl = F.col("is_pivot_high") == 1, F.col("is_pivot_low") == 1
    far = F.col("bar_seq") >= 30
    df = df.withColumns({
        "stoch_d": W.rmean("stoch_k", 3), "bb_pos": F.try_divide(c - F.col("bb_lower"), width), "bb_width_pct": F.try_divide(width, c),
        "volume_ratio_20": F.try_divide(v, F.col("volume_sma_20")), "is_high_volume": W.flag(v > F.col("volume_sma_20") * 1.5),
        "__turn": W.flag(F.col("ha_bull") != W.lag("ha_bull")),
        **({"__ph": W.last_event(ph, h), "__pl": W.last_event(pl, l), "__sh": W.last_event(ph, h, 30), "__sl": W.last_event(pl, l, 30)} if structure else {}),
    })
    df = df.withColumns({"__run": F.sum("__turn").over(W.running())})
    if structure:
        df = df.withColumns({
            "is_hh": W.flag(ph & (h > F.col("__ph"))), "is_lh": W.flag(ph & (h <= F.col("__ph"))), "is_hl": W.flag(pl & (l > F.col("__pl"))), "is_ll": W.flag(pl & (l <= F.col("__pl"))),
            "is_sweep_bear": W.flag(far & (h > F.col("__sh")) & (c < F.col("__sh"))), "is_sweep_bull": W.flag(far & (l < F.col("__sl")) & (c > F.col("__sl"))),
        })
        some = F.col("is_pivot_high") + F.col("is_pivot_low") + F.col("is_fvg_bull") + F.col("is_fvg_bear")
        score = F.col("is_hh") + F.col("is_hl") - F.col("is_lh") - F.col("is_ll")
        df = df.withColumns({"market_structure": W.flag(F.sum(score).over(W.frame(20)) > 0), **{f"smc_activity_{n}": F.coalesce(W.rsum(some, n), F.lit(0)).cast("int") for n in (5, 10)}})
    run = W.Window.partitionBy(*W.KEYS, "__run").orderBy("bar_seq")
    df = df.withColumn("ha_streak", F.row_number().over(run))
    kinds = dict(df.dtypes)
    filled = [F.coalesce(W.forward_fill(n), F.lit(0)).cast(kinds[n]).alias(n) for n in NAMES]
    return df.select("symbol", "tf", "ts", "bar_seq", "open", "high", "low", "close", *filled)
