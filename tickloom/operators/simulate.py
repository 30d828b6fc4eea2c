"""The bar-accurate simulator: positions, trades and the equity curve of each series.

On each bar, in this order: a stop or target that the bar's range touches closes
the position at its level (the stop first if both are), the bar's signal acts, and
the position is valued at the close. So a position opened on a bar is not closed
by that bar's range, and a bar that stops a position out may open another one.
Sums of a series can't run apart from its positions, so each series (and each
parameter set) is one group; the signals come ready as columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADE = "trade_id long, side string, entry_time timestamp_ntz, entry_price double, exit_time timestamp_ntz, exit_price double, pnl double, pnl_pct double, points double, bars_held int, exit_reason string"


@dataclass(frozen=True)
class Costs:
    initial_capital: float = 100_000.0
    position_size: float = 1.0
    commission: float = 0.0
    slippage: float = 0.0
    on_close: bool = True


def run(s: dict[str, np.ndarray], c: Costs = Costs()) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """s: open, high, low, close, go_long, go_short, leave_long, leave_short, stop_dist, target_dist. Trades as (side, entry
    bar, entry price, exit bar, exit price, pnl, pnl_pct, points, reason), the equity and the drawdown of each bar."""
    n = len(s["close"])
    fill = s["close"].copy()
    if not c.on_close and n:
        fill[:-1] = s["open"][1:]
    acts = s["go_long"] | s["go_short"] | s["leave_long"] | s["leave_short"]
    trades: list[tuple] = []
    cash, peak = c.initial_capital, c.initial_capital
    equity, drawdown = np.empty(n), np.empty(n)
    side, entry, at, stop, target = 0, 0.0, 0, np.nan, np.nan

    def close(bar: int, price: float, reason: str) -> None:
        nonlocal cash, side
        out = price - side * c.slippage
        points = side * (out - entry)
        pnl = points * c.position_size - c.commission
        trades.append(("long" if side > 0 else "short", at, entry, bar, out, pnl, points / entry if entry else 0.0, points, reason))
        cash += pnl
        side = 0

    for i in range(n):
        if side:
            adverse, favour = (s["low"][i], s["high"][i]) if side > 0 else (s["high"][i], s["low"][i])
            if side * (adverse - stop) <= 0:
                close(i, stop, "stop_loss")
            elif side * (favour - target) >= 0:
                close(i, target, "take_profit")
        if acts[i]:
            if side > 0 and s["leave_long"][i] or side < 0 and s["leave_short"][i]:
                close(i, fill[i], "signal")
            elif side == 0 and (s["go_long"][i] or s["go_short"][i]):
                side = 1 if s["go_long"][i] else -1
                at, entry = i, fill[i] + side * c.slippage
                stop = s["close"][i] - side * s["stop_dist"][i]
                target = s["close"][i] + side * s["target_dist"][i]
        value = cash + (side * (s["close"][i] - entry) * c.position_size if side else 0.0)
        peak = max(peak, value)
        equity[i], drawdown[i] = round(value, 2), round((value - peak) / peak if peak else 0.0, 6)
    if side:
        close(n - 1, s["close"][-1], "end_of_data")
        equity[-1] = round(cash, 2)
    return trades, equity, drawdown


def flips(s: dict[str, np.ndarray], c: Costs = Costs()) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """As run, for signals that don't know the position: a buy while short closes it and goes long, and the mirror; an
    exit closes either side. s: action (1 buy, -1 sell, 2 exit, 0 none) in place of the conditions."""
    action = s["action"]
    n = len(action)
    trades: list[tuple] = []
    cash = peak = c.initial_capital
    equity, drawdown = np.empty(n), np.empty(n)
    side, entry, at, stop, target = 0, 0.0, 0, np.nan, np.nan
    for i in range(n):
        price = s["close"][i] if c.on_close or i + 1 >= n else s["open"][i + 1]
        events: list[tuple[float, str]] = []
        if side:
            adverse, favour = (s["low"][i], s["high"][i]) if side > 0 else (s["high"][i], s["low"][i])
            if side * (adverse - stop) <= 0:
                events.append((stop, "stop_loss"))
            elif side * (favour - target) >= 0:
                events.append((target, "take_profit"))
        want = int(action[i])
        still = side if not events else 0
        if still and (want == 2 or want == -still):
            events.append((price, "signal_exit" if want == 2 else "flip_to_long" if want > 0 else "flip_to_short"))
        for level, reason in events:
            out = level - side * c.slippage
            points = side * (out - entry)
            pnl = points * c.position_size - c.commission
            trades.append(("long" if side > 0 else "short", at, entry, i, out, pnl, points / entry if entry else 0.0, points, reason))
            cash += pnl
            side = 0
        if side == 0 and want in (1, -1):
            side, at, entry = want, i, price + want * c.slippage
            stop, target = s["close"][i] - want * s["stop_dist"][i], s["close"][i] + want * s["target_dist"][i]
        value = cash + side * (s["close"][i] - entry) * c.position_size
        peak = max(peak, value)
        equity[i], drawdown[i] = round(value, 2), round((value - peak) / peak if peak else 0.0, 6)
    if side:
        out = s["close"][-1] - side * c.slippage
        points = side * (out - entry)
        pnl = points * c.position_size - c.commission
        trades.append(("long" if side > 0 else "short", at, entry, n - 1, out, pnl, points / entry if entry else 0.0, points, "end_of_data"))
        equity[-1] = round(cash + pnl, 2)
    return trades, equity, drawdown


def columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    flags = ("go_long", "go_short", "leave_long", "leave_short")
    return {k: pdf[k].fillna(False).to_numpy(bool) for k in flags if k in pdf} | {k: pdf[k].to_numpy(float, na_value=np.nan) for k in ("open", "high", "low", "close", "stop_dist", "target_dist", "action") if k in pdf}


def simulate(signals: DataFrame, costs: Costs = Costs(), keys: list[str] | None = None) -> DataFrame:
    """One row per bar: the keys, ts, bar_seq, equity, dd, and the trades that closed on it. Signals either know the
    position (the conditions of a strategy) or not (a column ``action``)."""
    keys = keys or ["symbol", "tf"]
    kinds = dict(signals.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ts timestamp_ntz, bar_seq long, equity double, dd double, trades array<struct<{', '.join(x.replace(' ', ':', 1) for x in TRADE.split(', '))}>>"

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable").reset_index(drop=True)
        s = columns(pdf)
        trades, equity, dd = (flips if "action" in s else run)(s, costs)
        ts = pdf["ts"]
        closed: list[list[dict]] = [[] for _ in range(len(pdf))]
        for k, (side, a, ep, b, xp, pnl, pct, points, reason) in enumerate(trades):
            closed[b].append({"trade_id": k, "side": side, "entry_time": ts[a], "entry_price": ep, "exit_time": ts[b], "exit_price": xp, "pnl": pnl, "pnl_pct": pct, "points": points, "bars_held": 0, "exit_reason": reason})
        return pdf[[*keys, "ts", "bar_seq"]].assign(equity=equity, dd=dd, trades=closed)

    return signals.groupBy(*keys).applyInPandas(group, schema)


def trades_of(result: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return result.select(*(keys or ["symbol", "tf"]), F.inline("trades"))


def last_trades(trades: DataFrame, n: int = 12, keys: list[str] | None = None) -> DataFrame:
    """The last n trades of each key, as previews show them."""
    w = Window.partitionBy(*(keys or ["symbol", "tf"])).orderBy(F.desc("trade_id"))
    return trades.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
