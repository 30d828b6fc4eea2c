"""Renko bricks from closes: a grouped map that gives any number of rows for a bar."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names of the ways to draw a brick's open and far end.
MODES = ("normal", "wicks", "nongap", "reverse-wicks", "reverse-nongap", "fake-r-wicks", "fake-r-nongap")
SCHEMA = "symbol string, tf string, ts timestamp_ntz, bar_seq long, open double, high double, low double, close double, volume double, source_seq long"


def brick_path(close: np.ndarray, size: float) -> pd.DataFrame:
    """Bricks in order: source bar, price (its close), direction, wick, volume (bars since the brick before).

    A move on in the same direction gives a brick for each whole size; a turn needs two sizes, and its first brick
    jumps both.
    """
    price = np.floor(close[0] / size) * size
    heading, lowest, highest, bars = 0, price, price, 1
    out = []
    for i, c in enumerate(close[1:].tolist(), 1):
        lowest, highest, bars = min(lowest, c), max(highest, c), bars + 1
        move = (c - price) / size
        sign = int(np.sign(move))
        steps = abs(move)
        if heading * sign < 0:
            if steps < 2:
                continue
            jumps = [2] + [1] * int(steps - 2)
        else:
            jumps = [1] * int(steps)
        for j in jumps:
            price += sign * j * size
            out.append((i, price, sign, lowest if sign > 0 else highest, bars))
            bars = 1
            lowest, highest = (price, highest) if sign > 0 else (lowest, price)
            heading = sign
    return pd.DataFrame(out, columns=["at", "price", "dir", "wick", "bars"])


def draw(path: pd.DataFrame, start: float, size: float, mode: str) -> pd.DataFrame:
    """Open, high, low and close of each brick. Its far end is where it comes from: the last close of its own direction
    while that goes on; at a turn, by mode, one size from the last close, the last close the other way, or the wick."""
    d = path["dir"].to_numpy()
    price, wick = path["price"].to_numpy(), path["wick"].to_numpy()
    before = np.concatenate(([start], price[:-1]))
    before_d = np.concatenate(([0], d[:-1]))
    # The latest earlier close of each direction; 0 before the first.
    last = {s: pd.Series(np.where(d == s, price, np.nan)).ffill().shift().fillna(0.0).to_numpy() for s in (1, -1)}
    own = np.where(d == 1, last[1], last[-1])
    other = np.where(d == 1, last[-1], last[1])
    on = before_d == d
    near = before + d * size
    turn_open = near if mode in ("normal", "wicks", "reverse-wicks", "fake-r-wicks") else other if mode == "fake-r-nongap" else wick
    turn_far = near if mode == "normal" else other if mode.startswith("fake-r") else wick
    open_ = np.where(on, wick if mode == "nongap" else own, turn_open)
    far = np.where(on, wick if mode in ("wicks", "nongap") else own, turn_far)
    return pd.DataFrame({"open": open_, "high": np.where(d == 1, price, far), "low": np.where(d == 1, far, price), "close": price})


def auto_brick(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> float:
    return max(float(np.nanmedian(close)) * 0.001, float(np.nanmedian(high - low)) * 0.25, 1e-9)


def renko(bars: DataFrame, brick_size: float | None = None, mode: str = "wicks") -> DataFrame:
    """Bricks of each series; ts is not unique, bar_seq is. A size of null or 0 is drawn from the series' own medians.
    The starting row and the first brick are left out."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable").dropna(subset=["ts", "close"]).reset_index(drop=True)
        cols = ["symbol", "tf", "ts", "bar_seq", "open", "high", "low", "close", "volume", "source_seq"]
        if pdf.empty:
            return pd.DataFrame(columns=cols)
        size = brick_size if brick_size and brick_size > 0 else auto_brick(*(pdf[c].to_numpy(float) for c in ("high", "low", "close")))
        close = pdf["close"].to_numpy(float)
        path = brick_path(close, size)
        out = draw(path, np.floor(close[0] / size) * size, size, mode).iloc[1:].reset_index(drop=True)
        kept = path.iloc[1:].reset_index(drop=True)
        src = pdf.iloc[kept["at"]].reset_index(drop=True)
        return out.assign(symbol=pdf["symbol"].iloc[0], tf=pdf["tf"].iloc[0], ts=src["ts"], source_seq=src["bar_seq"], volume=kept["bars"].astype(float), bar_seq=np.arange(len(out)))[cols]

    return bars.groupBy("symbol", "tf").applyInPandas(run, SCHEMA)


def apply_chart(bars: DataFrame, chart: dict | None) -> DataFrame:
    """The bars as they are, or as Renko if the chart asks for it."""
    if not chart or (chart.get("type") or "").lower() != "renko":
        return bars
    return renko(bars, chart.get("brick_size"), chart.get("mode") or "wicks").select("symbol", "tf", "ts", F.col("bar_seq"), "open", "high", "low", "close", "volume")
