"""Chart patterns over turning points: tops and bottoms, double tops, head and shoulders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import windows as W


def turning(side: str, order: int, source: str = "close") -> Column:
    """True where the bar ``order`` bars ago was an extreme of the ``order`` bars on each side (ties allowed), from bar
    2 * order + 1 on."""
    w = W.frame(2 * order + 1)
    top = F.max(source).over(w) if side == "top" else F.min(source).over(w)
    return F.coalesce((W.lag(source, order) == top) & (F.col("bar_seq") >= 2 * order + 1), F.lit(False))


def pivots(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Adds pivot (0 none, 1 low, 2 high, 3 both) and pivot_pos, a little beyond the extreme (null for 0 and 3)."""
    w = W.series().rowsBetween(-left, right)
    whole = F.count("close").over(w) == left + right + 1
    low = W.flag(whole & (F.col("low") == F.min("low").over(w)))
    high = W.flag(whole & (F.col("high") == F.max("high").over(w)))
    out = bars.withColumn("pivot", low + 2 * high)
    return out.withColumn("pivot_pos", F.when(F.col("pivot") == 1, F.col("low") - 0.001).when(F.col("pivot") == 2, F.col("high") + 0.001))


def doubles(bars: DataFrame, lookback: int = 50, kind: str = "tops", tops_max_ratio: float = 1.01, bottoms_min_ratio: float = 0.98, count: int = 5) -> DataFrame:
    """Adds double_type, chart_type, double_idx and double_point at bars whose last lookback + 1 bars hold exactly five
    pivots in the shape of an M (tops) or W (bottoms). Pivots look ``count`` bars ahead."""
    w = W.frame(lookback + 1)
    p = pivots(bars, count, count)
    got = F.collect_list(F.when(F.col("pivot") != 0, F.struct(F.col("bar_seq").alias("i"), F.col("pivot_pos").alias("p")))).over(w)
    p = p.withColumn("__g", F.when(F.col("bar_seq") >= lookback, got)).withColumn("__x", F.transform("__g", lambda s: s["p"]))
    x = [F.get(F.col("__x"), k) for k in range(5)]
    ok = (F.size("__g") == 5) & ~F.exists("__x", lambda v: v.isNull())
    outer = (0, 2, 4)
    tops = ok & (x[1] > x[3]) & (x[1] / x[3] <= tops_max_ratio) & (x[1] / x[0] >= 1.012) & (x[3] / x[2] >= 1.012)
    bottoms = ok & (x[1] < x[3]) & (x[1] / x[3] >= bottoms_min_ratio)
    for k in outer:
        tops = tops & (x[k] < x[1]) & (x[k] < x[3])
        bottoms = bottoms & (x[k] > x[1]) & (x[k] > x[3])
    none = F.lit(False)
    tops, bottoms = (F.coalesce(c if kind in (k, "both") else none, none) for k, c in (("tops", tops), ("bottoms", bottoms)))
    hit = tops | bottoms
    return p.withColumns({
        "double_type": F.when(bottoms, "bottoms").when(tops, "tops").otherwise(""),
        "chart_type": F.when(hit, "double").otherwise(""),
        "double_idx": F.when(hit, F.transform("__g", lambda s: s["i"])).otherwise(F.array().cast("array<bigint>")),
        "double_point": F.when(hit, F.col("__x")).otherwise(F.array().cast("array<double>")),
    }).drop("__g", "__x")


# --- head and shoulders -----------------------------------------------------------------------------------------------

SHOULDERS = "symbol string, tf string, inverted boolean, start_i long, l_shoulder long, l_armpit long, head long, r_armpit long, r_shoulder long, break_i long, break_p double, neck_start double, neck_end double, neck_slope double, head_width double, head_height double, pattern_r2 double, outcome double"


def _shape(points: list[int], y: np.ndarray, i: int, early: bool) -> dict | None:
    """The pattern with its head up that the four turning points and bar i make; y is mirrored for inverted ones."""
    left, arm_l, head, arm_r = points
    if i - arm_r < 2:
        return None
    right = arm_r + 1 + int(np.argmax(y[arm_r + 1 : i]))
    mid_l, mid_r = (y[left] + y[arm_l]) / 2, (y[right] + y[arm_r]) / 2
    spans = (head - left, right - head)
    slope = (y[arm_r] - y[arm_l]) / (arm_r - arm_l)

    def neck(t: int) -> float:
        return y[arm_l] + (t - arm_l) * slope

    bad_shape = y[head] <= max(y[left], y[right]) or y[left] < mid_r or y[right] < mid_l
    if bad_shape or max(spans) > 2.5 * min(spans) or y[i] > (mid_r if early else neck(i)):
        return None
    width = arm_r - arm_l
    # Where the rise to the left shoulder crossed the neckline, within a head's width and the data.
    back = np.arange(left - 1, left - width, -1)
    under = np.flatnonzero((back >= 0) & (y[np.maximum(back, 0)] < y[arm_l] + (back - arm_l) * slope))
    if not len(under):
        return None
    start = int(back[under[0]])
    knots = np.array([start, left, arm_l, head, arm_r, right, i])
    model = np.interp(np.arange(start, i), knots, np.concatenate(([neck(start)], y[knots[1:]])))
    part = y[start:i]
    spread = ((part - part.mean()) ** 2).sum()
    r2 = 1 - ((part - model) ** 2).sum() / spread if spread else np.nan
    return {"start_i": start, "l_shoulder": left, "l_armpit": arm_l, "head": head, "r_armpit": arm_r, "r_shoulder": right, "break_i": i, "break_p": y[i], "neck_start": neck(start), "neck_end": neck(i), "neck_slope": slope, "head_width": float(width), "head_height": y[head] - neck(head), "pattern_r2": r2}


def outcome(y: np.ndarray, p: dict, log_prices: bool) -> float:
    """What a trade down the break makes within a head's width; null if the data end before."""
    target, stop, at = p["neck_end"] - p["head_height"], y[p["r_shoulder"]], p["break_i"]
    last = -1.0
    for t in range(at, at + int(p["head_width"])):
        if t >= len(y):
            return np.nan
        last = y[t]
        if last < target or last > stop:
            break
    return p["break_p"] - last if log_prices else (p["break_p"] - last) / abs(p["break_p"])


def shoulders(y: np.ndarray, order: int, early: bool = False, log_prices: bool = True) -> list[dict]:
    """All patterns of a series, upright and inverted. After one, its kind waits for the next opposite extreme."""
    found, points = [], []
    locked = {1: False, -1: False}
    for i in range(2 * order + 1, len(y)):
        span = y[i - 2 * order : i + 1]
        for kind, best in ((1, span.max()), (-1, span.min())):
            if y[i - order] == best:
                points = [*points[-4:], (i - order, kind)]
                locked[-kind] = False
        if len(points) < 5:
            continue
        for sign in (1, -1):
            # The four points end with an armpit: the newest but one if the newest is on the head's side.
            four = points[:4] if points[-1][1] == sign else points[1:]
            if locked[sign] or any(a[1] == b[1] for a, b in zip(four, four[1:], strict=False)):
                continue
            p = _shape([t for t, _ in four], y * sign, i, early)
            if p:
                locked[sign] = True
                result = outcome(y * sign, p, log_prices)
                flipped = {k: p[k] * sign for k in ("break_p", "neck_start", "neck_end", "neck_slope")}
                found.append({**p, **flipped, "inverted": sign < 0, "outcome": result})
    return found


def head_shoulders(bars: DataFrame, order: int = 6, early: bool = False, log_prices: bool = True) -> DataFrame:
    """One row per pattern in the (log) closes of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable")
        y = pdf["close"].to_numpy(float)
        rows = shoulders(np.log(y) if log_prices else y, order, early, log_prices)
        names = [c.split()[0] for c in SHOULDERS.split(", ")]
        return pd.DataFrame([{**r, "symbol": pdf["symbol"].iloc[0], "tf": pdf["tf"].iloc[0]} for r in rows], columns=names)

    return bars.groupBy("symbol", "tf").applyInPandas(run, SHOULDERS)
