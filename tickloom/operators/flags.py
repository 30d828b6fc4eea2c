"""The library of 0/1 flags over bars, by subject.

Four steps. What has memory without bound (Wilder and seeded averages, a Kalman
level, sessions' extremes) comes from a scan over blocks of bars, longer timeframes
from tables of their own, joined by the start of a bar's longer bar. The rest runs
in blocks that take along the bars they look back on: rolling ranks and quantiles,
then the flags of bars and of those columns, as window expressions in a few wide
selects, last the flags that count other flags.

A comparison with an unknown value is 0. Relative changes from 0 are unknown.
Known properties, kept: longer timeframes know the close of their open bar,
ranges include the current bar (so some breakouts never fire), the efficiency
threshold is the whole series', and mtf_mixed_signals is -1 or -2.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.functions import windows as W
from tickloom.functions.order import exact_quantile
from tickloom.operators import scan as S
from tickloom.operators.indicators import per_series, true_range
from tickloom.operators.longer import HTF_FLAGS, longer_flags
from tickloom.sources.bars import SECONDS
from tickloom.sources.store import cut

EMAS = (5, 8, 13, 21, 34, 50, 89, 100, 200)
RSIS = (2, 9, 14, 21, 30)
PAIRS = ((8, 21), (13, 34), (50, 200))
FAR = (8, 21, 50, 200)
#: Rolling ranks: name -> (series, length); rolling quantiles: name -> (series, length, share).
RANKS = {"atr100": ("atr_pct", 100), "atr_own100": ("atr", 100), "tr50": ("tr_pct", 50), "move50": ("move1", 50), "range100": ("hl_pct", 100), "bbw50": ("bbw", 50), "bbw100": ("bbw", 100), "span20": ("span20", 100), "span50": ("span50", 100), "rsi200": ("rsi14", 200), "ema21_100": ("far21", 100), "kal50": ("kal_step", 50)}
QUANTILES = {
    **{f"sep{a}_{b}_{int(p * 100)}": (f"sep{a}_{b}", 50, p) for a, b in PAIRS for p in (0.7, 0.3)},
    **{f"far{n}_{int(p * 100)}": (f"far{n}", 50, p) for n in FAR for p in (0.8, 0.2)},
    **{f"move{n}_{int(p * 100)}": (f"move{n}", 50, p) for n in (3, 5, 10) for p in (0.75, 0.25)},
    "impulse": ("move5", 100, 0.8), "displace": ("move3", 50, 0.85), "absorb": ("move1", 20, 0.3),
}
FAST, SLOW, SIGNAL = 12, 26, 9
#: Sessions: hours inside, and their length.
SESSIONS = {"asia": (lambda h: (h >= 23) | (h < 8), 9), "london": (lambda h: (h >= 8) & (h < 16), 8), "ny": (lambda h: (h >= 13) & (h < 21), 8)}
MEMORY = [*[f"_ema_{n}" for n in EMAS], *[f"_rsi_{n}" for n in RSIS], "_macd", "_macd_sig", "_adx", "_pdi", "_mdi", "_atr", "_kal", "_obv"]
FRAMED = ["_cci", *[f"_rank_{k}" for k in RANKS], *[f"_q_{k}" for k in QUANTILES], "_eff"]


def _change(x: np.ndarray, n: int) -> np.ndarray:
    prev = np.concatenate((np.full(n, np.nan), x))[: len(x)]
    return K.ratio(x, prev) - 1


# --- what has memory without bound: a scan over blocks ----------------------------------------------------------------


def _averages(s: dict, own: int, _: dict) -> dict[str, S.Recurrence]:
    h, l, c, v, at = s["high"], s["low"], s["close"], s["volume"], s["bar_seq"]  # noqa: E741
    d = np.diff(c, prepend=np.nan)
    up, down = np.where(np.isnan(d), np.nan, np.maximum(d, 0)), np.where(np.isnan(d), np.nan, np.maximum(-d, 0))
    tr = K.true_range(h, l, c)
    tr[:1] = np.nan
    plus, minus = K.directional(h, l)
    step = np.where(d > 0, v, np.where(d < 0, -v, np.where(at == 0, v, 0.0)))
    # MACD's averages begin together, each seeded by its own last values.
    late = np.where(at >= SLOW - FAST, c, np.nan)
    return {
        **{f"ema{n}": S.Seeded(c, n, 2 / (n + 1), own) for n in EMAS},
        **{f"{x}{n}": S.Seeded(y, n, 1 / n, own) for n in RSIS for x, y in (("up", up), ("down", down))},
        "fast": S.Seeded(late, FAST, 2 / (FAST + 1), own), "slow": S.Seeded(c, SLOW, 2 / (SLOW + 1), own),
        "plus": S.Summed(plus, 14, own), "minus": S.Summed(minus, 14, own), "total": S.Summed(tr, 14, own), "atr": S.Seeded(tr, 14, 1 / 14, own),
        "kal": S.Level(c[own:], own == 0), "obv": S.Total(step[own:]),
    }


def _averaged(s: dict, own: int, got: dict, _: dict) -> dict[str, np.ndarray]:
    out = {f"_ema_{n}": got[f"ema{n}"] for n in EMAS}
    for n in RSIS:
        a, b = got[f"up{n}"], got[f"down{n}"]
        out[f"_rsi_{n}"] = np.where(a + b == 0, 0.0, 100 * K.ratio(a, np.where(a + b == 0, np.nan, a + b)))
    pdi, mdi = 100 * K.ratio(got["plus"], got["total"]), 100 * K.ratio(got["minus"], got["total"])
    early = s["bar_seq"][own:] < 14  # the running sums show one bar later
    pdi, mdi = np.where(early, np.nan, pdi), np.where(early, np.nan, mdi)
    return out | {"_pdi": pdi, "_mdi": mdi, "_atr": got["atr"], "_kal": got["kal"], "_obv": got["obv"], "line": got["fast"] - got["slow"]}


def _signals(s: dict, own: int, made: dict) -> dict[str, S.Recurrence]:
    pdi, mdi = made["_pdi"], made["_mdi"]
    return {"signal": S.Seeded(made["line"], SIGNAL, 2 / (SIGNAL + 1)), "adx": S.Seeded(100 * K.ratio(np.abs(pdi - mdi), pdi + mdi), 14, 1 / 14)}


def _signalled(s: dict, own: int, got: dict, made: dict) -> dict[str, np.ndarray]:
    return {"_macd": np.where(np.isnan(got["signal"]), np.nan, made["line"]), "_macd_sig": got["signal"], "_adx": got["adx"]}


def _per_hour(tf: str) -> int:
    return max(1, 3600 // SECONDS[tf]) if tf in SECONDS else 4


def _extremes(tf: str) -> S.Stage:
    """Extremes of each session over its length in bars, carried on to where the next ones are known."""

    def recur(s: dict, own: int, _: dict) -> dict[str, S.Recurrence]:
        out = {}
        for name, (inside, hours) in SESSIONS.items():
            n = _per_hour(tf) * hours
            mask = inside(s["__hour"])
            for side, x in (("h", s["high"]), ("l", s["low"])):
                seen = pd.Series(np.where(mask, x, np.nan)).rolling(n, min_periods=1)
                out[f"{name}_{side}"] = S.Last((seen.max() if side == "h" else seen.min()).to_numpy()[own:])
        return out

    return recur, lambda s, own, got, made: {f"_f_{k}": v for k, v in got.items()}


# --- what looks back a bounded number of bars -------------------------------------------------------------------------


def _windowed(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ranks and quantiles of frames (pandas keeps a frame's values in a sorted skip list), CCI, and the efficiency."""
    h, l, c, v = s["high"], s["low"], s["close"], s["volume"]  # noqa: E741
    P = pd.Series
    tp = P((h + l + c) / 3)
    mad = tp.rolling(14).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True)
    out = {"_cci": K.ratio((tp - tp.rolling(14).mean()).to_numpy(), (0.015 * mad).to_numpy())}
    mean, sd = P(c).rolling(20).mean(), P(c).rolling(20).std(ddof=0)
    base = {"atr_pct": K.ratio(s["_atr"], c), "atr": s["_atr"], "tr_pct": K.ratio(K.true_range(h, l, c), c), "hl_pct": K.ratio(h - l, c), "bbw": K.ratio((4 * sd).to_numpy(), mean.to_numpy()), "rsi14": s["_rsi_14"], "kal_step": np.abs(np.diff(s["_kal"], prepend=np.nan))}
    base |= {f"move{n}": np.abs(_change(c, n)) for n in (1, 3, 5, 10)}
    base |= {f"span{n}": K.ratio((P(h).rolling(n).max() - P(l).rolling(n).min()).to_numpy(), c) for n in (20, 50)}
    base |= {f"far{n}": K.ratio(np.abs(c - s[f"_ema_{n}"]), c) for n in FAR}
    base |= {f"sep{a}_{b}": K.ratio(np.abs(s[f"_ema_{a}"] - s[f"_ema_{b}"]), c) for a, b in PAIRS}
    out |= {f"_rank_{k}": P(base[x]).rolling(n).rank(pct=True).to_numpy() for k, (x, n) in RANKS.items()}
    out |= {f"_q_{k}": P(base[x]).rolling(n).quantile(p).to_numpy() for k, (x, n, p) in QUANTILES.items()}
    vc = _change(v, 12)
    out["_eff"] = np.nan_to_num(np.where(vc > 0, K.ratio(np.abs(_change(c, 12)), vc), 0.0))
    return out


def _threshold(bars: DataFrame, block: int) -> DataFrame:
    """symbol, tf, the 80th percentile of the efficiencies over 0 of the whole series (_eff_top), its number of bars (_n)."""
    rows = W.in_blocks(bars.select(*W.KEYS, "bar_seq", "close", "volume"), lambda df: df.withColumn("e", F.when(W.change("volume", 12) > 0, F.try_divide(F.abs(W.change("close", 12)), W.change("volume", 12)))), 12, block=block)
    top = exact_quantile(rows.where("e > 0").select(*W.KEYS, "e"), W.KEYS, "e", 0.8, "_eff_top")
    return bars.groupBy(*W.KEYS).agg(F.count("*").alias("_n")).join(top, W.KEYS, "left").withColumn("_eff_top", F.coalesce("_eff_top", F.lit(0.0)))


def _prices() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in ("close", "open", "high", "low", "volume"))


def _r(name: str) -> Column:
    return F.col(f"_{name}")


def _vs(a: Column, b: Column, a1: Column, b1: Column, up: str, down: str) -> dict[str, Column]:
    return {up: (a > b) & (a1 <= b1), down: (a < b) & (a1 >= b1)}


def _trend() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    out: dict[str, Column] = {}
    for a, b in PAIRS:
        x, y = _r(f"ema_{a}"), _r(f"ema_{b}")
        sep = F.try_divide(F.abs(x - y), C_)
        out |= {f"ema_trend_{a}_{b}_bullish": x > y, f"ema_trend_{a}_{b}_bearish": x < y, f"ema_strong_trend_{a}_{b}": sep > _r(f"q_sep{a}_{b}_70"), f"ema_weak_trend_{a}_{b}": sep < _r(f"q_sep{a}_{b}_30")}
        out |= _vs(x, y, W.lag(x), W.lag(y), f"ema_bullish_cross_{a}_{b}", f"ema_bearish_cross_{a}_{b}")
    for n in FAR:
        e = _r(f"ema_{n}")
        d = F.try_divide(F.abs(C_ - e), C_)
        out |= {f"price_above_ema_{n}": C_ > e, f"price_below_ema_{n}": C_ < e, f"price_far_from_ema_{n}": d > _r(f"q_far{n}_80"), f"price_near_ema_{n}": d < _r(f"q_far{n}_20")}
    a, p, m = _r("adx"), _r("pdi"), _r("mdi")
    out |= {"adx_strong_trend": a > 25, "adx_weak_trend": (a >= 20) & (a <= 25), "adx_no_trend": a < 20, "adx_very_strong_trend": a > 40, "adx_bullish_direction": p > m, "adx_bearish_direction": p < m}
    out |= _vs(p, m, W.lag(p), W.lag(m), "di_bullish_cross", "di_bearish_cross")
    e8, e21, e50 = _r("ema_8"), _r("ema_21"), _r("ema_50")
    up, down = W.flag((e8 > e21) & (e21 > e50)) == 1, W.flag((e8 < e21) & (e21 < e50)) == 1
    return out | {"ma_bullish_alignment": up, "ma_bearish_alignment": down, "ma_mixed_alignment": ~up & ~down, "trend_strength_weak": a < 25, "trend_strength_moderate": (a >= 25) & (a < 50), "trend_strength_strong": a >= 50}


def _levels(x: Column, prefix: str, low: float, high: float, lowest: float, highest: float) -> dict[str, Column]:
    return {f"{prefix}_oversold": x < low, f"{prefix}_overbought": x > high, f"{prefix}_extreme_oversold": x < lowest, f"{prefix}_extreme_overbought": x > highest}


def _momentum() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in (14, 21):
        r, name = _r(f"rsi_{n}"), f"rsi_{n}"
        d, r1 = W.diff(r), W.lag(r)
        d1 = r1 - W.lag(r, 2)
        out |= _levels(r, name, 30, 70, 20, 80) | {f"{name}_weak_bearish": (r >= 30) & (r < 40), f"{name}_neutral": (r >= 40) & (r <= 60), f"{name}_weak_bullish": (r > 60) & (r <= 70), f"{name}_rising": d > 0, f"{name}_falling": d < 0, f"{name}_accelerating_up": d > d1, f"{name}_accelerating_down": d < d1, f"{name}_reversal_from_oversold": (r > 30) & (r1 <= 30), f"{name}_reversal_from_overbought": (r < 70) & (r1 >= 70)}
    m, s = _r("macd"), _r("macd_sig")
    g, g1 = m - s, W.lag(m) - W.lag(s)
    out |= {"macd_bullish": m > s, "macd_bearish": m < s, "macd_histogram_positive": g > 0, "macd_histogram_negative": g < 0, "macd_histogram_increasing": g > g1, "macd_histogram_decreasing": g < g1, "macd_above_zero": m > 0, "macd_below_zero": m < 0}
    out |= _vs(m, s, W.lag(m), W.lag(s), "macd_bullish_cross", "macd_bearish_cross")
    k, d = _r("k"), _r("d")
    k1, d1 = W.lag(k), W.lag(d)
    out |= _levels(k, "stoch", 20, 80, 10, 90) | {"stoch_rising": k > k1, "stoch_falling": k < k1} | _vs(k, d, k1, d1, "stoch_bullish_cross", "stoch_bearish_cross")
    cci = _r("cci")
    out |= _levels(_r("wr"), "williams", -80, -20, -90, -10) | _levels(cci, "cci", -100, 100, -200, 200) | {"cci_neutral": (cci >= -100) & (cci <= 100)} | _levels(_r("mfi"), "mfi", 20, 80, 10, 90)
    r = _r("rsi_14")
    second = W.diff(r) - (W.lag(r) - W.lag(r, 2))
    return out | {"momentum_accelerating_up": second > 0, "momentum_accelerating_down": second < 0, "rsi_reversal_bullish": (r > 30) & (W.lag(r) <= 30) & (W.lag(r, 2) <= 30), "rsi_reversal_bearish": (r < 70) & (W.lag(r) >= 70) & (W.lag(r, 2) >= 70)}


def _volatility() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    a, t, mv, m1 = _r("rank_atr100"), _r("rank_tr50"), _r("rank_move50"), _r("c1")
    ups, downs = (F.sum(W.flag(x)).over(W.frame(5)) for x in (m1 > 0, m1 < 0))
    rel, slope = _r("atr_pct"), _r("slope")
    return {
        "volatility_low": a < 0.25, "volatility_normal": (a >= 0.25) & (a <= 0.75), "volatility_high": a > 0.75, "volatility_extreme": a > 0.9,
        "range_small": t < 0.33, "range_normal": (t >= 0.33) & (t <= 0.66), "range_large": t > 0.66, "range_extreme": t > 0.9,
        "movement_small": mv < 0.33, "movement_normal": (mv >= 0.33) & (mv <= 0.66), "movement_large": mv > 0.66,
        "consistent_upward_movement": (F.col("bar_seq") >= 4) & (ups >= 4), "consistent_downward_movement": (F.col("bar_seq") >= 4) & (downs >= 4),
        "volatility_regime_low": a < 0.33, "volatility_regime_medium": (a >= 0.33) & (a <= 0.66), "volatility_regime_high": a > 0.66, "volatility_regime_extreme": a > 0.9,
        "volatility_expanding": rel > W.rmean(rel, 20), "volatility_contracting": rel < W.rmean(rel, 20), "low_volatility_period": rel < W.rmean(rel, 50) * 0.5, "high_volatility_period": rel > W.rmean(rel, 50) * 1.5,
        "trend_slope_flat": F.abs(slope) < W.rstd(slope, 50) * 0.5, "trend_slope_moderate": (F.abs(slope) >= W.rstd(slope, 50) * 0.5) & (F.abs(slope) < W.rstd(slope, 50) * 1.5), "trend_slope_steep": F.abs(slope) >= W.rstd(slope, 50) * 1.5,
    }


def _volume() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    m, s, v1, c1 = _r("vm"), _r("vs"), _r("v1"), _r("c1")
    up, vup = W.flag(c1 > 0), W.flag(V_ > m)
    o = _r("obv")
    ups5 = [F.sum(W.flag(x > W.lag(x))).over(W.frame(5)) for x in (V_, C_)]
    sd = W.rstd(F.abs(c1), 20)
    spike = V_ > m + 2 * s
    v5, c5 = W.change("volume", 5), _r("c5")
    return {
        "volume_normal": V_ <= m + s, "volume_above_average": (V_ > m) & (V_ <= m + 2 * s), "volume_surge": spike, "volume_extreme_surge": V_ > m + 3 * s, "volume_low": V_ < m - s,
        "volume_increasing": v1 > 0, "volume_decreasing": v1 < 0, "volume_stable": F.abs(v1) < 0.1,
        "volume_price_confirmed_up": (up == 1) & (vup == 1), "volume_price_confirmed_down": (up == 0) & (vup == 1), "volume_price_unconfirmed": up != vup,
        "obv_rising": o > W.rmean(o, 20), "obv_falling": o < W.rmean(o, 20), "obv_momentum_up": W.diff(o) > 0, "obv_momentum_down": W.diff(o) < 0,
        "volume_spike_small_movement": spike & (F.abs(c1) < 0.5 * sd), "volume_spike_large_movement": spike & (F.abs(c1) > 1.5 * sd),
        "decreasing_volume_trend_continuation": (F.col("bar_seq") >= 4) & (ups5[0] <= 2) & (ups5[1] >= 4),
        "high_volume_efficiency": F.lit(False), "low_volume_efficiency": F.lit(False),
        "climax_volume_reversal": (W.lag("volume") > W.lag(m) + 3 * W.lag(s)) & (c1 * W.lag(c1) < 0),
        "stealth_accumulation": (F.abs(W.change("close", 10)) < 0.005) & (W.rmean("volume", 10) > m * 1.2), "volume_momentum_divergence": v5 * c5 < 0,
    }


def _ranges() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    out: dict[str, Column] = {}
    for n in (20, 50):
        hi, lo = _r(f"hh{n}"), _r(f"ll{n}")
        hi1, lo1, hi2, lo2 = W.lag(hi), W.lag(lo), W.lag(hi, 2), W.lag(lo, 2)
        span, span1 = hi - lo, hi1 - lo1
        at = F.try_divide(C_ - lo, span)
        c1 = W.lag("close")
        out |= {
            f"near_resistance_{n}": F.try_divide(hi - C_, C_) < 0.01, f"at_resistance_{n}": F.try_divide(hi - C_, C_) < 0.005, f"near_support_{n}": F.try_divide(C_ - lo, C_) < 0.01, f"at_support_{n}": F.try_divide(C_ - lo, C_) < 0.005,
            f"in_lower_range_{n}": at < 0.33, f"in_middle_range_{n}": (at >= 0.33) & (at <= 0.66), f"in_upper_range_{n}": at > 0.66,
            f"breakout_above_resistance_{n}": (C_ > hi) & (c1 <= hi1), f"breakdown_below_support_{n}": (C_ < lo) & (c1 >= lo1),
            **{f"near_fib_{k}_{n}": F.try_divide(F.abs(C_ - (hi - float(f"0.{k}") * span)), C_) < 0.005 for k in ("236", "382", "500", "618", "786")},
            f"in_fib_golden_zone_{n}": (C_ >= hi - 0.618 * span) & (C_ <= hi - 0.786 * span), f"above_fib_618_{n}": C_ > hi - 0.618 * span, f"below_fib_382_{n}": C_ < hi - 0.382 * span,
            f"structure_break_bullish_{n}": (C_ > hi1) & (c1 <= hi1), f"structure_break_bearish_{n}": (C_ < lo1) & (c1 >= lo1),
            f"failed_breakout_above_{n}": (H_ > hi1) & (C_ < hi1), f"failed_breakdown_below_{n}": (L_ < lo1) & (C_ > lo1),
            f"strong_breakout_above_{n}": C_ > hi1 + 0.1 * span1, f"strong_breakdown_below_{n}": C_ < lo1 - 0.1 * span1,
            f"weak_breakout_above_{n}": (C_ > hi1) & (C_ <= hi1 + 0.05 * span1), f"weak_breakdown_below_{n}": (C_ < lo1) & (C_ >= lo1 - 0.05 * span1),
            f"narrow_range_{n}": _r(f"rank_span{n}") < 0.25, f"wide_range_{n}": _r(f"rank_span{n}") > 0.75, f"normal_range_{n}": (_r(f"rank_span{n}") >= 0.25) & (_r(f"rank_span{n}") <= 0.75),
            f"in_consolidation_{n}": F.try_divide(F.abs(C_ - (hi + lo) / 2), span) < 0.25,
            f"bos_bullish_{n}": (C_ > hi1) & (c1 <= hi2), f"bos_bearish_{n}": (C_ < lo1) & (c1 >= lo2),
            f"strong_bos_bullish_{n}": (C_ > hi1 + 0.1 * span1) & (c1 <= hi2), f"strong_bos_bearish_{n}": (C_ < lo1 - 0.1 * span1) & (c1 >= lo2),
        }
    for n in (10, 20):
        hi1, lo1 = W.rmax("high", n, 1), W.rmin("low", n, 1)
        out |= {f"making_higher_high_{n}": H_ > hi1, f"making_lower_low_{n}": L_ < lo1, f"making_higher_low_{n}": (L_ > lo1) & (W.lag("low") == lo1), f"making_lower_high_{n}": (H_ < hi1) & (W.lag("high") == hi1)}
        rn, mn, cn = (W.lag(x, n) for x in (_r("rsi_14"), _r("macd"), C_))
        out |= {f"rsi_bullish_divergence_{n}": (C_ < cn) & (_r("rsi_14") > rn), f"rsi_bearish_divergence_{n}": (C_ > cn) & (_r("rsi_14") < rn), f"macd_bullish_divergence_{n}": (C_ < cn) & (_r("macd") > mn), f"macd_bearish_divergence_{n}": (C_ > cn) & (_r("macd") < mn)}
    for n in (20, 50, 100):
        hi, lo = _r(f"hh{n}"), _r(f"ll{n}")
        out |= {f"price_clustered_middle_{n}": F.abs(C_ - (hi + lo) / 2) < (hi - lo) * 0.2, f"range_bound_tight_{n}": F.try_divide(hi - lo, C_) < 0.02, f"oscillating_pattern_{n}": F.abs(C_ - W.lag("close", n // 4)) < (hi - lo) * 0.3}
    h = [H_, *[W.lag("high", k) for k in (1, 2, 3)]]
    low = [L_, *[W.lag("low", k) for k in (1, 2, 3)]]
    out |= {"local_high": (h[0] > h[1]) & (h[1] > h[2]), "local_low": (low[0] < low[1]) & (low[1] < low[2]), "local_high_confirmed": (h[1] > h[2]) & (h[1] > h[0]) & (h[1] > h[3]), "local_low_confirmed": (low[1] < low[2]) & (low[1] < low[0]) & (low[1] < low[3])}
    chop = F.when(_r("span14") > 0, 100 * F.log10(F.try_divide(W.rsum(_r("atr"), 14), F.nullif(_r("span14"), F.lit(0.0)))) / float(np.log10(14)))
    out |= {"market_choppy": chop > 61.8, "market_trending": chop < 38.2, "market_transitional": (chop >= 38.2) & (chop <= 61.8)}
    day_h, day_l, ses_h, ses_l = _r("day_h"), _r("day_l"), _r("ses_h"), _r("ses_l")
    at = F.try_divide(C_ - ses_l, ses_h - ses_l)
    return out | {
        "near_daily_high": F.try_divide(day_h - C_, C_) < 0.01, "near_daily_low": F.try_divide(C_ - day_l, C_) < 0.01, "at_daily_high": F.try_divide(day_h - C_, C_) < 0.002, "at_daily_low": F.try_divide(C_ - day_l, C_) < 0.002,
        "daily_high_sweep": (H_ > W.lag(day_h)) & (C_ < W.lag(day_h)), "daily_low_sweep": (L_ < W.lag(day_l)) & (C_ > W.lag(day_l)), "above_session_high": C_ > ses_h, "below_session_low": C_ < ses_l,
        "in_session_lower_third": at < 0.33, "in_session_upper_third": at > 0.67, "in_session_middle_third": (at >= 0.33) & (at <= 0.67),
    }


def _candles() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    rng = F.nullif(H_ - L_, F.lit(0.0))
    b, u, d = (x / rng for x in (F.abs(C_ - O_), H_ - F.greatest(O_, C_), F.least(O_, C_) - L_))
    o1, c1, h1, l1 = (W.lag(x) for x in ("open", "close", "high", "low"))
    bull, bear = C_ > O_, C_ < O_
    bull3, bear3 = (F.sum(W.flag(x)).over(W.frame(3)) for x in (bull, bear))
    bull4, bear4 = (F.sum(W.flag(x)).over(W.frame(4)) for x in (bull, bear))
    gap = F.try_divide(F.greatest(L_ - h1, l1 - H_), C_)
    rejected = 2 * F.abs(C_ - O_)
    h2, l2 = W.lag("high", 2), W.lag("low", 2)
    up_gap, down_gap = (L_ > h2) & (l1 > h2), (H_ < l2) & (h1 < l2)
    buy, sell = F.try_divide(C_ - L_, H_ - L_), F.try_divide(H_ - C_, H_ - L_)
    return {
        "small_body": b < 0.3, "medium_body": (b >= 0.3) & (b <= 0.7), "large_body": b > 0.7, "long_upper_shadow": u > 0.4, "long_lower_shadow": d > 0.4, "no_upper_shadow": u < 0.1, "no_lower_shadow": d < 0.1,
        "bullish_candle": bull, "bearish_candle": bear, "doji_candle": b < 0.1, "hammer_pattern": (b < 0.3) & (d > 0.6) & (u < 0.2), "inverted_hammer_pattern": (b < 0.3) & (u > 0.6) & (d < 0.2), "shooting_star_pattern": bear & (u > 0.6) & (d < 0.2),
        "bullish_marubozu": bull & (u < 0.05) & (d < 0.05), "bearish_marubozu": bear & (u < 0.05) & (d < 0.05), "spinning_top": (b < 0.3) & (u > 0.3) & (d > 0.3),
        "bullish_engulfing": bull & (c1 < o1) & (O_ < c1) & (C_ > o1), "bearish_engulfing": bear & (c1 > o1) & (O_ > c1) & (C_ < o1), "inside_bar": (H_ <= h1) & (L_ >= l1), "outside_bar": (H_ >= h1) & (L_ <= l1),
        "consecutive_bullish_2": bull & (c1 > o1), "consecutive_bearish_2": bear & (c1 < o1), "consecutive_bullish_3": bull3 == 3, "consecutive_bearish_3": bear3 == 3,
        "large_candle_range": _r("rank_range100") > 0.8, "extreme_candle_range": _r("rank_range100") > 0.95, "efficient_candle": b > 0.7, "inefficient_candle": b < 0.3, "wick_dominated_candle": u + d > 0.6,
        "gap_up": L_ > h1, "gap_down": H_ < l1, "no_gap": (L_ <= h1) & (H_ >= l1), "small_gap": (gap > 0) & (gap < 0.005), "medium_gap": (gap >= 0.005) & (gap < 0.01), "large_gap": gap >= 0.01,
        "upper_wick_rejection": (H_ - F.greatest(O_, C_) > rejected) & bear, "lower_wick_rejection": (F.least(O_, C_) - L_ > rejected) & bull,
        "bullish_fvg_present": up_gap, "bearish_fvg_present": down_gap, "large_bullish_fvg": up_gap & (F.try_divide(L_ - h2, C_) > 0.005), "large_bearish_fvg": down_gap & (F.try_divide(l2 - H_, C_) > 0.005),
        "buying_pressure_dominant": buy > 0.7, "selling_pressure_dominant": sell > 0.7, "balanced_pressure": (buy > 0.3) & (buy < 0.7), "strong_bull_sequence": (F.col("bar_seq") >= 3) & (bull4 >= 3), "strong_bear_sequence": (F.col("bar_seq") >= 3) & (bear4 >= 3),
    }


def _bands() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    u, m, d, w = _r("bbu"), _r("bbm"), _r("bbd"), _r("rank_bbw50")
    c1, pct = W.lag("close"), F.try_divide(C_ - _r("bbd"), _r("bbu") - _r("bbd"))
    z = _r("z50")
    rsi = _r("rsi_14")
    return {
        "above_bb_upper": C_ > u, "below_bb_lower": C_ < d, "between_bb_bands": (C_ <= u) & (C_ >= d), "above_bb_middle": C_ > m, "below_bb_middle": C_ < m, "bb_squeeze": w < 0.2, "bb_expansion": w > 0.8, "bb_normal_width": (w >= 0.2) & (w <= 0.8),
        "touching_bb_upper": H_ >= u * 0.999, "touching_bb_lower": L_ <= d * 1.001, "bb_reversal_from_upper": (C_ < u) & (c1 >= u), "bb_reversal_from_lower": (C_ > d) & (c1 <= d),
        "bb_percent_oversold": pct < 0.2, "bb_percent_overbought": pct > 0.8, "bb_percent_neutral": (pct >= 0.4) & (pct <= 0.6),
        "price_3std_above_mean": z > 3, "price_3std_below_mean": z < -3, "price_2std_extreme": F.abs(z) > 2,
        "rsi_extreme_historical_context": ((rsi < 20) & (_r("rank_rsi200") < 0.1)) | ((rsi > 80) & (_r("rank_rsi200") > 0.9)), "price_stretch_from_ema": _r("rank_ema21_100") > 0.95,
        "bb_squeeze_expansion_potential": (F.col("bar_seq") >= 9) & (F.sum(W.flag(_r("rank_bbw100") < 0.2)).over(W.frame(10)) >= 8), "volatility_compression_extreme": (F.col("bar_seq") >= 14) & (F.sum(W.flag(_r("rank_atr_own100") < 0.1)).over(W.frame(15)) >= 12),
    }


def _time() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    hour, day = F.hour("ts"), F.weekday("ts")
    asia, london = (hour >= 23) | (hour < 8), (hour >= 8) & (hour < 16)
    out = {"asian_session": asia, "london_session": london, "us_session": (hour >= 13) & (hour < 21), "overlap_session": (hour >= 13) & (hour < 16), "high_liquidity_time": london, "low_liquidity_time": asia}
    out |= {n: day == i for i, n in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday"))}
    busy = V_ > W.rmean("volume", 72) * 1.5
    m12, start = _r("c12"), (hour == 8) | (hour == 13)
    return out | {
        "london_open_volume_surge": (hour >= 8) & (hour < 10) & busy, "ny_open_volume_surge": (hour >= 13) & (hour < 15) & busy, "session_transition_momentum_shift": start & (F.abs(m12 - W.lag(m12, 12)) > 0.005),
        "london_open_significant_gap": (hour == 8) & (F.try_divide(F.abs(O_ - W.lag("close")), _r("atr")) > 0.5), "ny_open_volatility_spike": (hour >= 13) & (hour < 15) & (_r("atr") > W.rmean(_r("atr"), 48) * 1.5), "session_start_high_efficiency": start & (_r("eff") > _r("eff_top")),
    }


def _moves() -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    out: dict[str, Column] = {}
    for n in (3, 5, 10):
        c = _r(f"c{n}")
        out |= {f"strong_momentum_{n}": F.abs(c) > _r(f"q_move{n}_75"), f"weak_momentum_{n}": F.abs(c) < _r(f"q_move{n}_25"), f"positive_momentum_{n}": c > 0, f"negative_momentum_{n}": c < 0}
    for n in (60, 120, 240):
        c = _r(f"c{n}")
        quick, slow = W.rmean("close", n // 4), W.rmean("close", n)
        out |= {f"htf_trend_bullish_{n}": quick > slow, f"htf_trend_bearish_{n}": quick < slow, f"htf_momentum_positive_{n}": c > 0, f"htf_momentum_negative_{n}": c < 0, f"htf_momentum_strong_{n}": F.abs(c) > W.rstd(c, n)}
    c1, c2, c3, c5, c20 = (_r(f"c{n}") for n in (1, 2, 3, 5, 20))
    imp = _r("q_impulse")
    level = 50 * F.greatest(F.lit(36), F.least(F.lit(100), F.round(C_ / 50)))
    near = F.try_divide(F.abs(C_ - level), C_)
    up, down = C_ > W.lag("close"), C_ < W.lag("close")
    surge = V_ > W.rmean("volume", 20) * 1.5
    kal = W.diff(_r("kal"))
    kal1 = W.lag(_r("kal")) - W.lag(_r("kal"), 2)
    dis = _r("q_displace")
    return out | {
        "near_round_number": near < 0.005, "at_round_number": near < 0.001, "near_psychological_half": F.try_divide(F.abs(F.pmod(C_, F.lit(50.0)) - 25), C_) < 0.002, "near_psychological_quarter": F.try_divide(F.abs(F.pmod(C_, F.lit(25.0)) - 12.5), C_) < 0.001,
        "v_bottom_pattern": (c2 < -0.01) & (c1 > 0.01), "v_top_pattern": (c2 > 0.01) & (c1 < -0.01),
        "impulse_wave_up": c5 > imp, "impulse_wave_down": c5 < -imp, "correction_wave_up": (c5 > 0) & (c20 < 0) & (F.abs(c5) < imp), "correction_wave_down": (c5 < 0) & (c20 > 0) & (F.abs(c5) < imp),
        "three_wave_up": F.sum(W.flag(up)).over(W.frame(3)) == 3, "three_wave_down": F.sum(W.flag(down)).over(W.frame(3)) == 3,
        "choch_bullish": (c5 > 0.01) & (c20 < -0.01) & (W.lag(c5) <= 0), "choch_bearish": (c5 < -0.01) & (c20 > 0.01) & (W.lag(c5) >= 0),
        "bullish_displacement": (c3 > dis) & surge, "bearish_displacement": (c3 < -dis) & surge,
        "kalman_trend_bullish": kal > 0, "kalman_trend_bearish": kal < 0, "kalman_trend_strong": _r("rank_kal50") > 0.8, "trend_regime_change_signal": (((kal > 0) & (kal1 <= 0)) | ((kal < 0) & (kal1 >= 0))) & (V_ > _r("vm")),
    }


def _sessions(tf: str) -> dict[str, Column]:
    """Extremes of the day before; its length in bars comes from the timeframe's name, as those of sessions do."""
    n = _per_hour(tf) * 24
    w = W.frame(n, n)
    return {"_day1_h": F.max("high").over(w), "_day1_l": F.min("low").over(w)}


def _breaches(tf: str) -> dict[str, Column]:
    C_, O_, H_, L_, V_ = _prices()
    per_hour = _per_hour(tf)
    hour = F.hour("ts")

    def before(side: str) -> Column:
        a, lo, ny = (W.lag(F.col(f"_f_{n}_{side}"), per_hour * k) for n, k in (("asia", 9), ("london", 8), ("ny", 8)))
        return F.when((hour >= 8) & (hour < 16), a).when((hour >= 13) & (hour < 21), lo).otherwise(ny)

    return {"above_prev_session_high": F.try_divide(C_ - before("h"), C_) > 0.002, "below_prev_session_low": F.try_divide(before("l") - C_, C_) > 0.002, "above_prev_day_high": F.try_divide(C_ - F.col("_day1_h"), C_) > 0.002, "below_prev_day_low": F.try_divide(F.col("_day1_l") - C_, C_) > 0.002}


def _counts() -> dict[str, Column]:
    """Flags of flags, first part."""
    C_, O_, H_, L_, V_ = _prices()
    f = F.col
    votes = {s: f(f"rsi_14_{a}") + f(f"macd_{b}") + f(f"stoch_{a}") for s, a, b in (("bull", "rising", "bullish"), ("bear", "falling", "bearish"))}

    def seen(name: str | Column, n: int, offset: int = 0) -> Column:
        x = f(name) if isinstance(name, str) else name
        return F.when(F.col("bar_seq") >= n - 1 + offset, F.sum(x).over(W.frame(n, offset)))

    big_bull, big_bear = f("large_candle_range") * f("bullish_candle"), f("large_candle_range") * f("bearish_candle")
    up, down, small = C_ > W.lag("close"), C_ < W.lag("close"), F.abs(_r("c1")) < 0.01
    tight3 = F.abs(_r("c3")) < 0.005
    vm50 = W.rmean("volume", 50)
    buy = F.try_divide(C_ - L_, H_ - L_)
    sell = F.try_divide(H_ - C_, H_ - L_)
    calm = F.abs(_r("c1")) < _r("q_absorb")
    trends = {s: [f(f"_htf_{t}_trend_{s}") for t in ("1h", "4h", "1d")] for s in ("bullish", "bearish")}
    there = [f("_htf_1h"), f("_htf_4h"), f("_htf_1d")]
    own = {s: [f(f"htf_trend_{s}_{n}") for n in (60, 120, 240)] for s in ("bullish", "bearish")}
    n_bars = F.col("_n")
    has = [*[W.flag(n_bars >= n) for n in (60, 120, 240)], *there]

    def all_of(side: str) -> Column:
        some = sum(has, F.lit(0.0))
        ok = F.lit(True)
        for there_, x in zip(has, [*own[side], *trends[side]], strict=True):
            ok = ok & ((there_ == 0) | (x == 1))
        return W.flag((some >= 2) & ok)

    # The first four longer trends that exist, weighted.
    lists = F.filter(F.array(*[F.struct(a.cast("double").alias("on"), x.cast("double").alias("v")) for a, x in zip(has, [*own["bullish"], *trends["bullish"]], strict=True)]), lambda s: s["on"] == 1)
    weights = F.array(*[F.lit(w) for w in (0.3, 0.5, 0.7, 1.0)])
    k = F.least(F.size(lists), F.lit(4))
    top = F.aggregate(F.zip_with(F.slice(lists, 1, 4), weights, lambda s, w: F.coalesce(s["v"] * w, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    score = F.when(k >= 2, top / F.aggregate(F.slice(weights, F.lit(1), k), F.lit(0.0), lambda a, b: a + b))
    return {
        "momentum_strong_bullish": W.flag(votes["bull"] >= 2), "momentum_strong_bearish": W.flag(votes["bear"] >= 2), "momentum_mixed": W.flag((votes["bull"] > 0) & (votes["bear"] > 0)),
        "momentum_regime_bullish": W.flag(votes["bull"] >= 2.25), "momentum_regime_bearish": W.flag(votes["bull"] <= 0.75), "momentum_regime_neutral": W.flag((votes["bull"] > 0.75) & (votes["bull"] < 2.25)),
        "volume_confirmed_breakout_above": f("strong_breakout_above_20") * f("volume_surge"), "volume_confirmed_breakdown_below": f("strong_breakdown_below_20") * f("volume_surge"),
        "five_wave_up": W.flag(f("_n3_up") + W.lag("_n3_up") >= 4), "five_wave_down": W.flag(f("_n3_dn") + W.lag("_n3_dn") >= 4),
        "in_bullish_fvg_zone": W.flag((L_ <= W.lag("high", 2)) & (H_ >= W.lag("low", 2)) & (W.lag("bullish_fvg_present") == 1)),
        "increasing_buying_pressure": W.flag(buy > W.rmean(buy, 10)), "increasing_selling_pressure": W.flag(sell > W.rmean(sell, 10)), "bullish_absorption": W.flag((f("volume_surge") == 1) & calm & (buy > 0.7)), "bearish_absorption": W.flag((f("volume_surge") == 1) & calm & (sell > 0.7)),
        "sideways_with_momentum_buildup": W.flag((f("price_clustered_middle_20") == 1) & ((F.abs(_r("rsi_14") - 50) > 15) | (F.abs(_r("macd")) > W.rmean(_r("macd"), 20)))),
        **{f"false_breakout_zone_{n}": W.flag(seen(f"failed_breakout_above_{n}", n) + seen(f"failed_breakdown_below_{n}", n) >= 2) for n in (20, 50)},
        "low_volume_sideways": W.flag((V_ < vm50 * 0.7) & (f("range_bound_tight_20") == 1)), "volume_at_resistance": W.flag((f("near_resistance_20") == 1) & (V_ > vm50 * 1.5)), "volume_at_support": W.flag((f("near_support_20") == 1) & (V_ > vm50 * 1.5)),
        "shallow_bull_retracement": W.flag(down & (seen("bullish_displacement", 5, 1) > 0) & tight3), "shallow_bear_retracement": W.flag(up & (seen("bearish_displacement", 5, 1) > 0) & tight3),
        "healthy_retracement_after_bull_candle": W.flag(down & (seen(big_bull, 3, 1) > 0) & small), "healthy_retracement_after_bear_candle": W.flag(up & (seen(big_bear, 3, 1) > 0) & small),
        "momentum_continuation_bull": W.flag((W.lag(big_bull) == 1) & up), "momentum_continuation_bear": W.flag((W.lag(big_bear) == 1) & down),
        "exhaustion_volume_pattern": f("volume_surge") * f("small_body"), "mean_reversion_probability_high": W.flag(f("price_2std_extreme") + f("rsi_extreme_historical_context") + f("price_stretch_from_ema") >= 2),
        "support_resistance_magnetic_effect": W.flag(seen(F.greatest("near_support_20", "near_resistance_20"), 3) >= 2),
        "mtf_all_bullish": all_of("bullish"), "mtf_all_bearish": all_of("bearish"), "multi_timeframe_trend_alignment_strong": W.flag(score > 0.75), "multi_timeframe_trend_alignment_weak": W.flag(score < 0.25),
        "volatility_regime_consistent_high": W.flag(seen("volatility_regime_high", 10) >= 7), "volatility_regime_consistent_low": W.flag(seen("volatility_regime_low", 10) >= 7),
        **{x: f(f"_{x}").cast("int") for x in HTF_FLAGS},
    }


FAMILIES: dict[str, Callable[[], dict[str, Column]]] = {"trend": _trend, "momentum": _momentum, "volatility": _volatility, "volume": _volume, "ranges": _ranges, "candles": _candles, "bands": _bands, "time": _time, "moves": _moves}


def remembered(bars: DataFrame, tf: str, block: int = S.BLOCK) -> DataFrame:
    """Bars with all columns whose memory has no bound (their names begin with an underscore): averages and levels by a
    scan of two stages, sessions' extremes, longer timeframes, the threshold of the whole series."""
    df = longer_flags(bars, block)
    rows = df.withColumn("__hour", F.hour("ts"))
    sides = [f"_f_{n}_{x}" for n in SESSIONS for x in "hl"]
    (recur, finish), (more, ends) = (_averages, _averaged), _extremes(tf)

    def both(s: dict, own: int, made: dict) -> dict[str, S.Recurrence]:
        return recur(s, own, made) | more(s, own, made)

    def made_of(s: dict, own: int, got: dict, made: dict) -> dict:
        return finish(s, own, got, made) | ends(s, own, {k: v for k, v in got.items() if f"_f_{k}" in sides}, made)

    halo = max(S.HALO, 9 * _per_hour(tf))
    df = S.scan(rows, [(both, made_of), (_signals, _signalled)], [*MEMORY, *sides], max(block, halo), halo).drop("__hour")
    # Written once: what follows reads each bar twice, and its plan is long enough without this one's.
    return cut(df.join(_threshold(bars, block), W.KEYS))


def base(df: DataFrame) -> DataFrame:
    """Those bars (or a run of them) with the columns that flags compare."""
    C_, O_, H_, L_, V_ = _prices()
    df = per_series(df, _windowed, FRAMED)
    tp = (H_ + L_ + C_) / 3
    df = df.withColumns({
        **{f"_c{n}": W.change("close", n) for n in (1, 2, 3, 5, 10, 12, 20, 60, 120, 240)}, "_v1": W.change("volume", 1), "_vm": W.rmean("volume", 20), "_vs": W.rstd("volume", 20),
        **{f"_hh{n}": W.rmax("high", n) for n in (20, 50, 100)}, **{f"_ll{n}": W.rmin("low", n) for n in (20, 50, 100)}, "_span14": W.rmax("high", 14) - W.rmin("low", 14),
        "_day_h": W.rmax("high", 288), "_day_l": W.rmin("low", 288), "_ses_h": W.rmax("high", 72), "_ses_l": W.rmin("low", 72),
        "_bbm": W.rmean("close", 20), "_bbsd": W.rstd_pop("close", 20), "_z50": F.try_divide(C_ - W.rmean("close", 50), W.rstd("close", 50)),
        "_raw_k": F.try_divide(100 * (C_ - W.rmin("low", 14)), W.rmax("high", 14) - W.rmin("low", 14)), "_wr": F.try_divide(-100 * (W.rmax("high", 14) - C_), W.rmax("high", 14) - W.rmin("low", 14)),
        "_atr_pct": F.try_divide(_r("atr"), C_), "_slope": F.try_divide(W.diff(_r("ema_21")), C_), "_tr": true_range(), "_flow": tp * V_, "_tp_d": W.diff(tp),
        "_up1": W.flag(C_ > W.lag("close")), "_dn1": W.flag(C_ < W.lag("close")),
    })
    pos, neg = (F.sum(F.when(c, F.col("_flow")).otherwise(0.0)).over(W.frame(14)) for c in (F.col("_tp_d") > 0, F.col("_tp_d") < 0))
    df = df.withColumns({
        "_bbu": _r("bbm") + 2 * _r("bbsd"), "_bbd": _r("bbm") - 2 * _r("bbsd"), "_k": W.rmean(_r("raw_k"), 3), 
        "_mfi": F.when(F.col("bar_seq") >= 14, 100 * F.try_divide(pos, pos + neg)), "_n3_up": W.rsum("_up1", 3), "_n3_dn": W.rsum("_dn1", 3),
    })
    return df.withColumns({"_d": W.rmean(_r("k"), 3)})


#: Bars that flags look back on, but for days (48 hours): rolling ranks of 200 bars of averages, and counts of flags of them.
BACK = 1_000


def flag_features(bars: DataFrame, tf: str = "5m", families: list[str] | None = None, block: int = S.BLOCK) -> DataFrame:
    """symbol, tf, ts, bar_seq and the flags, all of them or those of some families (then without flags of flags). No task
    holds more than a block of a series and the bars before it that the block looks back on."""
    chosen = families or list(FAMILIES)
    names: list[str] = []

    def of(df: DataFrame) -> DataFrame:
        df = base(df)
        flags = {k: v for name in chosen for k, v in FAMILIES[name]().items()}
        df = df.select("*", *[W.flag(v).alias(k) for k, v in flags.items()])
        keep = list(flags)
        if not families:
            df = df.withColumns(_sessions(tf))
            more = {k: W.flag(v) for k, v in _breaches(tf).items()} | _counts()
            df = df.select("*", *[v.alias(k) for k, v in more.items()])
            last = {"mtf_mixed_signals": F.bitwise_not(F.col("mtf_all_bullish")).bitwiseAND(F.bitwise_not(F.col("mtf_all_bearish"))), **{f"momentum_regime_persistent_{s}": W.flag(F.when(F.col("bar_seq") >= 19, F.sum(f"momentum_regime_{x}").over(W.frame(20))) >= 15) for s, x in (("bull", "bullish"), ("bear", "bearish"))}}
            df = df.select("*", *[v.alias(k) for k, v in last.items()])
            keep += [*more, *last]
        names.extend(keep)
        return df.select("symbol", "tf", "ts", "bar_seq", *keep)

    back = BACK + 48 * _per_hour(tf)
    return W.in_blocks(remembered(bars, tf, block), of, back, block=max(block, back)).select("symbol", "tf", "ts", "bar_seq", *names)


def indicator_groups(names: list[str]) -> dict[str, list[str]]:
    """Flag names by subject, from their spelling."""
    rules = {"Momentum": ("rsi", "macd", "stoch", "williams", "cci", "mfi", "momentum"), "Trend": ("ema", "adx", "di_", "trend", "kalman", "ma_"), "Volatility": ("volatility", "bb_", "atr", "range_"), "Volume": ("volume", "obv", "absorption"), "Structure": ("bos", "choch", "fvg", "breakout", "breakdown", "resistance", "support", "fib", "local", "higher", "lower"), "Sessions": ("session", "london", "ny_", "asian", "day", "daily"), "Candles": ("candle", "body", "shadow", "hammer", "doji", "engulf", "wick", "bar", "gap")}
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(next((g for g, keys in rules.items() if any(k in n for k in keys)), "Other"), []).append(n)
    return out
