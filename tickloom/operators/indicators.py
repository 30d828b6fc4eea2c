"""The indicator library: ``compute(name, bars, **params)``.

Indicators without memory are window expressions. Those with a recurrence share
one grouped map over each series (``recursive``), which any number of them can
fill in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import kernels as K
from tickloom.functions import windows as W

Series = dict[str, np.ndarray]


def true_range() -> Column:
    """greatest() passes over nulls, so the first row has high - low."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - W.lag("close")), F.abs(F.col("low") - W.lag("close")))


def sma(period: int = 20, source: str = "close") -> dict[str, Column]:
    return {"sma": W.rmean(source, period)}


def wma(period: int = 20, source: str = "close") -> dict[str, Column]:
    return {"wma": W.weighted_mean(source, period)}


def stochastic(k: int = 14, d: int = 3) -> dict[str, Column]:
    low = W.rmin("low", k)
    return {"stoch_k": F.try_divide(100 * (F.col("close") - low), W.rmax("high", k) - low)}


def roc(period: int = 12, source: str = "close") -> dict[str, Column]:
    return {"roc": W.change(source, period) * 100}


def bollinger_bands(period: int = 20, std_dev: float = 2.0, source: str = "close") -> dict[str, Column]:
    mid, sd = W.rmean(source, period), W.rstd(source, period)
    return {"bb_middle": mid, "bb_upper": mid + std_dev * sd, "bb_lower": mid - std_dev * sd, "bb_width": F.try_divide(2 * std_dev * sd, mid)}


def vwap() -> dict[str, Column]:
    day = Window.partitionBy(*W.KEYS, F.to_date("ts")).orderBy("bar_seq").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return {"vwap": F.try_divide(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day))}


def obv_step() -> Column:
    d = W.diff("close")
    return F.coalesce(F.when(d > 0, F.col("volume")).when(d < 0, -F.col("volume")), F.lit(0.0))


# --- with memory ------------------------------------------------------------------------------------------------------


def _ema(s: Series, period: int = 20, source: str = "close") -> Series:
    return {"ema": K.ewma(s[source], 2 / (period + 1))}


def _rsi(s: Series, period: int = 14, source: str = "close") -> Series:
    d = np.diff(s[source], prepend=np.nan)
    up, down = np.where(np.isnan(d), np.nan, np.maximum(d, 0)), np.where(np.isnan(d), np.nan, np.maximum(-d, 0))
    rs = K.ratio(K.ewma(up, 1 / period), K.ewma(down, 1 / period))
    return {"rsi": 100 - 100 / (1 + rs)}


def _macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9, source: str = "close") -> Series:
    line = K.ewma(s[source], 2 / (fast + 1)) - K.ewma(s[source], 2 / (slow + 1))
    sig = K.ewma(line, 2 / (signal + 1))
    return {"macd": line, "macd_signal": sig, "macd_hist": line - sig}


def _atr(s: Series, period: int = 14) -> Series:
    return {"atr": K.ewma(K.true_range(s["high"], s["low"], s["close"]), 1 / period)}


def _keltner(s: Series, period: int = 20, multiplier: float = 2.0) -> Series:
    mid, a = K.ewma(s["close"], 2 / (period + 1)), _atr(s, period)["atr"]
    return {"kc_middle": mid, "kc_upper": mid + multiplier * a, "kc_lower": mid - multiplier * a}


def _adx(s: Series, period: int = 14) -> Series:
    a = _atr(s, period)["atr"]
    plus, minus = (100 * K.ratio(K.ewma(m, 1 / period), a) for m in K.directional(s["high"], s["low"]))
    dx = 100 * K.ratio(np.abs(plus - minus), plus + minus)
    return {"adx": K.ewma(dx, 1 / period), "plus_di": plus, "minus_di": minus}


def _supertrend(s: Series, period: int = 10, multiplier: float = 3.0) -> Series:
    v, d = K.supertrend(s["high"], s["low"], s["close"], _atr(s, period)["atr"], multiplier)
    return {"supertrend": v, "supertrend_dir": d.astype(float)}


def _heikin_ashi(s: Series) -> Series:
    close = (s["open"] + s["high"] + s["low"] + s["close"]) / 4
    open_ = K.heikin_open(s["open"], close, s["close"][0]) if len(close) else close
    return {"ha_open": open_, "ha_high": np.maximum(s["high"], np.maximum(open_, close)), "ha_low": np.minimum(s["low"], np.minimum(open_, close)), "ha_close": close}


#: name -> (function, columns, parameters' defaults, shape)
WINDOWED: dict[str, tuple[Callable, tuple[str, ...], dict, str]] = {
    "sma": (sma, ("sma",), {"period": 20, "source": "close"}, "series"),
    "wma": (wma, ("wma",), {"period": 20, "source": "close"}, "series"),
    "stochastic": (stochastic, ("stoch_k", "stoch_d"), {"k": 14, "d": 3}, "frame"),
    "roc": (roc, ("roc",), {"period": 12, "source": "close"}, "series"),
    "bollinger_bands": (bollinger_bands, ("bb_middle", "bb_upper", "bb_lower", "bb_width"), {"period": 20, "std_dev": 2.0, "source": "close"}, "frame"),
    "vwap": (vwap, ("vwap",), {}, "series"),
    "obv": (obv_step, ("obv",), {}, "series"),
}
RECURSIVE: dict[str, tuple[Callable, tuple[str, ...], dict, str]] = {
    "ema": (_ema, ("ema",), {"period": 20, "source": "close"}, "series"),
    "supertrend": (_supertrend, ("supertrend", "supertrend_dir"), {"period": 10, "multiplier": 3.0}, "frame"),
    "adx": (_adx, ("adx", "plus_di", "minus_di"), {"period": 14}, "frame"),
    "rsi": (_rsi, ("rsi",), {"period": 14, "source": "close"}, "series"),
    "macd": (_macd, ("macd", "macd_signal", "macd_hist"), {"fast": 12, "slow": 26, "signal": 9, "source": "close"}, "frame"),
    "atr": (_atr, ("atr",), {"period": 14}, "series"),
    "keltner_channel": (_keltner, ("kc_middle", "kc_upper", "kc_lower"), {"period": 20, "multiplier": 2.0}, "frame"),
}


def per_series(bars: DataFrame, make: Callable[[Series], Series], columns: list[str], keys: list[str] = W.KEYS) -> DataFrame:
    """Add columns that a function of the whole, ordered series gives: one shuffle, one pass for any number of them.
    The function gets every numeric column as floats, null as NaN; NaN comes back as null."""
    numeric = [f.name for f in bars.schema if isinstance(f.dataType, T.NumericType)]
    schema = T.StructType([*bars.schema, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable").reset_index(drop=True)
        s = {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in numeric} | {"ts": pdf["ts"].to_numpy() if "ts" in pdf else np.zeros(0)}
        made = make(s)
        return pd.concat([pdf, pd.DataFrame({c: np.asarray(made[c], float) for c in columns})], axis=1)[schema.names]

    return bars.groupBy(*keys).applyInPandas(run, schema)


def recursive(bars: DataFrame, wanted: dict[str, tuple[str, dict]]) -> DataFrame:
    """wanted: prefix -> (indicator, parameters); an empty prefix keeps the indicator's own column names, another one is
    joined to them by an underscore (or replaces the name of a single column)."""
    names = {}
    for prefix, (name, _) in wanted.items():
        cols = RECURSIVE[name][1]
        names[prefix] = [c if prefix.startswith("=") else prefix if len(cols) == 1 else f"{prefix}_{c}" for c in cols]

    def make(s: Series) -> Series:
        out = {}
        for prefix, (name, params) in wanted.items():
            f, cols, defaults, _ = RECURSIVE[name]
            got = f(s, **(defaults | params))
            out |= {new: got[c] for new, c in zip(names[prefix], cols, strict=True)}
        return out

    return per_series(bars, make, [c for ns in names.values() for c in ns])


def compute(name: str, bars: DataFrame, **params) -> DataFrame:
    """Bars with the indicator's columns. Unknown names and parameters raise."""
    if name in RECURSIVE:
        defaults = RECURSIVE[name][2]
        if bad := set(params) - set(defaults):
            raise ValueError(f"{name} has no parameters {sorted(bad)}")
        return recursive(bars, {"=": (name, params)})
    if name not in WINDOWED:
        raise KeyError(f"unknown indicator {name!r}; known: {sorted([*WINDOWED, *RECURSIVE])}")
    f, _, defaults, _ = WINDOWED[name]
    p = defaults | params
    if set(p) != set(defaults):
        raise ValueError(f"{name} has no parameters {sorted(set(p) - set(defaults))}")
    if name == "obv":
        return bars.withColumn("obv", obv_step()).withColumn("obv", F.sum("obv").over(W.running()))
    out = bars.withColumns(f(**p))
    return out.withColumn("stoch_d", W.rmean("stoch_k", p["d"])) if name == "stochastic" else out


def catalog() -> Iterator[dict]:
    """What is known of each indicator, without the functions."""
    for name, (_, cols, defaults, shape) in sorted((WINDOWED | RECURSIVE).items()):
        yield {"name": name, "columns": list(cols), "defaults": defaults, "returns": shape}
