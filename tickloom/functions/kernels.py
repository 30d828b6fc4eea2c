"""Recurrences over one series, in numpy. Nulls are NaN."""

from __future__ import annotations

import numpy as np


def ewma(x: np.ndarray, alpha: float) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y from the first value on. A gap of g nulls lets the old weight decay by g more
    steps, and the weights are brought to 1 again; y stays over the gap."""
    out = np.full(len(x), np.nan)
    y, keep = np.nan, 1.0
    for i, v in enumerate(x):
        if np.isnan(v):
            keep *= 1 - alpha
        elif np.isnan(y):
            y, keep = v, 1.0
        else:
            old = keep * (1 - alpha)
            y = (old * y + alpha * v) / (old + alpha)
            keep = 1.0
        out[i] = y
    return out


def ewma_adjusted(x: np.ndarray, span: int) -> np.ndarray:
    """Mean with weights (1 - alpha)^age over all values so far."""
    a = 2 / (span + 1)
    out = np.full(len(x), np.nan)
    num = den = 0.0
    for i, v in enumerate(x):
        num *= 1 - a
        den *= 1 - a
        if not np.isnan(v):
            num += v
            den += 1
        out[i] = num / den if den else np.nan
    return out


def seeded_ema(x: np.ndarray, n: int) -> np.ndarray:
    """EMA that begins with the mean of the first n values."""
    return _seeded(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average, seeded by the mean of the first n values."""
    return _seeded(x, n, 1 / n)


def _seeded(x: np.ndarray, n: int, a: float) -> np.ndarray:
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) < n:
        return out
    start = ok[0]
    if start + n > len(x):
        return out
    y = x[start : start + n].mean()
    out[start + n - 1] = y
    for i in range(start + n, len(x)):
        y += a * (x[i] - y)
        out[i] = y
    return out


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum: the first n - 1 values added up, then s - s / n + x."""
    out = np.full(len(x), np.nan)
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) < n:
        return out
    at = ok[0] + n - 1
    s = x[ok[0] : at].sum()
    for i in range(at, len(x)):
        s = s - s / n + x[i]
        out[i] = s
    return out


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Value (null in row 0) and direction. A final band moves only to tighten, or after a close beyond it."""
    n = len(close)
    mid = (high + low) / 2
    up, dn = mid + m * atr, mid - m * atr
    value, direction = np.full(n, np.nan), np.ones(n, np.int64)
    fu, fl, d = (up[0], dn[0], 1) if n else (0.0, 0.0, 1)
    for i in range(1, n):
        pu, pl = fu, fl
        fu = up[i] if up[i] < pu or close[i - 1] > pu else pu
        fl = dn[i] if dn[i] > pl or close[i - 1] < pl else pl
        d = 1 if close[i] > pu else -1 if close[i] < pl else d
        direction[i] = d
        value[i] = fl if d == 1 else fu
    return value, direction


def heikin_open(open_: np.ndarray, ha_close: np.ndarray, first_close: float) -> np.ndarray:
    out = np.empty(len(open_))
    for i in range(len(open_)):
        out[i] = (open_[0] + first_close) / 2 if i == 0 else (out[i - 1] + ha_close[i - 1]) / 2
    return out


def kalman(x: np.ndarray, q: float = 0.01, r: float = 1.0) -> np.ndarray:
    """A level with steps of variance q, seen with variance r; starts at the first value with variance 1."""
    out = np.full(len(x), np.nan)
    if not len(x):
        return out
    level, var = x[0], 1.0
    out[0] = level
    for i in range(1, len(x)):
        var += q
        gain = var / (var + r)
        if not np.isnan(x[i]):
            level += gain * (x[i] - level)
            var *= 1 - gain
        out[i] = level
    return out


def directional(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plus and minus movement by strict dominance; null in row 0."""
    up, dn = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where(np.isnan(up), np.nan, np.where((up > dn) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(dn), np.nan, np.where((dn > up) & (dn > 0), dn, 0.0))
    return plus, minus


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    prev = np.concatenate(([np.nan], close[:-1]))[: len(close)]
    return np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, null where b is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))
