"""Candle transforms, candle patterns and centred pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.operators.indicators import _heikin_ashi, per_series


def _ohlc() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("open", "high", "low", "close"))


def heikin_ashi(bars: DataFrame) -> DataFrame:
    """Adds ha_open, ha_high, ha_low, ha_close. Only the open has memory."""
    return per_series(bars, _heikin_ashi, ["ha_open", "ha_high", "ha_low", "ha_close"])


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bullish_engulfing() -> Column:
    O, _, _, C = _ohlc()  # noqa: E741
    o1, c1 = W.lag("open"), W.lag("close")
    return _known((c1 < o1) & (C > O) & (O < c1) & (C > o1))


def bearish_engulfing() -> Column:
    O, _, _, C = _ohlc()  # noqa: E741
    o1, c1 = W.lag("open"), W.lag("close")
    return _known((c1 > o1) & (C < O) & (O > c1) & (C < o1))


def pin_bar(direction: str = "bullish", ratio: float = 2.0) -> Column:
    """A wick of ``ratio`` bodies at least on one side, less than a body on the other."""
    O, H, L, C = _ohlc()  # noqa: E741
    body = F.when(O == C, 1e-9).otherwise(F.abs(C - O))
    upper, lower = H - F.greatest(O, C), F.least(O, C) - L
    long, short = (lower, upper) if direction == "bullish" else (upper, lower)
    return _known((long / body >= ratio) & (short < body))


def pivot(side: str, left: int = 5, right: int = 5) -> Column:
    """The bar is the extreme of a window with left bars before and right bars behind it, ties allowed; false at the ends."""
    w = W.series().rowsBetween(-left, right)
    x = F.col(side)
    top = F.max(x).over(w) if side == "high" else F.min(x).over(w)
    return _known((F.count(x).over(w) == left + right + 1) & (x == top))


PATTERNS: dict[str, Callable[..., Column]] = {
    "bullish_engulfing": bullish_engulfing,
    "bearish_engulfing": bearish_engulfing,
    "pin_bar": pin_bar,
    "resistance_pivot": lambda left=5, right=5: pivot("high", left, right),
    "support_pivot": lambda left=5, right=5: pivot("low", left, right),
}


def detect(name: str, bars: DataFrame, **params) -> DataFrame:
    """Bars with a boolean column of the pattern's name."""
    if name not in PATTERNS:
        raise KeyError(f"unknown pattern {name!r}; known: {sorted(PATTERNS)}")
    return bars.withColumn(name, PATTERNS[name](**params))
