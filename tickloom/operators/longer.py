"""Longer timeframes beside the bars they are made of.

A longer bar holds from its start to the next one's start. Each timeframe is a table
of its own, a row a longer bar: averages by a scan over blocks, the other columns by
bounded windows. The bars know the start of their own longer bar, so the join of
intervals is one of equal keys; a longer bar without prices (all of its bars have
nulls) has the columns of the one before it.

Known property, kept: the bars of a longer bar know its last close, later ones
included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.operators import scan as S
from tickloom.sources.bars import PRICES, bucket

#: Timeframe -> bars of it that a series must have more of, spans of its averages, lengths of the strength (change, rank).
FRAMES = {"1h": (50, (21, 50), (5, 10)), "4h": (20, (21, 50), (3, 5)), "1d": (10, (20,), None)}
#: Bars that a series must have more of for its strength.
BOTH = {"1h": 20, "4h": 10}
PARTS = ("trend_bullish", "trend_bearish", "price_above_ema", "price_below_ema", "momentum_bullish", "momentum_bearish")
HTF_FLAGS = [f"htf_{t}_{x}" for t in ("1h", "4h") for x in (*PARTS, "strong_trend")] + ["htf_1d_trend_bullish", "htf_1d_trend_bearish", "mtf_momentum_aligned_bull", "mtf_momentum_aligned_bear"]


def longer_bars(bars: DataFrame, tf: str) -> DataFrame:
    """symbol, tf, start, close of each longer bar (close null where it has no prices), bar_seq among those with prices."""
    at = F.when(F.col("close").isNotNull(), F.col("bar_seq"))
    there = [F.count(c) > 0 for c in PRICES[:4]]
    rows = bars.groupBy(*W.KEYS, bucket(F.col("ts"), tf).cast("timestamp_ntz").alias("start")).agg(F.max_by("close", at).alias("close"), *[c.alias(f"__{i}") for i, c in enumerate(there)])
    whole = F.col("__0") & F.col("__1") & F.col("__2") & F.col("__3")
    rows = rows.select(*W.KEYS, "start", F.when(whole, F.col("close")).alias("close"))
    order = Window.partitionBy(*W.KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bar_seq", F.count("close").over(order))


def _averages(spans: tuple[int, ...]) -> S.Stage:
    return (lambda s, own, _: {f"a{n}": S.Adjusted(s["close"][own:], 2 / (n + 1)) for n in spans}), (lambda s, own, got, made: got)


def longer_table(bars: DataFrame, tf: str, block: int) -> DataFrame:
    """symbol, tf, start and the columns of one longer timeframe, for every start: the flags, whether the series is long
    enough for them (``long_TF``), and, by the hour, the sides and strength that both timeframes are held against."""
    least, spans, strength = FRAMES[tf]
    found = longer_bars(bars, tf)
    rows = found.where("close IS NOT NULL")
    n = rows.groupBy(*W.KEYS).agg(F.count("*").alias("__n"))
    rows = S.scan(rows, [_averages(spans)], [f"a{k}" for k in spans], block, min(block, S.HALO))
    c, quick = F.col("close"), F.col(f"a{spans[0]}")
    if strength is None:
        flags = {f"htf_{tf}_trend_bullish": W.flag(c > quick), f"htf_{tf}_trend_bearish": W.flag(~(c > quick))}
        made = rows.select(*W.KEYS, "start", *[v.alias(k) for k, v in flags.items()])
        sides: list[str] = []
    else:
        slow, (change, length) = F.col(f"a{spans[1]}"), strength
        d = W.diff("close")

        def more(df: DataFrame) -> DataFrame:
            df = df.withColumns({"__g": F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0)), "__l": F.greatest(-F.coalesce(d, F.lit(0.0)), F.lit(0.0)), "__m": F.abs(W.change("close", change))})
            return df.withColumns({"__gain": W.rmean("__g", 14), "__loss": W.rmean("__l", 14), "__rank": W.rrank("__m", length)})

        rows = W.in_blocks(rows, more, max(14, change + length) + 1, block=block)
        gain, loss = F.col("__gain"), F.col("__loss")
        rsi = F.when(loss == 0, F.when(gain > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
        flags = dict(zip([f"htf_{tf}_{x}" for x in PARTS], (quick > slow, quick < slow, c > quick, c < quick, rsi > 50, rsi < 50), strict=True))
        flags |= {f"__up_{tf}": c > quick, f"__down_{tf}": c < quick, f"__strong_{tf}": F.col("__rank") > 0.7}
        made = rows.select(*W.KEYS, "start", *[W.flag(v).alias(k) for k, v in flags.items()])
        sides = [f"__up_{tf}", f"__down_{tf}", f"__strong_{tf}"]
    names = [k for k in flags if k not in sides]
    # Starts without prices have what the one before them has.
    filled = found.select(*W.KEYS, "start").join(made, [*W.KEYS, "start"], "left")
    over = Window.partitionBy(*W.KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.coalesce(F.last(k, ignorenulls=True).over(over), F.lit(0))
    filled = filled.select(*W.KEYS, "start", *[last(k).alias(k) for k in flags]).join(n, W.KEYS, "left")
    count = F.coalesce("__n", F.lit(0))
    enough = (count > least).cast("int")
    both = [(count > BOTH[tf]).cast("int").alias(f"__both_{tf}")] if tf in BOTH else []
    return filled.select(*W.KEYS, F.col("start").alias(f"__start_{tf}"), *[(F.col(k) * enough).alias(k) for k in names], *sides, enough.alias(f"long_{tf}"), *both)


def longer_flags(bars: DataFrame, block: int = S.BLOCK) -> DataFrame:
    """Bars with HTF_FLAGS (each behind an underscore, as doubles) and _htf_1h, _htf_4h, _htf_1d: whether the series is long
    enough."""
    df = bars
    for t in FRAMES:  # one a select, as Spark's time windows must be
        df = df.withColumn(f"__start_{t}", bucket(F.col("ts"), t).cast("timestamp_ntz"))
    for t in FRAMES:
        df = df.join(longer_table(bars, t, block), [*W.KEYS, f"__start_{t}"])
    both = F.col("__both_1h") * F.col("__both_4h")
    out: dict[str, Column] = {x: F.col(x) for x in HTF_FLAGS if not x.endswith("strong_trend") and not x.startswith("mtf_")}
    out |= {f"htf_{t}_strong_trend": F.col(f"__strong_{t}") * both for t in ("1h", "4h")}
    out |= {f"mtf_momentum_aligned_{x}": F.col(f"__{side}_1h") * F.col(f"__{side}_4h") * both for x, side in (("bull", "up"), ("bear", "down"))}
    return df.select(*bars.columns, *[v.cast("double").alias(f"_{k}") for k, v in out.items()], *[F.col(f"long_{t}").cast("double").alias(f"_htf_{t}") for t in FRAMES])
