"""The ingest cycle: fetch what is new, lay it over the stored bars, rebuild longer timeframes.

    python -m tickloom.streaming.runner ROOT SYMBOL... --feed MODULE:FUNCTION [--loop | --backfill DAYS] [--skip-features]

The feed is a function of (symbol, resolution, start, end), see sources/feed.py.
A symbol that fails is reported and left for the next cycle, and so is a timeframe;
the others go on. Longer bars and features follow what has changed (derive.py), for
all symbols together; a backfill changes bars, so theirs are made again too.
"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import indicators
from tickloom.session import session
from tickloom.sources import bars as B
from tickloom.sources import feed
from tickloom.sources.snapshots import BarTable, bar_table
from tickloom.streaming import derive

DERIVED = ("5m", "15m", "1h", "4h", "1d")
#: Indicators that the feature table of each longer timeframe has; their memory fades, so tails suffice.
FEATURES = ("sma", "bollinger_bands", "ema", "rsi", "macd", "atr")
#: Minutes that are read again, for corrections, and those read where nothing is stored.
OVERLAP, FIRST = 5, 90


def features_of(bars: DataFrame) -> DataFrame:
    for name in FEATURES:
        bars = indicators.compute(name, bars)
    return bars


def feature_table(spark: SparkSession, root: str) -> BarTable:
    columns = [c for n in FEATURES for c in (indicators.WINDOWED | indicators.RECURSIVE)[n][1]]
    return BarTable(spark, f"{root}/features", T.StructType([*B.BARS.fields[:3], *[T.StructField(c, T.DoubleType()) for c in columns]]))


def cycle(spark: SparkSession, root: str, symbols: dict[str, str], get: Callable, now: datetime, tf: str = "1m", derived: tuple[str, ...] = DERIVED, days: float | None = None, skip_features: bool = False) -> dict[str, str]:
    """One pass over the symbols (name -> asset class): "ok" or the error of each, and the error of each timeframe (or
    "features TIMEFRAME") whose tables could not follow. A cycle that runs again changes nothing."""
    out = {}

    def tried(name: str, work: Callable[[], object], well: str | None) -> None:
        try:
            work()
            if well:
                out[name] = well
        except Exception as e:  # the others go on; the next cycle tries again
            out[name] = f"{type(e).__name__}: {e}"[:300]

    def fetched(symbol: str, kind: str) -> None:
        last = B.latest(B.read_parquet(spark, root, symbol, tf)).first()
        start = now - timedelta(days=days) if days else (last["latest_ts"].replace(tzinfo=now.tzinfo) - timedelta(minutes=OVERLAP)) if last else now - timedelta(minutes=FIRST)
        span = (now - start).total_seconds() / 86400
        new = feed.fetch(spark, get, symbol, tf, kind, now, max(1, int(-(-span // 1))) if days else 1)
        B.upsert(spark, root, new.where(F.col("ts") >= F.lit(start.replace(tzinfo=None)).cast("timestamp_ntz")))

    for symbol, kind in symbols.items():
        tried(symbol, lambda s=symbol, k=kind: fetched(s, k), "ok")
    table = bar_table(spark, root)
    longer = [t for t in derived if B.SECONDS[t] > B.SECONDS[tf]]
    for t in longer:
        tried(t, lambda t=t: derive.refresh_bars(table, tf, t), None)
    if not skip_features:
        back, ahead = derive.horizon(list(FEATURES))
        for t in longer:
            tried(f"features {t}", lambda t=t: derive.refresh_features(table, feature_table(spark, root), t, features_of, back, ahead), None)
    return out


def loop(run: Callable[[], dict[str, str]], every: float = 60.0, cycles: int | None = None) -> int:
    """Run cycles at this pace, a moment apart at least; how many ran."""
    n = 0
    while cycles is None or n < cycles:
        began = time.monotonic()
        print(run(), flush=True)
        n += 1
        if cycles is None or n < cycles:
            time.sleep(max(0.5, every - (time.monotonic() - began)))
    return n


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("symbols", nargs="+")
    p.add_argument("--feed", required=True)
    p.add_argument("--asset-class", default="forex")
    p.add_argument("--loop", action="store_true")
    p.add_argument("--backfill", type=float)
    p.add_argument("--cycles", type=int)
    p.add_argument("--skip-features", action="store_true")
    a = p.parse_args()
    module, _, name = a.feed.partition(":")
    get = getattr(importlib.import_module(module), name)
    spark = session("ingest")

    def run() -> dict[str, str]:
        return cycle(spark, a.root, dict.fromkeys(a.symbols, a.asset_class), get, datetime.now(UTC), days=a.backfill, skip_features=a.skip_features)

    if a.loop:
        loop(run, cycles=a.cycles)
    else:
        print(run())


if __name__ == "__main__":
    main()
