"""A candle source behind a REST interface, read in time chunks, one partition each.

No network is used here: the transport is a function of (symbol, resolution,
start, end) that returns the decoded answer, or None where it fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tickloom.sources.bars import SECONDS, normalise

#: How the interface names timeframes and asset classes.
RESOLUTIONS = {"1m": "1", "5m": "5", "15m": "15", "30m": "30", "1h": "60", "1d": "D", "1w": "W"}
CHUNK_DAYS = 5
#: Metals are quoted with an underscore there.
METALS = {"XAUUSD": "XAU_USD", "XAGUSD": "XAG_USD", "XPTUSD": "XPT_USD", "XPDUSD": "XPD_USD"}


def remote_symbol(symbol: str, asset_class: str) -> str:
    """The feed's name of an instrument; one with a prefix has it already."""
    s, kind = symbol.upper(), asset_class.lower()
    if ":" in s or kind not in ("forex", "crypto"):
        return s
    return f"OANDA:{METALS.get(s, s)}" if kind == "forex" else f"BINANCE:{s}"


def chunks(now: datetime, days: int, step: int = CHUNK_DAYS) -> list[tuple[datetime, datetime]]:
    """[now - days, now) in runs of step days."""
    at, out = now - timedelta(days=days), []
    while at < now:
        end = min(now, at + timedelta(days=step))
        out.append((at, end))
        at = end
    return out


def rows_of(answer: dict | None) -> pd.DataFrame:
    """Candles of an answer, each time once (the first); none where the answer isn't "ok"."""
    if not answer or answer.get("s") != "ok":
        return pd.DataFrame(columns=["timestamp", "open", "high", "low", "close", "volume"])
    out = pd.DataFrame({"timestamp": answer["t"], "open": answer["o"], "high": answer["h"], "low": answer["l"], "close": answer["c"], "volume": answer.get("v") or [0.0] * len(answer["t"])})
    return out.drop_duplicates("timestamp").astype(float)


def fetch(spark: SparkSession, get: Callable, symbol: str, tf: str, asset_class: str, now: datetime, days: int, step: int = CHUNK_DAYS) -> DataFrame:
    """Bars of the last days; a chunk that fails is left out, the others stand."""
    spans = [(int(a.timestamp()), int(b.timestamp())) for a, b in chunks(now, days, step)]
    name, res = remote_symbol(symbol, asset_class), RESOLUTIONS.get(tf, str(SECONDS[tf] // 60))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a, b in pdf[["a", "b"]].itertuples(index=False):
                try:
                    yield rows_of(get(name, res, int(a), int(b)))
                except Exception:
                    continue

    todo = spark.createDataFrame(spans, "a long, b long").repartition(max(1, len(spans)))
    return normalise(todo.mapInPandas(run, "timestamp double, open double, high double, low double, close double, volume double"), symbol, tf)
