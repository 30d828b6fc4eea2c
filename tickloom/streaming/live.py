"""Bars and indicators from streams, with late and corrected rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tickloom.sources import bars as B
from tickloom.sources.snapshots import bar_table
from tickloom.streaming.derive import refresh_bars


def tumbling_bars(ticks: DataFrame, tf: str, symbol: str, ts: str, price: str, tie: str, watermark: str = "5 minutes") -> DataFrame:
    """Bars of a stream of prices. With a watermark closed bars come out once, after rows that late have been taken in."""
    at, p = F.struct(ts, tie), F.col(price)
    got = ticks.withWatermark(ts, watermark).groupBy(F.col(symbol).alias("symbol"), F.window(ts, f"{B.SECONDS[tf]} seconds").alias("w"))
    return got.agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count("*").cast("double").alias("volume")).select("symbol", F.lit(tf).alias("tf"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def upsert_stream(bars: DataFrame, root: str, checkpoint: str, derived: tuple[str, ...] = (), once: bool = True, every: str = "60 seconds") -> StreamingQuery:
    """Lay a stream of (corrected) bars over the stored ones, newest arrival last, and let longer timeframes follow: only
    buckets with changed bars are made again. A batch that runs again gives the same tables."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        if df.isEmpty():
            return
        rows = df.groupBy("symbol", "tf", "ts").agg(F.max_by(F.struct(*B.PRICES), "arrival").alias("x")).select("symbol", "tf", "ts", "x.*") if "arrival" in df.columns else df
        B.upsert(spark, root, rows)
        for base in [r["tf"] for r in rows.select("tf").distinct().collect()]:  # a handful of timeframes
            for longer in derived:
                if B.SECONDS[longer] > B.SECONDS[base]:
                    refresh_bars(bar_table(spark, root), base, longer)

    w = bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


STATE = "fast double, slow double, n long"
OUT = "symbol string, ts timestamp, close double, fast double, slow double, signal string"


def live_crosses(bars: DataFrame, fast: int = 9, slow: int = 21) -> DataFrame:
    """Averages of a stream of bars carried in state, with a signal where they cross: as the batch strategy has them."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        f, s, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for ts, c in zip(rows["ts"], rows["close"], strict=True):
            pf, ps = f, s
            f, s = (c, c) if n == 0 else (f + a * (c - f), s + b * (c - s))
            live = n >= slow + 1
            out.append((key[0], ts, c, f, s, "buy" if live and f > s and pf <= ps else "sell" if live and f < s and pf >= ps else None))
            n += 1
        state.update((f, s, n))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "fast", "slow", "signal"])

    return bars.groupBy("symbol").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def replay(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files in a folder, one file a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
