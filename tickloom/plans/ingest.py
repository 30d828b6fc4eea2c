"""Queries of the ingest side: the feed, versions of stored bars, streams with state, lookups in blocks.

What they store is made by Spark from the given tables and lies in a folder of its
own below the one that the cluster shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.asof import asof
from tickloom.plans import sql as S
from tickloom.session import shared_folder
from tickloom.sources import bars as B
from tickloom.sources import candles
from tickloom.sources.snapshots import BarTable
from tickloom.streaming import derive, live, stateful

PRICES = ", ".join(f"round({c}, 6) AS {c}" for c in B.PRICES)


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.event_bars(spark, d, "1h")


def feed_candles(spark: SparkSession, d: str) -> DataFrame:
    """Ten days of two symbols out of the feed: only their chunks are asked for."""
    path = folder(spark, "feed")
    candles.write_feed(hourly(spark, d), path)
    got = candles.read(spark, path, "1h", step_days=2)
    return got.where("symbol IN ('click', 'purchase') AND ts >= TIMESTAMP_NTZ '2024-01-06 06:00:00' AND ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'")


FEED_SQL = S.given() + f" SELECT symbol, tf, ts, {PRICES} FROM bars WHERE symbol IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-06 06:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'"


def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream, in two runs of one query, laid into a versioned table."""
    path, root = folder(spark, "feed"), folder(spark, "table")
    bars = hourly(spark, d)
    for part in (bars.where("ts < TIMESTAMP_NTZ '2024-01-15 12:00:00'"), bars.where("ts >= TIMESTAMP_NTZ '2024-01-15 12:00:00'")):
        candles.write_feed(part, path)
        q = candles.stream(spark, path, "1h").writeStream.foreachBatch(lambda df, _: BarTable(df.sparkSession, root).upsert(df) and None)
        q.option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return BarTable(spark, root).read()


STREAM_SQL = S.given() + f" SELECT symbol, tf, ts, {PRICES} FROM bars"


def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """Both versions of a table that was corrected: bars, then bars of every 7th hour with other closes laid over."""
    t = BarTable(spark, folder(spark, "table"), unit_bars=240)
    bars = hourly(spark, d)
    first = t.upsert(bars.where("bar_seq % 5 <> 0"))
    second = t.upsert(bars.where("bar_seq % 7 = 0").withColumn("close", F.col("close") + 1))
    return t.read(first).withColumn("version", F.lit(first)).unionByName(t.read(second).withColumn("version", F.lit(second)))


VERSIONS_SQL = S.given() + f"""
SELECT 1 AS version, symbol, tf, ts, {PRICES} FROM bars WHERE bar_seq % 5 <> 0
UNION ALL
SELECT 2, symbol, tf, ts, {PRICES.replace("round(close, 6)", "round(CASE WHEN bar_seq % 7 = 0 THEN close + 1 ELSE close END, 6)")} FROM bars WHERE bar_seq % 5 <> 0 OR bar_seq % 7 = 0"""


def stream_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Seventeen indicator columns of bars that come in four micro-batches."""
    base = folder(spark, "stream")
    bars = hourly(spark, d).select("symbol", "tf", "ts", *B.PRICES)
    for days in ("< 8", "BETWEEN 8 AND 9", "BETWEEN 10 AND 21", "> 21"):
        bars.where(f"day(ts) {days}").coalesce(1).write.mode("append").parquet(f"{base}/bars")
    q = stateful.live_indicators(live.replay(spark, f"{base}/bars", bars.schema)).writeStream.format("parquet").option("path", f"{base}/out")
    q.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stateful.SCHEMA).parquet(f"{base}/out").where("kind = 'bar'")
    return out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", *stateful.COLUMNS)


def _stream_sql() -> str:
    mean, sd = S.full("avg", "close", 20), S.full("stddev_samp", "close", 20)
    low, high = S.full("min", "low", 14), S.full("max", "high", 14)
    columns = {
        "close": "close", "sma": mean, "bb_upper": f"({mean}) + 2 * ({sd})", "bb_lower": f"({mean}) - 2 * ({sd})", "stoch_k": f"100 * (close - ({low})) / nullif(({high}) - ({low}), 0)",
        "roc": f"100 * {S.change('close', 12)}", "ema": "ema_20", "rsi": S.rsi_of(14), "macd": "mf - ms", "macd_signal": "mg", "macd_hist": "mf - ms - mg", "atr": "atr",
        "adx": "adx", "plus_di": S.PLUS_DI, "minus_di": S.MINUS_DI, "supertrend": "CASE WHEN bar_seq > 0 THEN CASE WHEN sd = 1 THEN sl ELSE su END END", "supertrend_dir": "sd",
        "obv": f"sum(coalesce(sign(dc) * volume, 0)) OVER ({S.S})",
    }
    states = {**S.ema(20), **S.rsi(14), **S.macd(), **S.atr(), **S.adx(), **S.supertrend()}
    return S.given(S.walk("e", states), S.JOINED) + " SELECT symbol, ts, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in columns.items()) + " FROM m"


def asof_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Each event of an odd id with the latest one of an even id of its type, in blocks of time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    left = e.where("event_id % 2 = 1").select("event_id", "event_type", "ts")
    right = e.where("event_id % 2 = 0").select("event_type", F.col("ts").alias("at"), F.col("value").alias("last_value"), F.col("event_id").cast("double").alias("last_id"))
    return asof(left, right, "ts", "at", ["event_type"], ["last_value", "last_id"], rows=2000)


ASOF_SQL = """
WITH r AS (
  SELECT event_type, ts AS at, max(struct_pack(v := value, i := event_id)) AS b FROM events WHERE event_id % 2 = 0 GROUP BY ALL
)
SELECT l.event_id, l.event_type, l.ts, round(r.b.v, 6) AS last_value, CAST(r.b.i AS DOUBLE) AS last_id
FROM (SELECT * FROM events WHERE event_id % 2 = 1) l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.ts >= r.at
"""

def derived_bars(spark: SparkSession, d: str) -> DataFrame:
    """Longer bars that have followed a table through a correction, new bars and a deletion."""
    t = BarTable(spark, folder(spark, "table"), unit_bars=288)
    bars = B.event_bars(spark, d, "5m")
    steps = [
        lambda: t.upsert(bars.where("bar_seq % 11 <> 0 AND day(ts) < 20")),
        lambda: t.upsert(bars.where("bar_seq % 13 = 0 AND day(ts) < 20").withColumn("close", F.col("close") + 1)),
        lambda: t.upsert(bars.where("day(ts) >= 20")),
        lambda: t.upsert(bars.limit(0), bars.where("day(ts) = 7")),
    ]
    for step in steps:
        step()
        for longer in ("1h", "1d"):
            derive.refresh_bars(t, "5m", longer)
    return t.read().where("tf <> '5m'")


DERIVED_SQL = """
WITH b AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2
), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_seq FROM b),
held AS (
  SELECT symbol, ts, open, high, low, CASE WHEN bar_seq % 13 = 0 AND day(ts) < 20 THEN close + 1 ELSE close END AS close, volume
  FROM n WHERE (bar_seq % 11 <> 0 OR bar_seq % 13 = 0 OR day(ts) >= 20) AND day(ts) <> 7
), longer AS (
  SELECT *, '1h' AS tf, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start FROM held
  UNION ALL SELECT *, '1d', time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') FROM held
)
SELECT symbol, tf, start AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume
FROM longer GROUP BY symbol, tf, start
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "feed_candles": (feed_candles, FEED_SQL),
    "feed_stream": (feed_stream, STREAM_SQL),
    "table_versions": (table_versions, VERSIONS_SQL),
    "stream_indicators": (stream_indicators, _stream_sql()),
    "asof_ticks": (asof_ticks, ASOF_SQL),
    "derived_bars": (derived_bars, DERIVED_SQL),
}
