"""Streamed indicators against the batch columns, over several splits into micro-batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators
from tickloom.sources import bars as B
from tickloom.streaming import live, stateful


@pytest.fixture(scope="module")
def bars(spark, data):
    return B.event_bars(spark, data, "1h").where("symbol IN ('click', 'view')").cache()


def batch(bars):
    df = indicators.compute("sma", bars)
    df = indicators.compute("bollinger_bands", df).drop("bb_middle", "bb_width")
    df = indicators.compute("stochastic", df).drop("stoch_d")
    df = indicators.compute("roc", df)
    df = indicators.compute("obv", df)
    for name in ("ema", "rsi", "macd", "atr", "adx", "supertrend"):
        df = indicators.compute(name, df)
    return df.orderBy("symbol", "ts").toPandas()


def stream(spark, parts, folder, lateness=None, swing=3):
    """Parts of a table, one file each, one a batch; the query is started anew for each."""
    src, out = str(folder / "src"), str(folder / "out")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        q = stateful.live_indicators(live.replay(spark, src, part.schema), swing, lateness)
        q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out).orderBy("symbol", "ts").toPandas()


def same(got, want):
    got = got[got["kind"] == "bar"].reset_index(drop=True)
    assert len(got) == len(want)
    for c in ("close", *stateful.COLUMNS):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("cuts", [[40], [7, 8, 60]])
def test_any_split_gives_the_batch_columns(spark, bars, tmp_path, cuts):
    edges = [0, *cuts, 10**9]
    rows = bars.select("symbol", "tf", "ts", *B.PRICES, "bar_seq")
    parts = [rows.where(F.col("bar_seq").between(a, b - 1)).drop("bar_seq") for a, b in zip(edges, edges[1:], strict=False)]
    got, want = stream(spark, parts, tmp_path), batch(bars)
    same(got, want)
    found = {(r.symbol, r.ts, r.kind, r.pivot) for r in got[got["kind"] != "bar"].itertuples()}
    right = set()
    for symbol, g in want.groupby("symbol"):
        g = g.reset_index(drop=True)
        for i in range(3, len(g) - 3):
            near = g.iloc[i - 3 : i + 4]
            if g["high"][i] == near["high"].max():
                right.add((symbol, g["ts"][i], "high", g["high"][i]))
            if g["low"][i] == near["low"].min():
                right.add((symbol, g["ts"][i], "low", g["low"][i]))
    assert found == right
    assert right


def test_bars_out_of_order_wait_for_the_watermark(spark, bars, tmp_path):
    rows = bars.where("symbol = 'click'").select("symbol", "tf", "ts", *B.PRICES, "bar_seq")
    n = rows.count()
    # Each run of four comes in the wrong order over two batches; a far bar moves the watermark past all others.
    odd, even = rows.where("bar_seq % 4 IN (1, 2)"), rows.where("bar_seq % 4 NOT IN (1, 2)")
    half = lambda d, k: d.where(F.col("bar_seq") < n // 2 if k == 0 else F.col("bar_seq") >= n // 2).drop("bar_seq")
    far = rows.limit(1).select("symbol", "tf", (F.col("ts") + F.expr("INTERVAL 3000 DAYS")).alias("ts"), *B.PRICES)
    parts = [half(even, 0), half(odd, 0), half(odd, 1), half(even, 1), far, far.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))]
    got = stream(spark, parts, tmp_path, lateness="60 days")
    same(got, batch(bars.where("symbol = 'click'")))


def test_a_bar_that_is_late_is_passed_over(spark, bars, tmp_path):
    rows = bars.where("symbol = 'click' AND bar_seq < 30").select("symbol", "tf", "ts", *B.PRICES, "bar_seq")
    late = rows.where("bar_seq = 3").withColumn("close", F.lit(1e6))
    parts = [rows.where("bar_seq < 20").drop("bar_seq"), rows.where("bar_seq >= 20").unionByName(late).drop("bar_seq")]
    same(stream(spark, parts, tmp_path), batch(bars.where("symbol = 'click' AND bar_seq < 30")))


def test_nulls_count_as_in_the_batch_columns(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(size=80).cumsum()
    close[[5, 6, 40]] = np.nan
    want = {"ema": None}
    s, got = stateful.Series(None, [], 2), []
    for i, c in enumerate(close):
        got.append(s.take(i, (c, c + 1, c - 1, c, 1.0)))
    from tickloom.functions import kernels as K

    want = {"ema": K.ewma(close, 2 / 21), "atr": K.ewma(K.true_range(close + 1, close - 1, close), 1 / 14)}
    for k, v in want.items():
        np.testing.assert_allclose([g[k] for g in got], v, rtol=1e-12)
    assert pd.isna([g.get("sma", np.nan) for g in got][10:25]).all()
