"""What spreads a long series gives the same at any block length: flags, order statistics, scans of two stages."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.functions import windows as W
from tickloom.functions.order import exact_quantile, rolling_order
from tickloom.operators import flags, scan
from tickloom.sources.bars import COLUMNS


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(21)
    rows = []
    for symbol, n in (("A", 3600), ("B", 40)):
        c = 2000 + rng.normal(size=n).cumsum()
        for i in range(n):
            o = c[i - 1] if i else c[0]
            h, l = max(o, c[i]) + rng.random(), min(o, c[i]) - rng.random()  # noqa: E741
            rows.append((symbol, "5m", datetime(2024, 1, 1) + timedelta(minutes=5 * i + 2000 * (i > 900)), i, float(o), float(h), float(l), float(c[i]), float(rng.integers(1, 99))))
    return spark.createDataFrame(pd.DataFrame(rows, columns=COLUMNS)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def test_flags_at_any_block_length(bars):
    a, b = (flags.flag_features(bars, "5m", block=n).orderBy("symbol", "bar_seq").toPandas() for n in (10**6, 400))
    assert len(a) == 3640
    differ = [c for c in a.columns if not a[c].equals(b[c])]
    # Rolling deviations of pandas carry rounding along; nothing else may differ, and that hardly ever.
    assert sum((a[c] != b[c]).sum() for c in differ) <= 3, differ
    assert (a.drop(columns=["symbol", "tf", "ts", "bar_seq"]) != 0).any().sum() > 350


def test_no_step_of_flags_gathers_a_series(bars):
    """Grouped maps and windows of the flags themselves are by run of a series."""
    plan = flags.flag_features(bars, "5m")._jdf.queryExecution().optimizedPlan().toString()
    maps = [x for x in plan.splitlines() if "FlatMapGroupsInPandas" in x]
    assert len(maps) == 1
    assert "explode" in plan.split("FlatMapGroupsInPandas")[1]


def test_a_scan_of_two_stages(bars):
    def one(s, own, made):
        return {"x": scan.Faded(s["close"][own:], 0.1), "t": scan.Trend(s["close"][own:] > s["open"][own:] + 1, s["close"][own:] < s["open"][own:] - 1, own == 0 and len(s["bar_seq"]) > 0 and s["bar_seq"][0] == 0)}

    def two(s, own, made):
        return {"y": scan.Faded(s["close"][own:] - made["x"], 0.05)}

    stages = [(one, lambda s, own, got, made: got), (two, lambda s, own, got, made: got)]
    got = scan.scan(bars, stages, ["x", "y", "t"], block=257, halo=3).orderBy("symbol", "bar_seq").toPandas()
    assert len(got) == 3640
    for _, g in got.groupby("symbol"):
        c = g["close"].to_numpy()
        x = K.ewma(c, 0.1)
        np.testing.assert_allclose(g["x"], x, rtol=1e-12)
        np.testing.assert_allclose(g["y"], K.ewma(c - x, 0.05), rtol=1e-9, atol=1e-12)
        s, want = 0, []
        for i, d in enumerate((g["close"] - g["open"]).tolist()):
            s = s if i == 0 else 1 if s == 0 and d > 1 else 0 if s == 1 and d < -1 else s
            want.append(s)
        np.testing.assert_array_equal(g["t"], want)


def test_rolling_order(spark, bars):
    df = bars.withColumn("x", F.when(F.col("bar_seq") % 37 != 5, F.round(F.col("close"))))  # ties and nulls
    want = df.withColumns({"r": W.rrank("x", 20), "q": W.rquantile("x", 30, 0.8)}).orderBy("symbol", "bar_seq").toPandas()
    for block in (10**6, 64):
        got = rolling_order(df, "x", {"r": ("rank", 20), "q": ("quantile", 30, 0.8)}, block).orderBy("symbol", "bar_seq").toPandas()
        np.testing.assert_allclose(got["r"], want["r"], rtol=1e-12)
        np.testing.assert_allclose(got["q"], want["q"], rtol=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_exact_quantile(spark, p):
    rng = np.random.default_rng(3)
    groups = {k: np.round(rng.gamma(2, size=n), d) for k, n, d in (("a", 1, 5), ("b", 2, 5), ("c", 12, 5), ("d", 5000, 1), ("e", 20000, 12), ("f", 11, 0))}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("g", None), ("a", None)], "k string, x double")
    got = {r["k"]: r["v"] for r in exact_quantile(df.repartition(7), ["k"], "x", p, "v").collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert abs(got[k] - np.percentile(v, 100 * p)) < 1e-12, k
