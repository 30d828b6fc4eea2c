"""Longer bars and features that follow a bar table, against full rebuilds after random corrections."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import indicators
from tickloom.sources import bars as B
from tickloom.sources.snapshots import BarTable, Snapshot
from tickloom.streaming import derive

START = datetime(2024, 1, 1)


def minutes(spark, symbol, at, rng):
    rows = []
    for m in at:
        o, c = (float(x) for x in 100 + rng.normal(size=2).round(3))
        rows.append((symbol, "1m", START + timedelta(minutes=int(m)), o, max(o, c) + 1, min(o, c) - 1, c, float(rng.integers(1, 9))))
    return spark.createDataFrame(rows, B.BARS)


def key(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select("symbol", "tf", "ts", *[c for c in df.columns if c not in ("symbol", "tf", "ts", "bar_seq")]).collect())


@pytest.fixture
def reads(monkeypatch):
    """Units that snapshots are asked for."""
    seen, read = [], Snapshot.read

    def noted(self, units=None):
        seen.append(set(self.units if units is None else units))
        return read(self, units)

    monkeypatch.setattr(Snapshot, "read", noted)
    return seen


def test_longer_bars_follow_corrections(spark, tmp_path, reads):
    rng = np.random.default_rng(8)
    t = BarTable(spark, str(tmp_path / "t"), unit_bars=120)
    t.upsert(minutes(spark, "A", range(0, 1500), rng).unionByName(minutes(spark, "B", range(0, 1500, 7), rng)))
    steps = [
        lambda: t.upsert(minutes(spark, "A", rng.choice(1500, 5, replace=False), rng)),  # corrections
        lambda: t.upsert(minutes(spark, "B", range(3000, 3010), rng)),  # a gap, then new bars
        lambda: t.upsert(t.read().limit(0), t.read().where("symbol = 'B' AND tf = '1m' AND ts < TIMESTAMP_NTZ '2024-01-01 04:00:00'")),  # buckets that go
        lambda: None,
    ]
    for longer in ("5m", "4h"):
        derive.refresh_bars(t, "1m", longer)
    for step in steps:
        step()
        for longer in ("5m", "4h"):
            reads.clear()
            before = t.snapshot()
            after = derive.refresh_bars(t, "1m", longer)
            assert key(t.read().where(F.col("tf") == longer)) == key(B.resample(t.read().where("tf = '1m'").withColumn("bar_seq", F.lit(0)), longer).drop("bar_seq"))
            if after == before.version:
                assert step is steps[-1]
    # One corrected minute: of the base only the units of its bucket are read.
    t.upsert(minutes(spark, "A", [130], rng))
    reads.clear()
    derive.refresh_bars(t, "1m", "5m")
    base = {u for r in reads for u in r if "-1m-" in u}
    assert len(base) == 1
    assert len({u for r in reads for u in r}) <= 2
    version = t.snapshot().version
    assert derive.refresh_bars(t, "1m", "5m") == version  # nothing to do, no version


def test_a_version_that_says_the_same_changes_no_bars(spark, tmp_path):
    rng = np.random.default_rng(9)
    t = BarTable(spark, str(tmp_path / "t"), unit_bars=60)
    rows = minutes(spark, "A", range(200), rng)
    t.upsert(rows)
    derive.refresh_bars(t, "1m", "5m")
    t.upsert(rows)
    now = t.snapshot()
    assert derive.changed_rows(t, now, now.version - 1, set(now.named("A", "1m"))).count() == 0
    old = {u: c for u, c in now.units.items() if "-5m-" in u}
    derive.refresh_bars(t, "1m", "5m")
    assert {u: c for u, c in t.snapshot().units.items() if "-5m-" in u} == old


COLS = {"sma": ["sma"], "roc": ["roc"], "ema": ["ema"], "atr": ["atr"], "obv": ["obv"]}


@pytest.mark.parametrize("names", [["sma", "roc"], ["ema"], ["obv"]])
def test_features_follow(spark, tmp_path, reads, names):
    rng = np.random.default_rng(10)
    bars = BarTable(spark, str(tmp_path / "b"), unit_bars=100)
    schema = T.StructType([*B.BARS.fields[:3], *[T.StructField(c, T.DoubleType()) for n in names for c in COLS[n]]])
    feats = BarTable(spark, str(tmp_path / "f"), schema, unit_bars=100)

    def compute(df):
        for n in names:
            df = indicators.compute(n, df)
        return df

    back, ahead = derive.horizon(names)
    bars.upsert(minutes(spark, "A", range(1000), rng).unionByName(minutes(spark, "B", range(0, 600, 3), rng)))
    derive.refresh_features(bars, feats, "1m", compute, back, ahead)
    for at in ([310, 311], [999, 1000, 1001], [5]):
        bars.upsert(minutes(spark, "A", at, rng))
        reads.clear()
        derive.refresh_features(bars, feats, "1m", compute, back, ahead)
        want = compute(B.numbered(bars.read())).select(*schema.names)
        assert key(feats.read(), 8) == key(want, 8)
    if back is not None and back < 100:
        assert len(reads[0]) < 5  # of ten units of A and six of B
    assert derive.refresh_features(bars, feats, "1m", compute, back, ahead) == feats.snapshot().version


def test_reach():
    order, counts = list("abcdef"), dict.fromkeys("abcdef", 10)
    assert derive._reach(order, counts, {"c"}, 10, 0) == {"c", "d"}
    assert derive._reach(order, counts, {"c"}, 11, 1) == {"b", "c", "d", "e"}
    assert derive._reach(order, counts, {"c"}, None, 0) == {"c", "d", "e", "f"}
    assert derive._reach(order, counts | {"d": 0}, {"c", "e"}, 5, 0) == {"c", "d", "e", "f"}
    assert derive.fading(0.5) == 40


def test_a_cycle_keeps_timeframes_apart(spark, tmp_path, monkeypatch):
    """Bars, longer bars and features of a backfill equal a full build; a timeframe that fails leaves the others."""
    from datetime import UTC

    from tickloom.streaming import runner

    now = datetime(2024, 1, 3, tzinfo=UTC)
    at = [int(now.timestamp()) - 60 * k for k in range(2000, 0, -1)]
    price = {t: 100 + (t // 60) % 37 / 7 for t in at}

    def get(symbol, res, a, b):
        t = [x for x in at if a <= x < b]
        return {"s": "ok", "t": t, **{c: [price[x] for x in t] for c in "ohlc"}}

    root, refresh = str(tmp_path / "i"), derive.refresh_bars

    def broken(table, base, longer):
        if longer == "15m":
            raise OSError("disk")
        return refresh(table, base, longer)

    monkeypatch.setattr(derive, "refresh_bars", broken)
    got = runner.cycle(spark, root, {"EURUSD": "forex"}, get, now, derived=("5m", "15m"), days=2)
    assert got == {"EURUSD": "ok", "15m": "OSError: disk"}
    five = B.read_parquet(spark, root, "EURUSD", "5m")
    assert five.count() == 400
    feats = runner.feature_table(spark, root)
    assert key(feats.read(), 7) == key(runner.features_of(five).select(*feats.schema.names), 7)
    monkeypatch.setattr(derive, "refresh_bars", refresh)
    price[at[1000]] += 5  # a correction, read again by a backfill
    assert runner.cycle(spark, root, {"EURUSD": "forex"}, get, now, derived=("5m", "15m"), days=2, skip_features=True) == {"EURUSD": "ok"}
    fifteen = B.read_parquet(spark, root, "EURUSD", "15m")
    assert key(fifteen.drop("bar_seq")) == key(B.resample(B.read_parquet(spark, root, "EURUSD", "1m"), "15m").drop("bar_seq"))
    version = feats.snapshot().version
    runner.cycle(spark, root, {"EURUSD": "forex"}, get, now, derived=("5m", "15m"), days=2)
    assert feats.snapshot().version > version
    assert key(feats.read().where("tf = '5m'"), 7) == key(runner.features_of(B.read_parquet(spark, root, "EURUSD", "5m")).select(*feats.schema.names), 7)
