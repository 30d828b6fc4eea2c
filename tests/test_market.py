"""Fixtures made by hand, plain twins of the sequential operators, and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels as K
from tickloom.functions import windows as W
from tickloom.operators import asof, candles, chartpatterns, compact, flags, indicators, longseries, metrics, renko, search, simulate, structure, tradefilter
from tickloom.plans import spec, strategies
from tickloom.sources import bars as B
from tickloom.sources import feed, store
from tickloom.sources.records import Records
from tickloom.streaming import live


def make(spark, rows, tf="1h", symbol="S"):
    """Bars from (open, high, low, close, volume) or closes."""
    full = [r if isinstance(r, tuple) else (r, r, r, r, 1.0) for r in rows]
    pdf = pd.DataFrame(full, columns=["open", "high", "low", "close", "volume"]).astype(float)
    pdf["ts"] = pd.date_range("2024-01-01", periods=len(pdf), freq="1h")
    pdf["symbol"], pdf["tf"], pdf["bar_seq"] = symbol, tf, range(len(pdf))
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(size=n))
    o = np.concatenate(([c[0]], c[:-1]))
    h, l = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    return [tuple(map(float, x)) for x in zip(o, h, l, c, rng.integers(1, 50, n), strict=True)]


def signals(n, **at):
    s = {k: np.zeros(n, bool) for k in ("go_long", "go_short", "leave_long", "leave_short")}
    for k, i in at.items():
        s[k][i] = True
    return s


def ohlc(rows):
    a = np.array(rows, float)
    return {k: a[:, i] for i, k in enumerate(("open", "high", "low", "close"))}


def nothing(n):
    return {"stop_dist": np.full(n, np.nan), "target_dist": np.full(n, np.nan)}


# --- kernels and windows ------------------------------------------------------------------------------------------------


def test_ewma_over_a_gap():
    assert np.allclose(K.ewma(np.array([1, np.nan, 3, 4.0]), 0.5), [1, 1, 2.3333333, 3.1666667])
    x = np.array([np.nan, 2, 5, np.nan, np.nan, 1, 4])
    assert np.allclose(K.ewma(x, 0.3), pd.Series(x).ewm(alpha=0.3, adjust=False).mean(), equal_nan=True)
    assert np.allclose(K.ewma_adjusted(x, 5), pd.Series(x).ewm(span=5).mean(), equal_nan=True)


def test_blocks_match_the_kernel(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=97)
    x[rng.random(97) < 0.4] = np.nan
    x[20:45] = np.nan
    b = make(spark, list(range(97))).drop("close").join(spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "bar_seq long, close double"), "bar_seq")
    got = longseries.ewma_blocks(b, "close", 0.3, "e", 10).orderBy("bar_seq").toPandas()["e"].to_numpy(float)
    assert np.allclose(got, K.ewma(x, 0.3), equal_nan=True)


def test_rank_with_ties(spark):
    b = make(spark, [1, 2, 2, 3, 2])
    assert b.select(W.rrank("close", 5).alias("r"), "bar_seq").orderBy("bar_seq").collect()[-1]["r"] == pytest.approx(0.6)


def test_windows_are_null_until_full(spark):
    b = make(spark, [1, 2, 3])
    row = b.select(W.rmean("close", 4).alias("a"), W.rquantile("close", 4, 0.5).alias("q"), W.rstd("close", 3).alias("s"), "bar_seq").orderBy("bar_seq").collect()
    assert [r["a"] for r in row] == [None] * 3
    assert row[2]["q"] is None
    assert row[2]["s"] == pytest.approx(1.0)


def test_change_from_zero_is_unknown(spark):
    b = make(spark, [0, 5, 10])
    assert [r["x"] for r in b.select(W.change("close", 1).alias("x"), "bar_seq").orderBy("bar_seq").collect()] == [None, None, 1.0]


def test_flat_bars(spark):
    b = make(spark, [5.0] * 40)
    assert b.transform(lambda d: indicators.compute("stochastic", d)).where("stoch_k IS NOT NULL").count() == 0
    assert indicators.compute("rsi", b).where("rsi IS NOT NULL").count() == 0
    f = flags.flag_features(b, "1h", ["candles"])
    assert f.agg(F.sum("small_body")).first()[0] == 0


def test_rsi_without_losses_is_null(spark):
    assert indicators.compute("rsi", make(spark, list(range(1, 40)))).where("rsi IS NOT NULL").count() == 0


def test_unknown_names_raise(spark):
    b = make(spark, [1, 2])
    with pytest.raises(KeyError):
        indicators.compute("nope", b)
    with pytest.raises(ValueError):
        indicators.compute("ema", b, nope=1)
    with pytest.raises(KeyError):
        candles.detect("nope", b)
    with pytest.raises(KeyError):
        strategies.get("nope")


# --- simulator ----------------------------------------------------------------------------------------------------------


def test_stop_before_target():
    rows = [(10, 10, 10, 10), (10, 20, 0, 10)]
    s = ohlc(rows) | signals(2, go_long=[0]) | {"stop_dist": np.array([2.0, 2]), "target_dist": np.array([5.0, 5])}
    trades, equity, _ = simulate.run(s)
    assert [(t[4], t[8]) for t in trades] == [(8.0, "stop_loss")]
    assert equity[-1] == 99_998


def test_stop_then_entry_on_one_bar():
    rows = [(10, 10, 10, 10), (10, 10, 5, 9), (9, 9, 9, 9)]
    s = ohlc(rows) | signals(3, go_long=[0, 1]) | {"stop_dist": np.full(3, 2.0), "target_dist": np.full(3, np.nan)}
    trades, *_ = simulate.run(s)
    assert [(t[1], t[3], t[8]) for t in trades] == [(0, 1, "stop_loss"), (1, 2, "end_of_data")]


def test_flip_and_end_of_data():
    rows = [(10, 10, 10, 10), (8, 8, 8, 8), (9, 9, 9, 9)]
    s = ohlc(rows) | {"action": np.array([-1, 1, 0])} | nothing(3)
    trades, equity, dd = simulate.flips(s, simulate.Costs(commission=1.0))
    assert [(t[0], t[4], t[8]) for t in trades] == [("short", 8, "flip_to_long"), ("long", 9, "end_of_data")]
    assert equity.tolist() == [100_000, 100_001, 100_001]  # the last point takes the closing commission
    assert dd.tolist()[0] == 0


def test_costs_and_next_open():
    rows = [(10, 10, 10, 10), (12, 12, 12, 12), (14, 14, 14, 14)]
    s = ohlc(rows) | signals(3, go_long=[0], leave_long=[1]) | nothing(3)
    t = simulate.run(s, simulate.Costs(slippage=0.5, commission=1.0, position_size=2.0, on_close=False))[0][0]
    assert (t[2], t[4], t[5], t[7]) == (12.5, 13.5, 1.0, 1.0)


def test_pnl_adds_up(spark):
    r = simulate.simulate(strategies.get("ema_crossover").signals(make(spark, walk(300)), {"use_sl_tp": True})).cache()
    total = simulate.trades_of(r).agg(F.sum("pnl")).first()[0]
    last = r.orderBy(F.desc("bar_seq")).first()["equity"]
    assert last - 100_000 == pytest.approx(total, abs=0.006)


def test_metrics_of_gains_only(spark):
    r = simulate.simulate(strategies.from_rules("x", {"long": {"left": "close", "op": "<", "right": 2}, "warmup": 0}).signals(make(spark, [1, 2, 3, 4, 5])))
    m = metrics.backtest_metrics(r).first()
    assert (m["profit_factor"], m["n_trades"], m["max_drawdown_pct"]) == (999.0, 1, 0.0)


def test_no_trades_and_no_bars(spark):
    r = simulate.simulate(strategies.get("ema_crossover").signals(make(spark, [1.0] * 30)))
    m = metrics.backtest_metrics(r).first()
    assert m["n_trades"] == 0
    assert m["sharpe_ratio"] == 0
    assert m["final_equity"] == 100_000
    assert metrics.backtest_metrics(simulate.simulate(strategies.get("ema_crossover").signals(make(spark, [1.0]).where("false")))).count() == 0


def test_search_signals_match_the_rules(spark):
    b = make(spark, walk(300))
    for p in ({}, {"use_adx_filter": True}, {"use_sl_tp": True}, {"tp_points": 2.0, "sl_points": 1.0}):
        want = strategies.get("ema_crossover").signals(b, p).orderBy("bar_seq").toPandas()
        pdf = b.orderBy("bar_seq").toPandas()
        got = search.ema_cross_signals({k: pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume")}, p)
        for k in ("go_long", "go_short", "leave_long", "leave_short"):
            assert (want[k].to_numpy(bool) == got[k]).all(), (p, k)
        live_ = want["go_long"] | want["go_short"]
        assert np.allclose(want["stop_dist"].astype(float)[live_], got["stop_dist"][live_.to_numpy()], equal_nan=True)


@pytest.mark.parametrize("name", ["heikin_ashi_ema_cross", "rsi_mean_reversion", "bollinger_breakout", "macd_trend"])
def test_array_signals_match_the_rules(spark, name):
    b = make(spark, walk(320, 7))
    pdf = b.orderBy("bar_seq").toPandas()
    s = {k: pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume")}
    for p in ({}, {"use_sl_tp": True} if "ha" in name[:2] else {"use_trend_filter": True, "ema_trend": 30} if "bollinger" not in name else {"exit_on_middle": False}):
        want = strategies.get(name).signals(b, p).orderBy("bar_seq").toPandas()
        got = search.SIGNALS[name](s, strategies.get(name).params(p))
        for k in ("go_long", "go_short", "leave_long", "leave_short"):
            assert (want[k].to_numpy(bool) == got[k]).all(), (p, k)


def test_finder(spark):
    ranked, folds = search.finder(make(spark, walk(400, 2)), "rsi_mean_reversion", {"rsi_period": [7, 14], "nope": [1]}, {"zz": 1}, max_bars=300)
    assert ranked.count() == 2
    assert folds.count() == 2
    assert search.combo_table(ranked, "n_trades", False, 1).count() == 1


def test_ingest_cycle(spark, tmp_path):
    from datetime import UTC, datetime

    from tickloom.streaming import runner

    now = datetime(2024, 1, 2, 1, 0, tzinfo=UTC)
    at = [int(now.timestamp()) - 60 * k for k in range(80, 0, -1)]

    def get(symbol, res, a, b):
        if symbol.endswith("BAD"):
            raise OSError("down")
        t = [x for x in at if a <= x < b]
        return {"s": "ok", "t": t, "o": [1.0] * len(t), "h": [2.0] * len(t), "l": [0.5] * len(t), "c": [1.5] * len(t)}

    root = str(tmp_path / "i")
    for _ in range(2):
        got = runner.cycle(spark, root, {"EURUSD": "forex", "BAD": "stock"}, get, now, derived=("5m", "1h"))
        assert got["EURUSD"] == "ok"
        assert B.read_parquet(spark, root, "EURUSD", "1m").count() == 80
    assert B.read_parquet(spark, root, "EURUSD", "1h").count() == 2
    assert runner.loop(lambda: {}, 0.0, 1) == 1


def test_grid_search_ranks(spark):
    b = make(spark, walk(400))
    sets = search.param_sets(spark, {"ema_fast": [3, 5], "ema_slow": [8, 13]}, {"tp_points": 0})
    got = search.grid_search(b, sets, "total_return").orderBy("rank").toPandas()
    assert got["combo_id"].nunique() == 4
    assert got["score"].is_monotonic_decreasing
    best = search.grid_search(b, sets, top_k=1)
    folds = search.walk_forward(b, best, 3).toPandas()
    assert sorted(folds["fold"]) == [0, 1, 2]
    assert search.walk_forward(b, best, 9).count() == 0  # under 50 bars a fold
    assert search.beats(1.0, 1.0) is False
    assert search.known_params({"a": 1}, {"a": 2, "b": 3}) == {"a": 2}


def test_failed_sets_rank_last(spark):
    def broken(s, p):
        if p["ema_fast"] == 3:
            raise ValueError("no")
        return search.ema_cross_signals(s, p)

    r = search.simulate_sets(make(spark, walk(60)), search.param_sets(spark, {"ema_fast": [3, 5]}), signals=broken)
    assert r.where("error IS NOT NULL").select("combo_id").distinct().count() == 1


# --- shapes -------------------------------------------------------------------------------------------------------------


def test_renko_reversal_needs_two(spark):
    p = renko.brick_path(np.array([100.0, 110, 120, 100, 130]), 10.0)
    assert p["price"].tolist() == [110, 120, 100, 120, 130]
    assert p["dir"].tolist() == [1, 1, -1, 1, 1]
    assert p["bars"].tolist() == [2, 2, 2, 2, 1]
    out = renko.renko(make(spark, [100, 110, 120, 100, 130]), 10.0).orderBy("bar_seq").toPandas()
    assert out["close"].tolist() == [120, 100, 120, 130]
    normal = renko.renko(make(spark, [100, 110, 120, 100, 130]), 10.0, "normal").orderBy("bar_seq").toPandas()
    assert normal["open"].tolist() == [110, 110, 110, 120]
    with pytest.raises(ValueError):
        renko.renko(make(spark, [1, 2]), 1.0, "odd")


def test_renko_closes_are_bricks_apart(spark):
    out = renko.renko(make(spark, walk(300)), 1.0).orderBy("bar_seq").toPandas()
    steps = out["close"].diff().dropna().abs()
    assert set(steps.round(6)) <= {1.0, 2.0}
    assert (out["high"] >= out[["open", "close"]].max(axis=1) - 1e-9).all()
    assert (out["low"] <= out[["open", "close"]].min(axis=1) + 1e-9).all()


def test_gap_bars(spark):
    b = make(spark, [(1, 2, 1, 2, 1), (2, 5, 2, 5, 1), (5, 6, 4, 5, 1), (5, 6, 4, 5, 1)])
    assert [r[0] for r in compact.compact_features(b).orderBy("bar_seq").select("is_fvg_bull").collect()] == [0, 0, 1, 0]
    assert [r[0] for r in structure.market_structure(b).orderBy("bar_seq").select("is_fvg_bullish").collect()] == [0, 0, 0, 1]


def test_swing_is_flagged_late(spark):
    up = [float(x) for x in [*range(1, 10), *range(8, 0, -1)]]
    got = structure.market_structure(make(spark, up)).where("is_pivot_high = 1").collect()
    assert [r["bar_seq"] for r in got] == [16]


def structure_twin(rows, period=50, swing=8):
    """The two-state machine, bar by bar."""
    o, h, l, c = (np.array([r[i] for r in rows]) for i in range(4))
    n = len(c)
    ph = [i for i in range(2 * swing, n) if h[i - swing] > h[i - 2 * swing : i - swing].max() and h[i - swing] >= h[i - swing + 1 : i + 1].max()]
    pl = [i for i in range(2 * swing, n) if l[i - swing] < l[i - 2 * swing : i - swing].min() and l[i - swing] <= l[i - swing + 1 : i + 1].min()]
    state, hi, lo, out = 0, None, None, [(0, 0, 0, 0, 0)] * min(period, n)
    for i in range(period, n):
        hs, ls = [x for x in ph if i - period < x < i], [x for x in pl if i - period < x < i]
        hi, lo = (h[hs[-1]] if hs else hi), (l[ls[-1]] if ls else lo)
        up = dn = bu = bd = 0
        if state == 0 and hi is not None and c[i] > hi:
            state, up = 1, 1
        elif state == 1 and lo is not None and c[i] < lo:
            state, dn = 0, 1
        if state == 1 and hi is not None and c[i] > hi * 1.001:
            bu = 1
        if state == 0 and lo is not None and c[i] < lo * 0.999:
            bd = 1
        out.append((state, up, dn, bu, bd))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_structure_against_a_plain_machine(spark, seed):
    rows = walk(260, seed)
    got = structure.market_structure(make(spark, rows)).orderBy("bar_seq").select("market_structure", "is_choch_bullish", "is_choch_bearish", "is_bos_bullish", "is_bos_bearish").collect()
    assert [tuple(r) for r in got] == structure_twin(rows)


def test_order_blocks_by_hand(spark):
    rows = walk(260, 4)
    g = structure.market_structure(make(spark, rows)).orderBy("bar_seq").toPandas()
    bull, bear = np.zeros(len(g), int), np.zeros(len(g), int)
    for i in g.index[(g.is_bos == 1) | (g.is_choch == 1)]:
        rising = g.is_bos_bullish[i] == 1 or g.is_choch_bullish[i] == 1
        for j in range(i - 1, max(0, i - 16) - 1, -1):
            if (rising and g.close[j] < g.open[j]) or (not rising and g.close[j] > g.open[j]):
                (bull if rising else bear)[j] = 1
                break
    assert (g.is_ob_bullish.to_numpy() == bull).all()
    assert (g.is_ob_bearish.to_numpy() == bear).all()


def test_features_do_not_look_ahead(spark):
    rows = walk(320, 5)
    a = compact.compact_features(make(spark, rows)).where("bar_seq < 250").orderBy("bar_seq").toPandas()
    b = compact.compact_features(make(spark, rows[:250])).orderBy("bar_seq").toPandas()
    pd.testing.assert_frame_equal(a, b)
    late = {"session_start_high_efficiency"}
    a = flags.flag_features(make(spark, rows, "1h"), "1h", ["trend", "candles", "ranges", "bands", "moves", "momentum"]).where("bar_seq < 250").orderBy("bar_seq").toPandas()
    b = flags.flag_features(make(spark, rows[:250], "1h"), "1h", ["trend", "candles", "ranges", "bands", "moves", "momentum"]).orderBy("bar_seq").toPandas()
    pd.testing.assert_frame_equal(a.drop(columns=[c for c in late if c in a]), b.drop(columns=[c for c in late if c in b]))


def test_flags_are_complete(spark):
    f = flags.flag_features(make(spark, walk(300, 6)), "1h")
    assert len(f.columns) - 4 >= 450
    p = f.drop("symbol", "tf", "ts", "bar_seq", "mtf_mixed_signals").toPandas()
    assert set(np.unique(p.to_numpy())) <= {0, 1}
    never = ["breakout_above_resistance_20", "in_fib_golden_zone_20", "above_session_high", "high_volume_efficiency"]
    assert p[never].sum().sum() == 0
    assert set(f.select("mtf_mixed_signals").toPandas()["mtf_mixed_signals"]) <= {-1, -2}


def test_head_and_shoulders_found():
    pts = [(0, 0), (10, 10), (15, 6), (25, 16), (35, 6.5), (42, 10.5), (60, 0)]
    x = np.arange(61)
    y = 100 + np.interp(x, *zip(*pts, strict=True))
    found = [p for p in chartpatterns.shoulders(y, 3, log_prices=False) if not p["inverted"]]
    assert len(found) == 1
    p = found[0]
    assert (p["l_shoulder"], p["head"], p["r_shoulder"]) == (10, 25, 42)
    assert p["pattern_r2"] > 0.95
    mirrored = [q for q in chartpatterns.shoulders(200 - y, 3, log_prices=False) if q["inverted"]]
    assert len(mirrored) == 1
    assert mirrored[0]["break_i"] == p["break_i"]


def test_doubles_by_plain_search(spark):
    rows = walk(200, 9)
    got = chartpatterns.doubles(make(spark, rows), 30, "both", 5.0, 0.1, 3).orderBy("bar_seq").toPandas()
    piv, pos = got["pivot"].to_numpy(), got["pivot_pos"].to_numpy(float)
    for i in range(len(got)):
        at = [j for j in range(max(0, i - 30), i + 1) if piv[j]] if i >= 30 else []
        v = [pos[j] for j in at]
        ok = len(at) == 5 and not np.isnan(v).any()
        top = ok and max(v[0], v[2], v[4]) < min(v[1], v[3]) and v[1] > v[3] and v[1] / v[3] <= 5 and v[1] / v[0] >= 1.012 and v[3] / v[2] >= 1.012
        bottom = ok and min(v[0], v[2], v[4]) > max(v[1], v[3]) and v[1] < v[3] and v[1] / v[3] >= 0.1
        assert got["double_type"][i] == ("bottoms" if bottom else "tops" if top else "")


# --- joins, filter, sources, spec, streams ---------------------------------------------------------------------------------


def test_asof_before_first_and_exact(spark):
    b = make(spark, [1, 2, 3])
    t = spark.sql("SELECT 'S' symbol, '1h' tf, timestamp_ntz'2023-12-31 00:00:00' t, 1 id UNION ALL SELECT 'S', '1h', timestamp_ntz'2024-01-01 01:00:00', 2 UNION ALL SELECT 'S', '1h', timestamp_ntz'2024-01-09 00:00:00', 3")
    got = {r["id"]: r["close"] for r in asof.asof(t, b, "t", "ts", ["symbol", "tf"], ["close"]).collect()}
    assert got == {1: None, 2: 2.0, 3: 3.0}


def test_split_sizes(spark):
    got = spark.createDataFrame([(9,), (10,), (30,)], "n long").select("n", tradefilter.split_at(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {9: 4, 10: 5, 30: 24}


def test_kept_and_dropped_are_all(spark, data):
    from tickloom.plans.queries import event_trades, hourly

    sweep = tradefilter.threshold_sweep(event_trades(spark, data), hourly(spark, data).select("symbol", "tf", "ts", "bar_seq"), ["symbol", "tf"]).toPandas()
    assert (sweep.groupby("symbol")[["kept", "dropped"]].sum().sum(axis=1) % 49 == 0).all()
    assert len(sweep) == 49 * sweep["symbol"].nunique()


def test_session_edges(spark):
    from tickloom.operators import insights

    hour = spark.range(24).select(F.col("id").alias("h"))
    got = {r["h"]: (r["a"], r["b"]) for r in hour.select("h", insights.session_of(F.col("h")).alias("a"), insights.rule_session_of(F.col("h")).alias("b")).collect()}
    assert got[22] == ("OffHrs", "Asian")
    assert got[12] == ("Overlap", "London")
    assert got[13] == ("Overlap", "Overlap")
    assert got[0] == ("Asia", "Asian")


def test_resample_is_associative(spark, data):
    five = B.event_bars(spark, data, "5m")
    a = B.resample(B.resample(five, "1h"), "4h").orderBy("symbol", "ts").toPandas()
    b = B.event_bars(spark, data, "4h").orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_store_upserts_once(spark, tmp_path):
    root = str(tmp_path / "bars")
    a = make(spark, [1, 2, 3])
    assert B.read_parquet(spark, root).count() == 0
    B.upsert(spark, root, a)
    b = make(spark, [1, 9, 3, 4]).where("bar_seq >= 1")
    for _ in range(2):
        B.upsert(spark, root, b)
    assert [r["close"] for r in B.read_parquet(spark, root, "s", "60min").orderBy("ts").collect()] == [1, 9, 3, 4]
    assert B.latest(B.read_parquet(spark, root)).first()["latest_ts"].hour == 3


def test_csv_forms(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(" DateTime ,Open,HIGH,low,close\n2024-01-01 00:05:00,1,2,0.5,1.5\nbad,1,1,1,1\n2024-01-01 00:05:00,3,3,3,3\n")
    rows = B.read_csv(spark, str(p), "xau", "5 min").collect()
    assert [(r["symbol"], r["tf"], r["close"], r["volume"]) for r in rows] == [("XAU", "5m", 3.0, 0.0)]
    q = tmp_path / "b.csv"
    q.write_text("timestamp,open,high,low,close,volume\n1704067200,1,2,0.5,1.5,7\n")
    assert B.read_csv(spark, str(q), "X", "1h").first()["volume"] == 7.0
    with pytest.raises(ValueError):
        B.normalise(spark.createDataFrame([(1,)], "timestamp long"), "X", "1h")


def test_feature_store(spark, tmp_path):
    root = str(tmp_path / "f")
    b = make(spark, walk(60))
    calls = []

    def compute(x):
        calls.append(1)
        return x.select("symbol", "tf", "ts", F.col("close").alias("f"))

    assert store.features_for(spark, root, b, compute).count() == 60
    assert store.features_for(spark, root, b.where("bar_seq < 50"), compute).count() == 50
    more = make(spark, walk(70))
    assert store.append_features(spark, root, more, compute, 20).count() == 70


def test_records(spark, tmp_path):
    r = Records(spark, str(tmp_path / "r"))
    mk = lambda k, i, p, n: spark.sql(f"SELECT '{k}' kind, '{i}' id, {p} parent, timestamp'2024-01-01 00:00:00' created, '{n}' name, '{{}}' body")
    r.put(mk("conversation", "1", "cast(null as string)", "a"))
    r.put(mk("message", "2", "'1'", "m"))
    r.put(mk("strategy", "3", "'1'", "s"))
    r.rename("conversation", "1", "b")
    assert r.get("conversation", "1").first()["name"] == "b"
    r.delete("conversation", "1", cascade="message")
    assert [(x["kind"], x["parent"]) for x in r.all().collect()] == [("strategy", None)]


def test_feed_chunks_and_failures(spark):
    from datetime import datetime

    now = datetime(2024, 1, 13)
    assert len(feed.chunks(now, 12)) == 3

    def get(symbol, res, a, b):
        if a > datetime(2024, 1, 10).timestamp():
            raise OSError("down")
        return {"s": "ok", "t": [a, a], "o": [1, 2], "h": [1, 2], "l": [1, 2], "c": [1, 2]}

    got = feed.fetch(spark, get, "EURUSD", "5m", "forex", now, 12).collect()
    assert len(got) == 2
    assert {r["close"] for r in got} == {1.0}


def test_parser():
    s = spec.parse("RSI 10 oversold on gold 15 min, past 2 months, levels 25 and 75")
    assert (s.template, s.timeframe, s.date_range["value"], s.date_range["unit"]) == ("rsi_mean_reversion", "15m", 2, "month")
    assert (s.parameters["rsi_period"], s.parameters["rsi_upper"]) == (10, 75)
    e = spec.parse("ema 5 13 crossover on renko, brick size 2.5, tp 5 points sl 3 points")
    assert e.chart == {"type": "renko", "mode": "wicks", "brick_size": 2.5}
    assert (e.parameters["ema_fast"], e.parameters["ema_slow"], e.parameters["tp_points"], e.stop_loss["value"]) == (5, 13, 5.0, 3.0)
    assert spec.parse("macd with stop loss").template == "macd_trend"
    assert spec.parse("macd 8 21 5").parameters["signal"] == 5
    assert spec.parse("macd 8 21").parameters["fast"] == 12
    a = spec.parse("Heikin Ashi 7 15 100 with stop loss, last 2 weeks of the past 1 year")
    assert (a.parameters["ema_trend"], a.stop_loss, a.date_range["unit"], a.date_range["value"]) == (100, {"type": "atr", "value": 1.5}, "year", 1)
    b = spec.parse("bb 20 with no gap renko, take profit = 12.5 pips, stop-loss of 4 pts")
    assert (b.template, b.parameters["bb_period"], b.chart["mode"], b.take_profit["value"], b.stop_loss["value"]) == ("bollinger_breakout", 20, "nongap", 12.5, 4.0)
    assert spec.date_range("everything") == {"type": "all", "value": None, "unit": None}
    assert spec.validate(spec.Spec(instrument="?", timeframe="7m")).timeframe == "5m"
    assert spec.intent("optimize", True) == "run_finder"
    assert spec.intent("optimize", False) is None
    assert spec.intent("run backtest", False) == "confirm"
    assert spec.intent("a long text that tells of a strategy at length", True) is None
    assert spec.indicator_hints({"rsi_14": 1.0, "adx": 3.0, "rsi_7": 2.0, "zz": 9.0}) == ["ADX (trend strength)", "RSI (momentum)"]
    assert spec.indicator_hints({"bb_pos": 5.0, "ema_8_21_diff_pct": 4.0, "is_fvg_bull": 3.0, "volume_ratio_20": 2.0}) == ["Bollinger Bands", "EMA distance / slope", "fair-value gap (SMC)", "volume"]
    assert spec.parse_range("1, 2.5,abc") == [1, 2.5, "abc"]
    out = spec.improvements(spec.Spec(), {"total_return_pct": 1, "sharpe_ratio": 0.5, "profit_factor": 1.5, "win_rate_pct": 30, "max_drawdown_pct": -9, "n_trades": 10})
    assert len(out["pros"]) + len(out["cons"]) <= 5
    assert {f["param"] for f in out["filters"]} == {"use_adx_filter", "use_sl_tp"}
    assert out["ranges"] == {"ema_fast": [5, 9, 12, 20], "ema_slow": [21, 26, 50, 100]}
    assert spec.improvements(spec.Spec(template="bollinger_breakout"), {})["ranges"] == strategies.get("bollinger_breakout").ranges


def test_rules_are_data_only(spark):
    b = make(spark, [1, 2])
    for bad in ({"left": "nope", "op": ">", "right": 1}, {"left": "close", "op": "exec", "right": 1}, {"left": ["x"], "op": ">", "right": 1}):
        with pytest.raises(ValueError):
            strategies.from_rules("x", {"long": bad}).signals(b)


def test_spec_runs(spark):
    s = spec.parse("ema 3 8 crossover")
    s.date_range = {"type": "relative", "value": 5, "unit": "day"}
    r = spec.backtest(s, make(spark, walk(300)))
    assert r.count() == 121


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import types as T

    b = make(spark, walk(60, 3))
    rows = b.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "close", "bar_seq")
    src = str(tmp_path / "in")
    for lo in (0, 20, 40):
        rows.where(f"bar_seq >= {lo} AND bar_seq < {lo + 20}").coalesce(1).write.mode("append").parquet(src)
    q = live.live_crosses(live.replay(spark, src, T.StructType(rows.schema.fields)), 3, 8).writeStream.format("memory").queryName("crosses").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["ts"]: r["signal"] for r in spark.table("crosses").collect()}
    want = strategies.get("ema_crossover").signals(b, {"ema_fast": 3, "ema_slow": 8}).select(F.col("ts").cast("timestamp").alias("ts"), "go_long", "go_short").collect()
    assert got == {r["ts"]: "buy" if r["go_long"] else "sell" if r["go_short"] else None for r in want}


def test_stream_upsert_and_bars(spark, data, tmp_path):
    root, src = str(tmp_path / "out"), str(tmp_path / "in")
    one = make(spark, walk(30), "1h")
    one.select("symbol", "tf", "ts", *B.PRICES).withColumn("arrival", F.lit(1)).coalesce(1).write.parquet(src)
    one.where("bar_seq >= 25").withColumn("close", F.lit(7.0)).select("symbol", "tf", "ts", *B.PRICES).withColumn("arrival", F.lit(2)).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    live.upsert_stream(live.replay(spark, src, schema), root, str(tmp_path / "ck"), ("4h",)).awaitTermination(180)
    got = B.read_parquet(spark, root, "S", "1h")
    assert got.count() == 30
    assert got.where("close = 7").count() == 5
    assert B.read_parquet(spark, root, "S", "4h").count() == 8
    ticks = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parque[t]")
    q = live.tumbling_bars(ticks.withColumn("ts", F.col("ts").cast("timestamp")), "1h", "event_type", "ts", "value", "event_id").writeStream.format("memory").queryName("tumble").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = {(r["symbol"], str(r["ts"])): r["close"] for r in B.event_bars(spark, data, "1h").collect()}
    stream = {(r["symbol"], str(r["ts"])): r["close"] for r in spark.table("tumble").collect()}
    assert stream
    assert all(batch[k] == v for k, v in stream.items())


def test_boosted_filter_learns_and_falls_back(spark):
    rows = spark.range(400).select(F.col("id").alias("trade_id"), ((F.hash("id") % 100) / 100.0).alias("x"), F.lit(None).cast("double").alias("y"), (F.col("id") < 320).alias("train"), F.lit(1.0).alias("trend_strength"), *[F.lit(0).alias(c) for c in ("smc_activity_score_5", "smc_activity_score_10", "is_bos_bullish", "is_bos_bearish")])
    rows = rows.withColumn("label", (F.col("x") > 0.2).cast("int"))
    model = tradefilter.train_boosted(rows, ["x", "y"], rounds=12, patience=4)
    got = tradefilter.boosted_scores(model, rows)
    assert got.count() == 400
    assert {r.train: r.accuracy for r in tradefilter.evaluate(got).collect()}[False] >= 0.95
    assert tradefilter.train_boosted(rows.limit(20), ["x", "y"]) is None
    assert tradefilter.train_boosted(rows.withColumn("label", F.lit(1)), ["x", "y"]) is None
    plain = tradefilter.boosted_scores(None, rows)
    assert {round(r.score, 6) for r in plain.collect()} == {round(0.5 + 1 / 12, 6)}
