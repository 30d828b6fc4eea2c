"""Every registered query of the market engine, and the SQL of those that SQL expresses.

Bars come from ``events`` (symbol: event type, price: value) by the hour unless
a query says otherwise. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.functions.order import rolling_order
from tickloom.operators import candles, chartpatterns, compact, features, flags, indicators, insights, longseries, metrics, renko, search, simulate, structure, tradefilter
from tickloom.operators.asof import asof, equity_from_trades
from tickloom.plans import ingest, spec, strategies
from tickloom.plans import sql as blocks
from tickloom.sources import bars as B
from tickloom.sources.store import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ["symbol", "tf"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.event_bars(spark, d, "1h")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return add


def with_bars(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_BARS} {body}"


def _bucket_sql(tf: str, table: str, symbol: str, ts: str, price: str, tie: str, step: str) -> str:
    return f"""{table}_{tf} AS MATERIALIZED (SELECT symbol, '{tf}' AS tf, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_seq, open, high, low, close, volume FROM (
  SELECT {symbol} AS symbol, time_bucket(INTERVAL '{step}', CAST({ts} AS TIMESTAMP), TIMESTAMP '1970-01-01') AS ts, first({price} ORDER BY {ts}, {tie}) AS open, max({price}) AS high, min({price}) AS low, last({price} ORDER BY {ts}, {tie}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {table} GROUP BY ALL))"""


_EV = ("events", "event_type", "ts", "value", "event_id")
_BARS = _bucket_sql("1h", *_EV, "1 hour") + ", bars AS (SELECT * FROM events_1h)"
_S = "PARTITION BY symbol ORDER BY bar_seq"


def _f(n: int, off: int = 0) -> str:
    return f"({_S} ROWS BETWEEN {n - 1 + off} PRECEDING AND {f'{off} PRECEDING' if off else 'CURRENT ROW'})"


def _full(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_f(n)} = {n} THEN {fn}({x}) OVER {_f(n)} END"


# --- bars -------------------------------------------------------------------------------------------------------------

_ALL = "symbol, tf, ts, bar_seq, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"
for _tf, _step in (("5m", "5 minutes"), ("1h", "1 hour"), ("4h", "4 hours")):
    query(f"bars_{_tf}", f"WITH {_bucket_sql(_tf, *_EV, _step)} SELECT {_ALL} FROM events_{_tf}")(lambda spark, d, tf=_tf: B.event_bars(spark, d, tf))
query("bars_daily_orders", f"WITH {_bucket_sql('1d', 'orders', 'o_orderpriority', 'o_orderdate', 'o_totalprice', 'o_orderkey', '1 day')} SELECT {_ALL} FROM orders_1d")(B.order_bars)

_4H = "r AS (SELECT symbol, '4h' AS tf, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 3)"
query("resample_4h", with_bars(f", {_4H} SELECT symbol, tf, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_seq, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM r"))(lambda spark, d: B.resample(hourly(spark, d), "4h"))
query("slice_inclusive", with_bars(f"SELECT {_ALL} FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'"))(lambda spark, d: B.time_slice(hourly(spark, d), "2024-01-05 00:00:00", "2024-01-12 00:00:00"))
query("slice_last_week", with_bars(f"SELECT {_ALL} FROM bars QUALIFY ts >= max(ts) OVER (PARTITION BY symbol) - INTERVAL '7 days'"))(lambda spark, d: B.relative_slice(hourly(spark, d), 1, "week"))
query("tail_50", with_bars(f"SELECT {_ALL} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_seq DESC) <= 50"))(lambda spark, d: B.tail(hourly(spark, d), 50))
query("downsample_100", with_bars(f"SELECT {_ALL} FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE bar_seq % greatest(1, n // 100) = 0 OR bar_seq = n - 1"))(lambda spark, d: B.downsample(hourly(spark, d), 100))
query("latest_ts", with_bars("SELECT symbol, tf, max(ts) AS latest_ts FROM bars GROUP BY 1, 2"))(lambda spark, d: B.latest(hourly(spark, d)))
query("symbols", "SELECT DISTINCT event_type AS symbol FROM events")(lambda spark, d: B.symbols(hourly(spark, d)))


@query("upsert_last_wins", with_bars(", n AS (SELECT symbol, tf, ts, open, high, low, close + 1 AS close, volume FROM bars WHERE bar_seq >= 100) SELECT symbol, tf, ts, bar_seq, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(CASE WHEN bar_seq >= 100 THEN close + 1 ELSE close END, 6) AS close, volume FROM bars WHERE bar_seq < 500 OR bar_seq >= 100"))
def _upsert(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d)
    return B.merge_last(b.where("bar_seq < 500"), b.where("bar_seq >= 100").withColumn("close", F.col("close") + 1))


# --- indicators -------------------------------------------------------------------------------------------------------


def _bare(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("symbol", "ts", *cols)


query("sma_20", with_bars(f"SELECT symbol, ts, round({_full('avg', 'close', 20)}, 6) AS sma FROM bars"))(lambda s, d: _bare(indicators.compute("sma", hourly(s, d)), "sma"))
query("wma_20", with_bars("SELECT symbol, ts, round((" + " + ".join(f"lag(close, {k}) OVER ({_S}) * {20 - k}" for k in range(20)) + ") / 210, 6) AS wma FROM bars"))(lambda s, d: _bare(indicators.compute("wma", hourly(s, d)), "wma"))
_M, _SD = _full("avg", "close", 20), _full("stddev_samp", "close", 20)
query("bollinger_20", with_bars(f"SELECT symbol, ts, round(m, 6) AS bb_middle, round(m + 2 * s, 6) AS bb_upper, round(m - 2 * s, 6) AS bb_lower, round(4 * s / nullif(m, 0), 6) AS bb_width FROM (SELECT *, {_M} AS m, {_SD} AS s FROM bars)"))(lambda s, d: _bare(indicators.compute("bollinger_bands", hourly(s, d)), "bb_middle", "bb_upper", "bb_lower", "bb_width"))
query("bollinger_20_blocks", SQL["bollinger_20"])(lambda s, d: _bare(W.in_blocks(hourly(s, d), lambda b: indicators.compute("bollinger_bands", b), back=19, block=100), "bb_middle", "bb_upper", "bb_lower", "bb_width"))
query("stochastic_14", with_bars(f", k AS (SELECT *, 100 * (close - {_full('min', 'low', 14)}) / nullif({_full('max', 'high', 14)} - {_full('min', 'low', 14)}, 0) AS k FROM bars) SELECT symbol, ts, round(k, 6) AS stoch_k, round({_full('avg', 'k', 3)}, 6) AS stoch_d FROM k"))(lambda s, d: _bare(indicators.compute("stochastic", hourly(s, d)), "stoch_k", "stoch_d"))
query("roc_12", with_bars(f"SELECT symbol, ts, round((close / nullif(lag(close, 12) OVER ({_S}), 0) - 1) * 100, 6) AS roc FROM bars"))(lambda s, d: _bare(indicators.compute("roc", hourly(s, d)), "roc"))
_DAY = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY bar_seq ROWS UNBOUNDED PRECEDING)"
query("vwap_day", with_bars(f"SELECT symbol, ts, round(sum((high + low + close) / 3 * volume) OVER {_DAY} / nullif(sum(volume) OVER {_DAY}, 0), 6) AS vwap FROM bars"))(lambda s, d: _bare(indicators.compute("vwap", hourly(s, d)), "vwap"))
query("obv", with_bars(f"SELECT symbol, ts, round(sum(x) OVER ({_S} ROWS UNBOUNDED PRECEDING), 6) AS obv FROM (SELECT *, coalesce(sign(close - lag(close) OVER ({_S})), 0) * volume AS x FROM bars)"))(lambda s, d: _bare(indicators.compute("obv", hourly(s, d)), "obv"))
_TR = f"greatest(high - low, abs(high - lag(close) OVER ({_S})), abs(low - lag(close) OVER ({_S})))"
query("true_range", with_bars(f"SELECT symbol, ts, round({_TR}, 6) AS true_range FROM bars"))(lambda s, d: hourly(s, d).select("symbol", "ts", indicators.true_range().alias("true_range")))
query("rolling_quantile", with_bars(f"SELECT symbol, ts, round(CASE WHEN count(close) OVER {_f(50)} = 50 THEN quantile_cont(close, 0.7) OVER {_f(50)} END, 6) AS q FROM bars"))(lambda s, d: rolling_order(hourly(s, d), "close", {"q": ("quantile", 50, 0.7)}).select("symbol", "ts", "q"))
query("rolling_rank", with_bars(f"SELECT symbol, ts, round(CASE WHEN len(x) = 50 THEN (len(list_filter(x, lambda v: v < close)) + (len(list_filter(x, lambda v: v = close)) + 1) / 2) / 50 END, 6) AS r FROM (SELECT *, list(close) OVER {_f(50)} AS x FROM bars)"))(lambda s, d: rolling_order(hourly(s, d), "close", {"r": ("rank", 50)}).select("symbol", "ts", "r"))
query("forward_fill", with_bars(f"SELECT symbol, ts, round(last_value(CASE WHEN bar_seq % 3 = 0 THEN close END IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING), 6) AS x FROM bars"))(lambda s, d: hourly(s, d).select("symbol", "ts", W.forward_fill(F.when(F.col("bar_seq") % 3 == 0, F.col("close"))).alias("x")))

_D = f", d AS MATERIALIZED (SELECT *, lag(close) OVER ({_S}) AS pc, close - lag(close) OVER ({_S}) AS dc, {_TR} AS tr, high - lag(high) OVER ({_S}) AS up, lag(low) OVER ({_S}) - low AS dn FROM bars)"


def _walk(start: str, step: str, out: str, more: str = "") -> str:
    """A recursion along each series: e is the state so far, b the next bar."""
    return with_bars(f"{_D}, e AS (SELECT symbol, ts, bar_seq, {start} FROM d b WHERE bar_seq = 0 UNION ALL SELECT b.symbol, b.ts, b.bar_seq, {step} FROM e JOIN d b ON b.symbol = e.symbol AND b.bar_seq = e.bar_seq + 1){more} SELECT symbol, ts, {out} FROM e", True)


def _ew(n: str, a: str, x: str) -> str:
    return f"e.{n} + ({a}) * ({x} - e.{n})"


def _first(n: str, a: str, x: str) -> str:
    """As _ew, where the first value may be null."""
    return f"CASE WHEN e.{n} IS NULL THEN {x} ELSE {_ew(n, a, x)} END"


query("ema_9", _walk("close AS v", _ew("v", "0.2", "b.close"), "round(v, 6) AS ema"))(lambda s, d: _bare(indicators.compute("ema", hourly(s, d), period=9), "ema"))
query("ema_9_blocks", _walk("close AS v", _ew("v", "0.2", "b.close"), "round(v, 6) AS ema"))(lambda s, d: _bare(longseries.ewma_blocks(hourly(s, d), "close", 0.2, "ema", 100), "ema"))
query("rsi_14", _walk("NULL::DOUBLE AS g, NULL::DOUBLE AS l", f"{_first('g', '1.0/14', 'greatest(b.dc, 0)')}, {_first('l', '1.0/14', 'greatest(-b.dc, 0)')}", "round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS rsi"))(lambda s, d: _bare(indicators.compute("rsi", hourly(s, d)), "rsi"))
query("macd", _walk("close AS f, close AS s, 0.0::DOUBLE AS g", f"{_ew('f', '2.0/13', 'b.close')}, {_ew('s', '2.0/27', 'b.close')}, e.g + 0.2 * (({_ew('f', '2.0/13', 'b.close')}) - ({_ew('s', '2.0/27', 'b.close')}) - e.g)", "round(f - s, 6) AS macd, round(g, 6) AS macd_signal, round(f - s - g, 6) AS macd_hist"))(lambda s, d: _bare(indicators.compute("macd", hourly(s, d)), "macd", "macd_signal", "macd_hist"))
query("atr_14", _walk("tr AS v", _ew("v", "1.0/14", "b.tr"), "round(v, 6) AS atr"))(lambda s, d: _bare(indicators.compute("atr", hourly(s, d)), "atr"))
query("keltner_20", _walk("close AS m, tr AS v", f"{_ew('m', '2.0/21', 'b.close')}, {_ew('v', '1.0/20', 'b.tr')}", "round(m, 6) AS kc_middle, round(m + 2 * v, 6) AS kc_upper, round(m - 2 * v, 6) AS kc_lower"))(lambda s, d: _bare(indicators.compute("keltner_channel", hourly(s, d)), "kc_middle", "kc_upper", "kc_lower"))
_P = "CASE WHEN b.up > b.dn AND b.up > 0 THEN b.up ELSE 0 END"
_N = "CASE WHEN b.dn > b.up AND b.dn > 0 THEN b.dn ELSE 0 END"
_PE, _NE = _first("p", "1.0/14", _P), _first("n", "1.0/14", _N)
_DX = f"100 * abs(({_PE}) - ({_NE})) / nullif(({_PE}) + ({_NE}), 0)"
query("adx_14", _walk("tr AS v, NULL::DOUBLE AS p, NULL::DOUBLE AS n, NULL::DOUBLE AS x", f"{_ew('v', '1.0/14', 'b.tr')}, {_PE}, {_NE}, CASE WHEN ({_DX}) IS NULL THEN e.x WHEN e.x IS NULL THEN {_DX} ELSE e.x + (1.0/14) * ({_DX} - e.x) END", "round(x, 5) AS adx, round(100 * p / nullif(v, 0), 5) AS plus_di, round(100 * n / nullif(v, 0), 5) AS minus_di"))(lambda s, d: rounded(_bare(indicators.compute("adx", hourly(s, d)), "adx", "plus_di", "minus_di"), 5))
_UP, _LO = "(b.high + b.low) / 2 + 3 * (e.v + 0.1 * (b.tr - e.v))", "(b.high + b.low) / 2 - 3 * (e.v + 0.1 * (b.tr - e.v))"
_FU, _FL = f"CASE WHEN {_UP} < e.fu OR b.pc > e.fu THEN {_UP} ELSE e.fu END", f"CASE WHEN {_LO} > e.fl OR b.pc < e.fl THEN {_LO} ELSE e.fl END"
query("supertrend_10", _walk("tr AS v, (high + low) / 2 + 3 * tr AS fu, (high + low) / 2 - 3 * tr AS fl, 1 AS dir", f"e.v + 0.1 * (b.tr - e.v), {_FU}, {_FL}, CASE WHEN b.close > e.fu THEN 1 WHEN b.close < e.fl THEN -1 ELSE e.dir END", "round(CASE WHEN bar_seq = 0 THEN NULL WHEN dir = 1 THEN fl ELSE fu END, 6) AS supertrend, CAST(dir AS DOUBLE) AS supertrend_dir"))(lambda s, d: _bare(indicators.compute("supertrend", hourly(s, d)), "supertrend", "supertrend_dir"))
_HC = "(b.open + b.high + b.low + b.close) / 4"
query("heikin_ashi", _walk("(open + close) / 2 AS o, (open + high + low + close) / 4 AS c, high AS h, low AS l", f"(e.o + e.c) / 2, {_HC}, b.high, b.low", "round(o, 6) AS ha_open, round(greatest(h, o, c), 6) AS ha_high, round(least(l, o, c), 6) AS ha_low, round(c, 6) AS ha_close"))(lambda s, d: _bare(candles.heikin_ashi(hourly(s, d)), "ha_open", "ha_high", "ha_low", "ha_close"))
query("kalman", _walk("close AS x, 1.0::DOUBLE AS p", "e.x + (e.p + 0.01) / (e.p + 1.01) * (b.close - e.x), (e.p + 0.01) * (1 - (e.p + 0.01) / (e.p + 1.01))", "round(x, 6) AS kalman"))(lambda s, d: _bare(indicators.per_series(hourly(s, d), lambda x: {"kalman": flags.K.kalman(x["close"])}, ["kalman"]), "kalman"))

# --- candles, pivots, patterns ------------------------------------------------------------------------------------------

_L = f", l AS (SELECT *, lag(open) OVER ({_S}) AS o1, lag(close) OVER ({_S}) AS c1, lag(high) OVER ({_S}) AS h1, lag(low) OVER ({_S}) AS l1, lag(high, 2) OVER ({_S}) AS h2, lag(low, 2) OVER ({_S}) AS l2 FROM bars)"
query("engulfing", with_bars(f"{_L} SELECT symbol, ts, coalesce(c1 < o1 AND close > open AND open < c1 AND close > o1, false) AS bullish_engulfing, coalesce(c1 > o1 AND close < open AND open > c1 AND close < o1, false) AS bearish_engulfing FROM l"))(lambda s, d: hourly(s, d).select("symbol", "ts", candles.bullish_engulfing().alias("bullish_engulfing"), candles.bearish_engulfing().alias("bearish_engulfing")))
_BODY = "(CASE WHEN open = close THEN 1e-9 ELSE abs(close - open) END)"
query("pin_bar", with_bars(f"SELECT symbol, ts, (least(open, close) - low) / {_BODY} >= 2 AND high - greatest(open, close) < {_BODY} AS bullish, (high - greatest(open, close)) / {_BODY} >= 2 AND least(open, close) - low < {_BODY} AS bearish FROM bars"))(lambda s, d: hourly(s, d).select("symbol", "ts", candles.pin_bar("bullish").alias("bullish"), candles.pin_bar("bearish").alias("bearish")))
_W11 = f"({_S} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
query("pivots", with_bars(f"SELECT symbol, ts, count(*) OVER {_W11} = 11 AND high = max(high) OVER {_W11} AS high_pivot, count(*) OVER {_W11} = 11 AND low = min(low) OVER {_W11} AS low_pivot FROM bars"))(lambda s, d: hourly(s, d).select("symbol", "ts", candles.pivot("high").alias("high_pivot"), candles.pivot("low").alias("low_pivot")))
query("pivots_blocks", SQL["pivots"])(lambda s, d: W.in_blocks(hourly(s, d), lambda b: b.withColumns({"high_pivot": candles.pivot("high"), "low_pivot": candles.pivot("low")}), back=5, ahead=5, block=64).select("symbol", "ts", "high_pivot", "low_pivot"))
query("turning_points", with_bars(f"SELECT symbol, ts, coalesce(lag(close, 3) OVER ({_S}) = max(close) OVER {_f(7)} AND bar_seq >= 7, false) AS top, coalesce(lag(close, 3) OVER ({_S}) = min(close) OVER {_f(7)} AND bar_seq >= 7, false) AS bottom FROM bars"))(lambda s, d: hourly(s, d).select("symbol", "ts", chartpatterns.turning("top", 3).alias("top"), chartpatterns.turning("bottom", 3).alias("bottom")))
_W7 = f"({_S} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
query("pivot_classes", with_bars(f", p AS (SELECT *, CAST(count(*) OVER {_W7} = 7 AND low = min(low) OVER {_W7} AS INT) + 2 * CAST(count(*) OVER {_W7} = 7 AND high = max(high) OVER {_W7} AS INT) AS pv FROM bars) SELECT symbol, ts, pv AS pivot_class, round(CASE pv WHEN 1 THEN low - 0.001 WHEN 2 THEN high + 0.001 END, 6) AS pivot_pos FROM p"))(lambda s, d: chartpatterns.pivots(hourly(s, d)).select("symbol", "ts", F.col("pivot").alias("pivot_class"), "pivot_pos"))
_DBL = f", p AS (SELECT *, CAST(count(*) OVER {_W7} = 7 AND low = min(low) OVER {_W7} AS INT) + 2 * CAST(count(*) OVER {_W7} = 7 AND high = max(high) OVER {_W7} AS INT) AS pv FROM bars), g AS (SELECT *, list_filter(list(CASE WHEN pv <> 0 THEN {{'p': CASE pv WHEN 1 THEN low - 0.001 WHEN 2 THEN high + 0.001 END}} END) OVER {_f(31)}, lambda v: v IS NOT NULL) AS x FROM p), v AS (SELECT *, x[1].p AS a, x[2].p AS b, x[3].p AS c, x[4].p AS d, x[5].p AS e, bar_seq >= 30 AND len(x) = 5 AS five FROM g)"
query("double_types", with_bars(f"{_DBL} SELECT symbol, ts, CASE WHEN coalesce(five AND b < d AND b / d >= 0.1 AND least(a, c, e) > greatest(b, d) AND a + c + e IS NOT NULL, false) THEN 'bottoms' WHEN coalesce(five AND b > d AND b / d <= 5 AND b / a >= 1.012 AND d / c >= 1.012 AND greatest(a, c, e) < least(b, d) AND a + c + e IS NOT NULL, false) THEN 'tops' ELSE '' END AS double_type FROM v"))(lambda s, d: _bare(chartpatterns.doubles(hourly(s, d), lookback=30, kind="both", count=3, tops_max_ratio=5.0, bottoms_min_ratio=0.1), "double_type"))
query("double_tops_bottoms")(lambda s, d: _bare(chartpatterns.doubles(hourly(s, d), lookback=30, kind="both", count=3, tops_max_ratio=5.0, bottoms_min_ratio=0.1), "double_type", "chart_type", "double_idx", "double_point"))
query("head_shoulders")(lambda s, d: chartpatterns.head_shoulders(hourly(s, d), 3))
query("head_shoulders_early")(lambda s, d: chartpatterns.head_shoulders(hourly(s, d), 3, early=True, log_prices=False))
for _mode in renko.MODES:
    query(f"renko_{_mode.replace('-', '_')}")(lambda s, d, m=_mode: renko.renko(hourly(s, d), 20.0, m))
query("renko_auto")(lambda s, d: renko.renko(hourly(s, d)))

# --- features -----------------------------------------------------------------------------------------------------------

_SWING = f", p AS (SELECT *, CAST(coalesce(bar_seq >= 16 AND lag(high, 8) OVER ({_S}) > max(high) OVER {_f(8, 9)} AND lag(high, 8) OVER ({_S}) >= max(high) OVER {_f(8)}, false) AS INT) AS is_pivot_high, CAST(coalesce(bar_seq >= 16 AND lag(low, 8) OVER ({_S}) < min(low) OVER {_f(8, 9)} AND lag(low, 8) OVER ({_S}) <= min(low) OVER {_f(8)}, false) AS INT) AS is_pivot_low FROM bars), q AS (SELECT *, last_value(CASE WHEN is_pivot_high = 1 THEN high END IGNORE NULLS) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, last_value(CASE WHEN is_pivot_low = 1 THEN low END IGNORE NULLS) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl, list(CASE WHEN is_pivot_high = 1 THEN high END) OVER ({_S} ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS hs, list(CASE WHEN is_pivot_low = 1 THEN low END) OVER ({_S} ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS ls FROM p)"
query("structure_swings", with_bars(f"{_SWING} SELECT symbol, ts, is_pivot_high, is_pivot_low, CAST(coalesce(is_pivot_high = 1 AND high > ph, false) AS INT) AS is_hh, CAST(coalesce(is_pivot_high = 1 AND high <= ph, false) AS INT) AS is_lh, CAST(coalesce(is_pivot_low = 1 AND low > pl, false) AS INT) AS is_hl, CAST(coalesce(is_pivot_low = 1 AND low <= pl, false) AS INT) AS is_ll, CAST(coalesce(len(list_filter(hs, lambda v: v IS NOT NULL AND high > v AND close < v)) > 0, false) AS INT) AS is_sweep_bearish, CAST(coalesce(len(list_filter(ls, lambda v: v IS NOT NULL AND low < v AND close > v)) > 0, false) AS INT) AS is_sweep_bullish FROM q"))(lambda s, d: _bare(structure.market_structure(hourly(s, d)), "is_pivot_high", "is_pivot_low", "is_hh", "is_lh", "is_hl", "is_ll", "is_sweep_bearish", "is_sweep_bullish"))
_NEAR = "last_value(CASE WHEN is_pivot_{0} = 1 THEN {0} END IGNORE NULLS) OVER (" + _S + " ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)"
_BREAKS = f"{_SWING}, n AS (SELECT *, CASE WHEN bar_seq >= 50 THEN {_NEAR.format('high')} END AS nh, CASE WHEN bar_seq >= 50 THEN {_NEAR.format('low')} END AS nl FROM q), x AS MATERIALIZED (SELECT symbol, ts, bar_seq, close, last_value(nh IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS hi, last_value(nl IGNORE NULLS) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS lo FROM n), e AS (SELECT *, 0 AS st, 0 AS was FROM x WHERE bar_seq = 0 UNION ALL SELECT x.symbol, x.ts, x.bar_seq, x.close, x.hi, x.lo, CASE WHEN e.st = 0 AND x.close > x.hi THEN 1 WHEN e.st = 1 AND x.close < x.lo THEN 0 ELSE e.st END, e.st FROM e JOIN x ON x.symbol = e.symbol AND x.bar_seq = e.bar_seq + 1)"
query("structure_breaks", with_bars(f"{_BREAKS} SELECT symbol, ts, st AS market_structure, CAST(st = 1 AND was = 0 AS INT) AS is_choch_bullish, CAST(st = 0 AND was = 1 AS INT) AS is_choch_bearish, CAST(coalesce(st = 1 AND close > hi * 1.001, false) AS INT) AS is_bos_bullish, CAST(coalesce(st = 0 AND close < lo * 0.999, false) AS INT) AS is_bos_bearish FROM e", True))(lambda s, d: _bare(structure.market_structure(hourly(s, d)), "market_structure", "is_choch_bullish", "is_choch_bearish", "is_bos_bullish", "is_bos_bearish"))
query("structure_features")(lambda s, d: structure.market_structure(hourly(s, d)))
query("structure_summary")(lambda s, d: structure.feature_summary(structure.market_structure(hourly(s, d)), ["is_pivot_high", "is_pivot_low", "is_hh", "is_ll", "is_choch", "is_bos", "is_idm", "is_ob", "is_sweep", "is_fvg"]))
query("compact_features")(lambda s, d: compact.compact_features(hourly(s, d)))
query("compact_time_candle", with_bars("SELECT symbol, ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) < 7 AS INT) AS session_asia, CAST(hour(ts) >= 7 AND hour(ts) < 12 AS INT) AS session_london, CAST(hour(ts) >= 12 AND hour(ts) < 16 AS INT) AS session_overlap, CAST(hour(ts) >= 16 AND hour(ts) < 22 AS INT) AS session_ny, CAST(close > open AS INT) AS is_bullish_candle, CAST(close < open AS INT) AS is_bearish_candle FROM bars"))(lambda s, d: _bare(compact.compact_features(hourly(s, d)), "hour", "weekday", "session_asia", "session_london", "session_overlap", "session_ny", "is_bullish_candle", "is_bearish_candle"))
query("flags_all")(lambda s, d: flags.flag_features(hourly(s, d), "1h"))
for _fam in flags.FAMILIES:
    query(f"flags_{_fam}")(lambda s, d, f=_fam: flags.flag_features(hourly(s, d), "1h", [f]))
_I = "CAST(coalesce({}, false) AS INT) AS {}"
query("flags_gaps", with_bars(f"{_L} SELECT symbol, ts, " + ", ".join(_I.format(c, n) for n, c in {"gap_up": "low > h1", "gap_down": "high < l1", "no_gap": "low <= h1 AND high >= l1", "inside_bar": "high <= h1 AND low >= l1", "outside_bar": "high >= h1 AND low <= l1", "bullish_fvg_present": "low > h2 AND l1 > h2", "bearish_fvg_present": "high < l2 AND h1 < l2", "small_body": "abs(close - open) / nullif(high - low, 0) < 0.3", "doji_candle": "abs(close - open) / nullif(high - low, 0) < 0.1"}.items()) + " FROM l"))(lambda s, d: _bare(flags.flag_features(hourly(s, d), "1h", ["candles"]), "gap_up", "gap_down", "no_gap", "inside_bar", "outside_bar", "bullish_fvg_present", "bearish_fvg_present", "small_body", "doji_candle"))
_HL = ", ".join(f"CASE WHEN bar_seq >= {n - 1} THEN max(high) OVER {_f(n)} END AS hh{n}, CASE WHEN bar_seq >= {n - 1} THEN min(low) OVER {_f(n)} END AS ll{n}" for n in (20, 50))
query("flags_breaks", with_bars(f", x AS (SELECT *, {_HL}, lag(close) OVER ({_S}) AS c1 FROM bars), y AS (SELECT *, " + ", ".join(f"lag({v}{n}) OVER ({_S}) AS {v}{n}p" for n in (20, 50) for v in ("hh", "ll")) + f" FROM x) SELECT symbol, ts, " + ", ".join(_I.format(c, m) for n in (20, 50) for m, c in {f"structure_break_bullish_{n}": f"close > hh{n}p AND c1 <= hh{n}p", f"structure_break_bearish_{n}": f"close < ll{n}p AND c1 >= ll{n}p", f"failed_breakout_above_{n}": f"high > hh{n}p AND close < hh{n}p", f"strong_breakout_above_{n}": f"close > hh{n}p + 0.1 * (hh{n}p - ll{n}p)", f"in_upper_range_{n}": f"(close - ll{n}) / nullif(hh{n} - ll{n}, 0) > 0.66"}.items()) + " FROM y"))(lambda s, d: _bare(flags.flag_features(hourly(s, d), "1h", ["ranges"]), *[f"{k}_{n}" for n in (20, 50) for k in ("structure_break_bullish", "structure_break_bearish", "failed_breakout_above", "strong_breakout_above", "in_upper_range")]))

# --- trades of pairs of events, that SQL can make too ----------------------------------------------------------------------


def event_trades(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's events in time order, paired: in at the first price, out at the second; the user's parity is the side."""
    w = W.Window.partitionBy("symbol").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", "value")
    e = e.withColumns({"k": F.row_number().over(w) - 1, "xt": F.lead("ts").over(w), "xp": F.lead("value").over(w)}).where((F.col("k") % 2 == 0) & F.col("xt").isNotNull())
    sign = F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(-1.0)
    pts = sign * (F.col("xp") - F.col("value"))
    return e.select("symbol", F.lit("1h").alias("tf"), F.floor(F.col("k") / 2).cast("long").alias("trade_id"), F.when(F.col("user_id") % 2 == 0, "long").otherwise("short").alias("side"), F.col("ts").alias("entry_time"), F.col("value").alias("entry_price"), F.col("xt").alias("exit_time"), F.col("xp").alias("exit_price"), pts.alias("pnl"), pts.alias("points"), ((F.col("event_id") % 100) / 100.0).alias("score"))


_T = "e AS (SELECT event_type AS symbol, ts, event_id, user_id, value, row_number() OVER w - 1 AS k, lead(ts) OVER w AS xt, lead(value) OVER w AS xp FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)), t AS MATERIALIZED (SELECT symbol, '1h' AS tf, k // 2 AS trade_id, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, ts AS entry_time, xt AS exit_time, (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) * (xp - value) AS pnl, (event_id % 100) / 100.0 AS score FROM e WHERE k % 2 = 0 AND xt IS NOT NULL)"
_PF = "round(CASE WHEN coalesce(sum(pnl) FILTER (pnl < 0), 0) <> 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0)) WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 999.0 ELSE 0.0 END, 6)"
query("trade_metrics", f"WITH {_T} SELECT symbol, count(*) AS n_trades, count(*) FILTER (side = 'long') AS long_trades, count(*) FILTER (side = 'short') AS short_trades, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate_pct, round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 6) AS avg_loss, round(avg(pnl), 6) AS avg_trade, round(max(pnl), 6) AS best_trade, round(min(pnl), 6) AS worst_trade, {_PF} AS profit_factor FROM t GROUP BY 1")(lambda s, d: metrics.trade_metrics(event_trades(s, d), ["symbol"]).select("symbol", "n_trades", "long_trades", "short_trades", "win_rate_pct", "avg_win", "avg_loss", "avg_trade", "best_trade", "worst_trade", "profit_factor"))
query("monthly_rollup", f"WITH {_T} SELECT symbol, strftime(entry_time, '%Y-%m') AS month, count(*) AS trades, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate_pct, round(sum(pnl), 6) AS total_points FROM t GROUP BY 1, 2")(lambda s, d: insights.monthly(event_trades(s, d), ["symbol"]))
_B = "SELECT symbol, 'session' AS kind, CASE WHEN hour(entry_time) < 7 THEN 'Asia' WHEN hour(entry_time) < 12 THEN 'London' WHEN hour(entry_time) < 16 THEN 'Overlap' WHEN hour(entry_time) < 22 THEN 'NewYork' ELSE 'OffHrs' END AS bucket, pnl FROM t UNION ALL SELECT symbol, 'hour', CAST(hour(entry_time) AS VARCHAR), pnl FROM t UNION ALL SELECT symbol, 'weekday', ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(entry_time)], pnl FROM t"
query("session_breakdown", f"WITH {_T}, x AS ({_B}), k AS (SELECT 'session' AS kind, unnest(['Asia','London','Overlap','NewYork','OffHrs']) AS bucket UNION ALL SELECT 'hour', CAST(unnest(range(24)) AS VARCHAR) UNION ALL SELECT 'weekday', unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])) SELECT s.symbol, k.kind, k.bucket, count(pnl) AS n_trades, round(coalesce(100.0 * count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 0), 6) AS win_rate_pct, round(coalesce(sum(pnl), 0), 6) AS total_pnl, round(coalesce(avg(pnl), 0), 6) AS avg_trade, round(coalesce(max(pnl), 0), 6) AS best_trade, round(coalesce(min(pnl), 0), 6) AS worst_trade, {_PF} AS profit_factor, round(coalesce(avg(pnl), 0), 6) AS expectancy FROM (SELECT DISTINCT symbol FROM t) s CROSS JOIN k LEFT JOIN x ON x.symbol = s.symbol AND x.kind = k.kind AND x.bucket = k.bucket GROUP BY 1, 2, 3")(lambda s, d: insights.session_breakdown(event_trades(s, d), ["symbol"]))
_RB = "SELECT symbol, 'session' AS kind, CASE WHEN hour(entry_time) BETWEEN 8 AND 12 THEN 'London' WHEN hour(entry_time) BETWEEN 13 AND 15 THEN 'Overlap' WHEN hour(entry_time) BETWEEN 16 AND 21 THEN 'US' ELSE 'Asian' END AS bucket, pnl FROM t UNION ALL SELECT symbol, 'hour', CAST(hour(entry_time) AS VARCHAR), pnl FROM t UNION ALL SELECT symbol, 'weekday', ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(entry_time)], pnl FROM t"
query("rule_insights", f"WITH {_T}, x AS ({_RB}), k AS (SELECT 'session' AS kind, unnest(['Asian','London','Overlap','US']) AS bucket UNION ALL SELECT 'hour', CAST(unnest(range(24)) AS VARCHAR) UNION ALL SELECT 'weekday', unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])), b AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) / count(*) AS wr FROM t GROUP BY 1) SELECT b.symbol, k.kind, k.bucket, count(pnl) AS trades, round(coalesce(100.0 * count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 0), 6) AS win_rate_pct, round(CASE WHEN count(pnl) > 0 THEN (count(*) FILTER (pnl > 0) / count(pnl) - any_value(b.wr)) * 100 ELSE 0 END, 6) AS improvement_vs_base_pct, round(100.0 * count(pnl) / any_value(b.n), 6) AS retention_pct, round(coalesce(avg(pnl), 0), 6) AS avg_points FROM b CROSS JOIN k LEFT JOIN x ON x.symbol = b.symbol AND x.kind = k.kind AND x.bucket = k.bucket GROUP BY 1, 2, 3")(lambda s, d: insights.rule_insights(event_trades(s, d), ["symbol"]))
query("insight_rules")(lambda s, d: insights.insight_rules(insights.rule_insights(event_trades(s, d), ["symbol"]), ["symbol"]))
query("asof_trades", with_bars(f", {_T} SELECT t.symbol, t.trade_id, round(b.close, 6) AS close, b.bar_seq FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.entry_time >= b.ts"))(lambda s, d: asof(event_trades(s, d), hourly(s, d), "entry_time", "ts", KEYS, ["close", "bar_seq"]).select("symbol", "trade_id", "close", "bar_seq"))
query("equity_from_trades", with_bars(f", {_T}, p AS (SELECT t.symbol, coalesce(b.bar_seq, 0) AS bar_seq, sum(t.pnl) AS pnl FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.exit_time >= b.ts GROUP BY 1, 2) SELECT b.symbol, b.ts, b.bar_seq, round(100000 + coalesce(sum(p.pnl) OVER (PARTITION BY b.symbol ORDER BY b.bar_seq ROWS UNBOUNDED PRECEDING), 0), 4) AS equity FROM bars b LEFT JOIN p ON p.symbol = b.symbol AND p.bar_seq = b.bar_seq"))(lambda s, d: rounded(equity_from_trades(event_trades(s, d), hourly(s, d), KEYS).drop("tf"), 4))
query("technical_insights")(lambda s, d: insights.technical_insights(event_trades(s, d), insights.entry_features(hourly(s, d))))
query("insight_highlights")(lambda s, d: insights.highlights(insights.technical_insights(event_trades(s, d), insights.entry_features(hourly(s, d)))))
query("spotlights")(lambda s, d: insights.spotlights(insights.rule_insights(event_trades(s, d), KEYS), insights.technical_insights(event_trades(s, d), insights.entry_features(hourly(s, d))), event_trades(s, d)))

# --- strategies, simulation, search, filter ----------------------------------------------------------------------------------

for _name in strategies.REGISTRY:
    query(f"signals_{_name}")(lambda s, d, n=_name: strategies.get(n).signals(hourly(s, d)).select("symbol", "ts", *strategies.SIGNALS))
    query(f"backtest_{_name}")(lambda s, d, n=_name: metrics.backtest_metrics(simulate.simulate(strategies.get(n).signals(hourly(s, d)))))
_X = "c AS (SELECT symbol, ts, bar_seq, f, s, lag(f) OVER (PARTITION BY symbol ORDER BY bar_seq) AS pf, lag(s) OVER (PARTITION BY symbol ORDER BY bar_seq) AS ps FROM e)"
query("ema_cross_signals", with_bars(f"{_D}, e AS (SELECT symbol, ts, bar_seq, close AS f, close AS s FROM d WHERE bar_seq = 0 UNION ALL SELECT b.symbol, b.ts, b.bar_seq, {_ew('f', '0.2', 'b.close')}, {_ew('s', '2.0/22', 'b.close')} FROM e JOIN d b ON b.symbol = e.symbol AND b.bar_seq = e.bar_seq + 1), {_X} SELECT symbol, ts, coalesce(bar_seq >= 22 AND f > s AND pf <= ps, false) AS go_long, coalesce(bar_seq >= 22 AND f < s AND pf >= ps, false) AS go_short FROM c", True))(lambda s, d: strategies.get("ema_crossover").signals(hourly(s, d)).select("symbol", "ts", "go_long", "go_short"))
_POS = f"{_D}, e AS (SELECT symbol, ts, bar_seq, close AS f, close AS s FROM d WHERE bar_seq = 0 UNION ALL SELECT b.symbol, b.ts, b.bar_seq, {_ew('f', '0.2', 'b.close')}, {_ew('s', '2.0/22', 'b.close')} FROM e JOIN d b ON b.symbol = e.symbol AND b.bar_seq = e.bar_seq + 1), {_X}, g AS MATERIALIZED (SELECT c.*, b.close, coalesce(c.bar_seq >= 22 AND f > s AND pf <= ps, false) AS up, coalesce(c.bar_seq >= 22 AND f < s AND pf >= ps, false) AS dn FROM c JOIN bars b USING (symbol, bar_seq)), h AS (SELECT symbol, bar_seq, 0 AS side, close AS entry, 0 AS was, 0.0::DOUBLE AS was_entry, close, 0.0::DOUBLE AS cash FROM g WHERE bar_seq = 0 UNION ALL SELECT g.symbol, g.bar_seq, CASE WHEN h.side = 0 AND up THEN 1 WHEN h.side = 0 AND dn THEN -1 WHEN h.side = 1 AND dn OR h.side = -1 AND up THEN 0 ELSE h.side END, CASE WHEN h.side = 0 AND (up OR dn) THEN g.close ELSE h.entry END, h.side, h.entry, g.close, CASE WHEN h.side = 1 AND dn OR h.side = -1 AND up THEN h.cash + h.side * (g.close - h.entry) ELSE h.cash END FROM h JOIN g ON g.symbol = h.symbol AND g.bar_seq = h.bar_seq + 1), z AS (SELECT *, bar_seq = max(bar_seq) OVER (PARTITION BY symbol) AS last FROM h)"
_TR2 = "SELECT symbol, CASE was WHEN 1 THEN 'long' ELSE 'short' END AS side, was_entry AS entry_price, close AS exit_price, was * (close - was_entry) + 0.0 AS pnl, 'signal' AS exit_reason FROM z WHERE was <> 0 AND side = 0 UNION ALL SELECT symbol, CASE side WHEN 1 THEN 'long' ELSE 'short' END, entry, close, side * (close - entry) + 0.0, 'end_of_data' FROM z WHERE last AND side <> 0"
query("backtest_cross_trades", with_bars(f"{_POS} SELECT symbol, side, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(pnl, 6) AS pnl, exit_reason FROM ({_TR2})", True))(lambda s, d: simulate.trades_of(simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d)))).select("symbol", "side", "entry_price", "exit_price", "pnl", "exit_reason"))
query("backtest_cross_equity", with_bars(f"{_POS} SELECT symbol, bar_seq, round(100000 + cash + side * (close - entry), 2) AS equity FROM z", True))(lambda s, d: simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d))).select("symbol", "bar_seq", "equity"))
query("backtest_cross_metrics", with_bars(f"{_POS}, q AS (SELECT symbol, bar_seq, round(100000 + cash + side * (close - entry), 2) AS eq FROM z), r AS (SELECT *, eq / lag(eq) OVER (PARTITION BY symbol ORDER BY bar_seq) - 1 AS r, eq / max(eq) OVER (PARTITION BY symbol ORDER BY bar_seq ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM q), t AS ({_TR2}), a AS (SELECT symbol, last(eq ORDER BY bar_seq) AS fin, min(dd) * 100 AS dd, coalesce(sqrt(252) * avg(r) / nullif(stddev_pop(r), 0), 0) AS sharpe, coalesce(sqrt(252) * avg(r) / nullif(stddev_pop(r) FILTER (r < 0), 0), 0) AS sortino FROM r GROUP BY 1), b AS (SELECT symbol, count(*) AS n, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS wr, sum(pnl) AS pts FROM t GROUP BY 1) SELECT a.symbol, round(fin, 2) AS final_equity, round((fin / 100000 - 1) * 100, 5) AS total_return_pct, round(dd, 6) AS max_drawdown_pct, round(sharpe, 4) AS sharpe_ratio, round(sortino, 4) AS sortino_ratio, coalesce(n, 0) AS n_trades, round(coalesce(wr, 0), 4) AS win_rate_pct, round(coalesce(pts, 0), 4) AS total_points FROM a LEFT JOIN b USING (symbol)", True))(lambda s, d: metrics.backtest_metrics(simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d))), digits=8).select("symbol", "final_equity", F.round("total_return_pct", 5).alias("total_return_pct"), F.round("max_drawdown_pct", 6).alias("max_drawdown_pct"), *[F.round(c, 4).alias(c) for c in ("sharpe_ratio", "sortino_ratio")], "n_trades", *[F.round(c, 4).alias(c) for c in ("win_rate_pct", "total_points")]))
_RANGES = strategies.get("ema_crossover").ranges
query("backtest_trades")(lambda s, d: simulate.trades_of(simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d), {"use_sl_tp": True}))))
query("backtest_equity")(lambda s, d: simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d))).drop("trades"))
query("backtest_renko")(lambda s, d: metrics.backtest_metrics(spec.backtest(spec.Spec(chart={"type": "renko", "mode": "wicks", "brick_size": 20.0}), hourly(s, d))))
query("backtest_sessions")(lambda s, d: insights.session_breakdown(simulate.trades_of(simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d)))), KEYS))
query("rules_strategy")(lambda s, d: metrics.backtest_metrics(simulate.simulate(strategies.from_rules("rsi_and_trend", {"indicators": {"r": {"name": "rsi", "period": 14}, "m": {"name": "sma", "period": 50}}, "long": {"all": [{"left": "r", "op": "crosses_above", "right": 45}, {"left": "close", "op": ">", "right": "m"}]}, "leave_long": {"left": "r", "op": ">", "right": 60}, "warmup": 50}).signals(hourly(s, d)))))
query("grid_search_topk")(lambda s, d: search.grid_search(hourly(s, d), search.param_sets(s, _RANGES), top_k=3).select("symbol", "rank", "combo_id", "score", "n_trades", "total_points", F.to_json("params").alias("params")))


def found(bars: DataFrame, name: str) -> DataFrame:
    """All sets of a strategy's own ranges, ranked for each series (part ``ranked``), and the best one on runs of the
    series in order (part ``walk_forward``, with its fold)."""
    ranked, folds = search.finder(bars, name)
    cols = ["score", "total_return_pct", "n_trades"]
    a = ranked.select("symbol", F.lit("ranked").alias("part"), F.col("rank").cast("long").alias("rank"), F.lit(None).cast("long").alias("fold"), "combo_id", F.to_json("params").alias("params"), *cols)
    return a.unionByName(folds.select("symbol", F.lit("walk_forward").alias("part"), "fold", *cols), allowMissingColumns=True)


for _name in strategies.REGISTRY:
    query(f"finder_{_name}")(lambda s, d, n=_name: found(hourly(s, d), n))
query("combo_table")(lambda s, d: search.combo_table(search.finder(hourly(s, d), "ema_crossover")[0], "total_return_pct").select("symbol", "rank", "combo_id", "score", "total_return_pct", "n_trades"))
query("last_trades", with_bars(f"{_POS}, t AS (SELECT symbol, bar_seq, was_entry AS entry_price, close AS exit_price FROM z WHERE was <> 0 AND side = 0 UNION ALL SELECT symbol, bar_seq + 1, entry, close FROM z WHERE last AND side <> 0) SELECT symbol, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_seq DESC) <= 12", True))(lambda s, d: simulate.last_trades(simulate.trades_of(simulate.simulate(strategies.get("ema_crossover").signals(hourly(s, d))))).select("symbol", "entry_price", "exit_price"))
query("features_merged")(lambda s, d: features.all_features(hourly(s, d), "1h"))
query("walk_forward")(lambda s, d: search.walk_forward(hourly(s, d), search.grid_search(hourly(s, d), search.param_sets(s, _RANGES), top_k=1)).select("symbol", "fold", "score", "n_trades", "total_points"))
query("threshold_sweep", f"WITH {_T}, g AS (SELECT round(unnest(range(1, 50)) / 50.0, 2) AS threshold) SELECT symbol, threshold, count(*) FILTER (score >= threshold) AS kept, count(*) FILTER (score < threshold) AS dropped, round(100.0 * count(*) FILTER (score >= threshold) / count(*), 6) AS kept_pct, round(coalesce(sum(pnl) FILTER (score >= threshold), 0), 4) AS total_points, round(coalesce(100.0 * count(*) FILTER (score >= threshold AND pnl > 0) / nullif(count(*) FILTER (score >= threshold), 0), 0), 6) AS win_rate_pct FROM t CROSS JOIN g GROUP BY 1, 2")(lambda s, d: rounded(tradefilter.threshold_sweep(event_trades(s, d), hourly(s, d).select(*KEYS, "ts", "bar_seq"), KEYS).select("symbol", "threshold", "kept", "dropped", "kept_pct", F.round("total_points", 4).alias("total_points"), "win_rate_pct")))
query("best_threshold", f"WITH {_T}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY entry_time, trade_id) - 1 AS i FROM t), te AS (SELECT * FROM n WHERE i >= CASE WHEN n < 10 THEN n // 2 ELSE least(greatest(CAST(round_even(n * 0.8, 0) AS BIGINT), CAST(floor(n * 0.6) AS BIGINT)), n - 5) END), g AS (SELECT round(unnest(range(4, 198)) / 200.0, 3) AS threshold), s AS (SELECT symbol, threshold, coalesce(sum(pnl) FILTER (score >= threshold), 0) AS p FROM te CROSS JOIN g GROUP BY 1, 2) SELECT symbol, first(threshold ORDER BY round(p, 6) DESC, threshold) AS threshold FROM s GROUP BY 1")(lambda s, d: tradefilter.best_threshold(tradefilter.with_split(event_trades(s, d), ["symbol"]), ["symbol"]))
query("choose_threshold")(lambda s, d: tradefilter.choose_threshold(tradefilter.threshold_sweep(event_trades(s, d), hourly(s, d).select(*KEYS, "ts", "bar_seq"), KEYS), KEYS))
query("fallback_scores")(lambda s, d: tradefilter.fallback_scores(event_trades(s, d), structure.market_structure(hourly(s, d))).select("symbol", "trade_id", "score"))
query("context_scores")(lambda s, d: tradefilter.trade_context(event_trades(s, d), hourly(s, d)).select("symbol", "trade_id", tradefilter.context_score().alias("score")))


@query("trade_filter_model")
def _model(spark: SparkSession, d: str) -> DataFrame:
    """A boosted filter of all symbols' trades together, on all structure features: accuracy and area under the curve by part."""
    trades = tradefilter.with_split(event_trades(spark, d), ["symbol"]).withColumn("label", tradefilter.label())
    rows, names = tradefilter.structure_rows(trades, structure.market_structure(hourly(spark, d)))
    rows = cut(rows)
    return tradefilter.evaluate(tradefilter.boosted_scores(tradefilter.train_boosted(rows, names), rows))


@query("catalog_indicators")
def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every indicator with its defaults, and how many of the hourly bars it has a value for."""
    rows = hourly(spark, d)
    found = None
    for x in indicators.catalog():
        got = indicators.compute(x["name"], rows).agg(F.count(x["columns"][0]).alias("n_values"))
        got = got.select(F.lit(x["name"]).alias("name"), F.array(*map(F.lit, x["columns"])).alias("columns"), F.lit(x["returns"]).alias("returns"), F.lit(str(x["defaults"])).alias("defaults"), "n_values")
        found = got if found is None else found.unionByName(got)
    return found


@query("catalog_instruments")
def _instruments(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of the bars looked up among the instruments, with their numbers of bars; unknown ones have nulls."""
    known = spark.createDataFrame([(k, v["name"], v["exchange"], v["asset_class"], float(v["tick_size"]), v["timeframes"]) for k, v in spec.INSTRUMENTS.items()], "symbol string, name string, exchange string, asset_class string, tick_size double, timeframes array<string>")
    bars = hourly(spark, d).groupBy(F.upper("symbol").alias("symbol")).agg(F.count("*").alias("n_bars"))
    return bars.join(F.broadcast(known), "symbol", "left")


_ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in B.ALIASES.items())
_LABEL_SQL = "' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' || CASE l_linenumber % 4 WHEN 0 THEN 'Min' WHEN 1 THEN 'M' WHEN 2 THEN 'Hour' ELSE 'hr ' END"


@query("timeframes", f"""
SELECT label, coalesce(a.tf, flat) AS tf, count(*) AS n
FROM (SELECT {_LABEL_SQL} AS label, lower(replace({_LABEL_SQL}, ' ', '')) AS flat FROM lineitem) x LEFT JOIN (VALUES {_ALIAS_ROWS}) a(name, tf) ON a.name = x.flat
GROUP BY 1, 2""")
def _timeframes(spark: SparkSession, d: str) -> DataFrame:
    """Labels as people write them, made of the line items' quantities, in their canonical form."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    unit = F.when(F.col("l_linenumber") % 4 == 0, "Min").when(F.col("l_linenumber") % 4 == 1, "M").when(F.col("l_linenumber") % 4 == 2, "Hour").otherwise("hr ")
    label = F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit)
    return rows.select(label.alias("label")).groupBy("label", B.timeframe_column(F.col("label")).alias("tf")).agg(F.count("*").alias("n"))


@query("feature_importances")
def _importances(spark: SparkSession, d: str) -> DataFrame:
    """What a forest on all numeric compact features finds in the next bar's direction."""
    f = compact.compact_features(hourly(spark, d))
    rows = f.withColumn("label", W.flag(F.lead("close").over(W.series()) > F.col("close")))
    return features.category_importances(features.forest_importances(rows, B.numeric_features(f), trees=100))


@query("catalog_strategies")
def _strategies(spark: SparkSession, d: str) -> DataFrame:
    """Every strategy with its rules, and how often each of its signals fires on the hourly bars."""
    bars, found = hourly(spark, d), None
    for s in strategies.REGISTRY.values():
        x = s.describe()
        got = s.signals(bars).agg(*[F.count_if(F.col(c)).alias(c) for c in ("go_long", "go_short")])
        got = got.select(F.lit(x["name"]).alias("name"), *[F.array(*map(F.lit, x[k])).alias(k) for k in ("entry_rules", "exit_rules", "indicators")], "go_long", "go_short")
        found = got if found is None else found.unionByName(got)
    return found


query("backtest_metrics")(lambda s, d: flagship(s, d))
SQL |= blocks.more()
for _name, (_run, _text) in ingest.QUERIES.items():
    query(_name, _text)(_run)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events to hourly bars, crossing averages, simulation, metrics by symbol."""
    return metrics.backtest_metrics(simulate.simulate(strategies.get("ema_crossover").signals(hourly(spark, d))))
