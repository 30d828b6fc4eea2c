"""DuckDB SQL of the larger queries, put together from named blocks.

Bars are hourly ones of ``events``. Recursions along a series are one recursive
CTE each (``walk``): its states have a start at bar 0 and a step from the state
before (``e``) and the bar at hand (``b``).
"""

from __future__ import annotations

S = "PARTITION BY symbol ORDER BY bar_seq"

BARS = f"""bars AS (
  SELECT symbol, '1h' AS tf, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_seq, open, high, low, close, volume
  FROM (
    SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts,
      first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
      CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY ALL
  )
), d AS MATERIALIZED (
  SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    close - lag(close) OVER w AS dc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn
  FROM bars WINDOW w AS ({S})
)"""

#: Each symbol's events in time order, paired to trades; the user's parity is the side.
TRADES = """ev AS (
  SELECT event_type AS symbol, ts, event_id, user_id, value, row_number() OVER w - 1 AS k, lead(ts) OVER w AS xt, lead(value) OVER w AS xp
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
), t AS MATERIALIZED (
  SELECT symbol, '1h' AS tf, k // 2 AS trade_id, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, ts AS entry_time,
    xt AS exit_time, (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) * (xp - value) AS pnl, (event_id % 100) / 100.0 AS score
  FROM ev WHERE k % 2 = 0 AND xt IS NOT NULL
)"""


def given(*blocks: str) -> str:
    return "WITH RECURSIVE " + ", ".join([BARS, *blocks])


def frame(n: int, off: int = 0) -> str:
    return f"({S} ROWS BETWEEN {n - 1 + off} PRECEDING AND {f'{off} PRECEDING' if off else 'CURRENT ROW'})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({S})"


def full(fn: str, x: str, n: int, off: int = 0) -> str:
    """A rolling value; null until its frame holds n values."""
    w = frame(n, off)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {fn}({x}) OVER {w} END"


def quantile(x: str, n: int, p: float) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN quantile_cont({x}, {p}) OVER {frame(n)} END"


def rank(x: str, n: int) -> str:
    """From a list of the frame's values: the last one's rank, ties averaged, over n."""
    vs = f"list_filter(list({x}) OVER {frame(n)}, lambda v: v IS NOT NULL)"
    return f"CASE WHEN {x} IS NOT NULL AND len({vs}) = {n} THEN (len(list_filter({vs}, lambda v: v < {x})) + (len(list_filter({vs}, lambda v: v = {x})) + 1) / 2.0) / {n} END"


def change(x: str, k: int = 1) -> str:
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INT)"


def flags(conds: dict[str, str]) -> str:
    return ",\n  ".join(f"{flag(c)} AS {n}" for n, c in conds.items())


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def walk(name: str, states: dict[str, tuple[str, str]], source: str = "d") -> str:
    start = ", ".join(f"CAST({a} AS DOUBLE) AS {k}" for k, (a, _) in states.items())
    step = ", ".join(f"CAST({b} AS DOUBLE)" for _, b in states.values())
    return f"""{name} AS (
  SELECT b.symbol, b.bar_seq, {start} FROM {source} b WHERE b.bar_seq = 0
  UNION ALL
  SELECT b.symbol, b.bar_seq, {step} FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.bar_seq = e.bar_seq + 1
)"""


# --- averages that begin with the first value -------------------------------------------------------------------------


def ewma(k: str, a: str, x: str) -> tuple[str, str]:
    return x, f"e.{k} + ({a}) * ({x} - e.{k})"


def later(k: str, a: str, x: str) -> str:
    """A step where the first value may be null."""
    return f"CASE WHEN ({x}) IS NULL THEN e.{k} WHEN e.{k} IS NULL THEN {x} ELSE e.{k} + ({a}) * ({x} - e.{k}) END"


def ema(n: int, x: str = "b.close", k: str | None = None) -> dict:
    k = k or f"ema_{n}"
    return {k: ewma(k, f"2.0/{n + 1}", x)}


def rsi(n: int) -> dict:
    return {f"g{n}": ("NULL", later(f"g{n}", f"1.0/{n}", "greatest(b.dc, 0)")), f"l{n}": ("NULL", later(f"l{n}", f"1.0/{n}", "greatest(-b.dc, 0)"))}


def rsi_of(n: int) -> str:
    return f"100 - 100 / (1 + g{n} / nullif(l{n}, 0))"


def macd() -> dict:
    f, s = (ewma(k, a, "b.close")[1] for k, a in (("mf", "2.0/13"), ("ms", "2.0/27")))
    return {"mf": ("b.close", f), "ms": ("b.close", s), "mg": ("0", f"e.mg + 0.2 * (({f}) - ({s}) - e.mg)")}


def atr(k: str = "atr", n: int = 14) -> dict:
    return {k: ewma(k, f"1.0/{n}", "b.tr")}


def adx() -> dict:
    plus = later("dp", "1.0/14", "CASE WHEN b.up > b.dn AND b.up > 0 THEN b.up ELSE 0 END")
    minus = later("dm", "1.0/14", "CASE WHEN b.dn > b.up AND b.dn > 0 THEN b.dn ELSE 0 END")
    dx = f"100 * abs(({plus}) - ({minus})) / nullif(({plus}) + ({minus}), 0)"
    return {"av": ewma("av", "1.0/14", "b.tr"), "dp": ("NULL", plus), "dm": ("NULL", minus), "adx": ("NULL", later("adx", "1.0/14", dx))}


PLUS_DI, MINUS_DI = "100 * dp / nullif(av, 0)", "100 * dm / nullif(av, 0)"


def heikin() -> dict:
    return {"ho": ("(b.open + b.close) / 2", "(e.ho + e.hc) / 2"), "hc": ("(b.open + b.high + b.low + b.close) / 4", "(b.open + b.high + b.low + b.close) / 4")}


def supertrend() -> dict:
    v = "e.sv + 0.1 * (b.tr - e.sv)"
    up, lo = f"(b.high + b.low) / 2 + 3 * ({v})", f"(b.high + b.low) / 2 - 3 * ({v})"
    return {
        "sv": ("b.tr", v), "su": ("(b.high + b.low) / 2 + 3 * b.tr", f"CASE WHEN {up} < e.su OR b.c1 > e.su THEN {up} ELSE e.su END"),
        "sl": ("(b.high + b.low) / 2 - 3 * b.tr", f"CASE WHEN {lo} > e.sl OR b.c1 < e.sl THEN {lo} ELSE e.sl END"),
        "sd": ("1", "CASE WHEN b.close > e.su THEN 1 WHEN b.close < e.sl THEN -1 ELSE e.sd END"),
    }


JOINED = "m AS MATERIALIZED (SELECT d.*, e.* EXCLUDE (symbol, bar_seq) FROM d JOIN e USING (symbol, bar_seq))"

# --- strategies and the simulator -------------------------------------------------------------------------------------


def crossing(a: str, b: str) -> tuple[str, str]:
    b1 = lag(b) if not b[0].isdigit() else b
    return f"({a} > {b} AND {lag(a)} <= {b1})", f"({a} < {b} AND {lag(a)} >= {b1})"


def signals(states: dict | None, columns: dict[str, str], warmup: int, conds: tuple[str, str, str, str], stop: str = "NULL", target: str = "NULL") -> str:
    """Blocks up to ``g``: bars with go_long, go_short, leave_long, leave_short, stop_dist, target_dist."""
    first = f"{walk('e', states)}, {JOINED}" if states else "m AS (SELECT * FROM d)"
    made = "".join(f", {x} AS {n}" for n, x in columns.items())
    named = ", ".join(f"coalesce(bar_seq >= {warmup} AND {c}, false) AS {n}" for n, c in zip(("go_long", "go_short", "leave_long", "leave_short"), conds, strict=True))
    return f"""{first}, x AS (SELECT *{made} FROM m), g AS MATERIALIZED (
  SELECT symbol, ts, bar_seq, open, high, low, close, {named},
    CAST({stop} AS DOUBLE) AS stop_dist, CAST({target} AS DOUBLE) AS target_dist FROM x
)"""


def _strategies() -> dict[str, str]:
    up, down = crossing("f", "s")
    out = {"ema_crossover": signals({**ema(9, k="f"), **ema(21, k="s")}, {}, 22, (up, down, down, up))}
    out["ema_crossover with stops"] = signals({**ema(9, k="f"), **ema(21, k="s"), **atr()}, {}, 22, (up, down, down, up), "nullif(1.5 * atr, 0)", "nullif(2.5 * atr, 0)")
    hc = "(b.open + b.high + b.low + b.close) / 4"
    out["heikin_ashi_ema_cross"] = signals({**ema(9, hc, "f"), **ema(21, hc, "s"), **ema(55, hc, "t")}, {}, 56, (f"{up} AND close > t", f"{down} AND close < t", down, up))
    r = crossing("r", "30")[0], crossing("r", "70")[1]
    out["rsi_mean_reversion"] = signals(rsi(14), {"r": rsi_of(14)}, 15, (*r, "r >= 50", "r <= 50"))
    mid, sd = full("avg", "close", 20), full("stddev_samp", "close", 20)
    out["bollinger_breakout"] = signals(None, {"mid": mid, "hi": f"({mid}) + 2 * ({sd})", "lo": f"({mid}) - 2 * ({sd})"}, 21, (crossing("close", "hi")[0], crossing("close", "lo")[1], "close < mid", "close > mid"))
    h_up, h_down = crossing("h", "0")
    out["macd_trend"] = signals({**macd(), **ema(200)}, {"h": "mf - ms - mg"}, 201, (f"{h_up} AND close > ema_200", f"{h_down} AND close < ema_200", h_down, h_up))
    r45 = crossing("r", "45")[0]
    out["rules"] = signals(rsi(14), {"r": rsi_of(14), "mid": full("avg", "close", 50)}, 50, (f"{r45} AND close > mid", "false", "r > 60", "false"))
    return out


#: From the signals ``g``: z, a row a bar with the position after it, what it closed (x_ columns) and the equity.
SIMULATED = """h AS (
  SELECT symbol, bar_seq, ts, close, 0 AS side, 0.0::DOUBLE AS entry, ts AS entered, NULL::DOUBLE AS stop, NULL::DOUBLE AS target,
    100000.0::DOUBLE AS cash, 0 AS x_side, 0.0::DOUBLE AS x_entry, ts AS x_entered, 0.0::DOUBLE AS x_price, '' AS x_reason
  FROM g WHERE bar_seq = 0
  UNION ALL
  SELECT symbol, bar_seq, ts, close,
    CASE WHEN opens THEN CASE WHEN go_long THEN 1 ELSE -1 END WHEN reason <> '' THEN 0 ELSE side END,
    CASE WHEN opens THEN close ELSE entry END, CASE WHEN opens THEN ts ELSE entered END,
    CASE WHEN opens THEN close - CASE WHEN go_long THEN stop_dist ELSE -stop_dist END ELSE stop END,
    CASE WHEN opens THEN close + CASE WHEN go_long THEN target_dist ELSE -target_dist END ELSE target END,
    CASE WHEN reason <> '' THEN cash + side * (price - entry) ELSE cash END,
    CASE WHEN reason <> '' THEN side ELSE 0 END, entry, entered, price, reason
  FROM (
    SELECT *, CASE reason WHEN 'stop_loss' THEN stop WHEN 'take_profit' THEN target ELSE close END AS price,
      (side = 0 OR reason IN ('stop_loss', 'take_profit')) AND (go_long OR go_short) AS opens
    FROM (
      SELECT g.*, h.side, h.entry, h.entered, h.stop, h.target, h.cash,
        CASE WHEN h.side = 0 THEN ''
          WHEN coalesce(CASE h.side WHEN 1 THEN g.low <= h.stop ELSE g.high >= h.stop END, false) THEN 'stop_loss'
          WHEN coalesce(CASE h.side WHEN 1 THEN g.high >= h.target ELSE g.low <= h.target END, false) THEN 'take_profit'
          WHEN h.side = 1 AND g.leave_long OR h.side = -1 AND g.leave_short THEN 'signal' ELSE '' END AS reason
      FROM h JOIN g ON g.symbol = h.symbol AND g.bar_seq = h.bar_seq + 1
    )
  )
), z AS MATERIALIZED (
  SELECT *, round(cash + side * (close - entry), 2) AS equity, bar_seq = max(bar_seq) OVER (PARTITION BY symbol) AS last FROM h
), tr AS MATERIALIZED (
  SELECT symbol, '1h' AS tf, row_number() OVER (PARTITION BY symbol ORDER BY bar_seq, k) - 1 AS trade_id, CASE s WHEN 1 THEN 'long' ELSE 'short' END AS side,
    entered AS entry_time, entry AS entry_price, ts AS exit_time, price AS exit_price, s * (price - entry) + 0.0 AS pnl,
    s * (price - entry) / nullif(entry, 0) + 0.0 AS pnl_pct, s * (price - entry) + 0.0 AS points, 0 AS bars_held, reason AS exit_reason
  FROM (
    SELECT symbol, bar_seq, 0 AS k, x_side AS s, x_entered AS entered, x_entry AS entry, ts, x_price AS price, x_reason AS reason FROM z WHERE x_side <> 0
    UNION ALL SELECT symbol, bar_seq, 1, side, entered, entry, ts, close, 'end_of_data' FROM z WHERE last AND side <> 0
  )
)"""

#: From z and tr: all figures of each symbol, to two digits.
METRICS = """c AS (
  SELECT symbol, bar_seq, ts, equity, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM z WINDOW w AS (PARTITION BY symbol ORDER BY bar_seq)
), a AS (
  SELECT symbol, first(equity ORDER BY bar_seq) AS e0, last(equity ORDER BY bar_seq) AS e1, min(dd) AS dd, count(*) AS n, count(r) AS k, avg(r) AS m, stddev_pop(r) AS s,
    stddev_pop(r) FILTER (r < 0) AS ds, greatest(date_diff('second', min(ts), max(ts)) / (365.25 * 86400), 1e-6) AS years FROM c GROUP BY 1
), b AS (
  SELECT symbol, count(*) AS n_trades, count(*) FILTER (side = 'long') AS long_trades, count(*) FILTER (side = 'short') AS short_trades,
    100.0 * count(*) FILTER (pnl > 0) / count(*) AS win_rate_pct, avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss, avg(pnl) AS avg_trade,
    max(pnl) AS best_trade, min(pnl) AS worst_trade, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, coalesce(abs(sum(pnl) FILTER (pnl < 0)), 0) AS gross_loss,
    sum(points) AS total_points, avg(points) AS avg_points FROM tr GROUP BY 1
), f AS (
  SELECT a.symbol, '1h' AS tf, 100000.0 AS initial_capital, e1 AS final_equity, (e1 / 100000 - 1) * 100 AS total_return_pct,
    CASE WHEN n >= 2 AND e0 > 0 THEN (pow(e1 / e0, 1 / years) - 1) * 100 ELSE 0 END AS cagr_pct, dd * 100 AS max_drawdown_pct,
    CASE WHEN k > 1 AND s > 0 THEN sqrt(252) * m / s ELSE 0 END AS sharpe_ratio, CASE WHEN k > 1 AND s > 0 AND ds > 0 THEN sqrt(252) * m / ds ELSE 0 END AS sortino_ratio,
    coalesce(n_trades, 0) AS n_trades, coalesce(long_trades, 0) AS long_trades, coalesce(short_trades, 0) AS short_trades, win_rate_pct, avg_win, avg_loss, avg_trade, best_trade, worst_trade,
    CASE WHEN gross_loss <> 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN 999.0 ELSE 0 END AS profit_factor, avg_trade AS expectancy, gross_profit, gross_loss,
    total_points, avg_points, avg_win AS avg_points_win, avg_loss AS avg_points_loss, best_trade AS best_points, worst_trade AS worst_points
  FROM a LEFT JOIN b USING (symbol)
)"""
FIGURES = ["initial_capital", "final_equity", "total_return_pct", "cagr_pct", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "win_rate_pct", "avg_win", "avg_loss", "avg_trade", "best_trade", "worst_trade", "profit_factor", "expectancy", "gross_profit", "gross_loss", "total_points", "avg_points", "avg_points_win", "avg_points_loss", "best_points", "worst_points"]
#: Cut to ten digits first, for halves are told alike only so.
ALL_FIGURES = "SELECT symbol, tf, n_trades, long_trades, short_trades, " + ", ".join(f"round_even(round(coalesce({x}, 0), 9), 2) AS {x}" for x in FIGURES) + " FROM f"
TRADE_COLUMNS = "symbol, tf, trade_id, side, entry_time, round(entry_price, 6) AS entry_price, exit_time, round(exit_price, 6) AS exit_price, round(pnl, 6) AS pnl, round(pnl_pct, 6) AS pnl_pct, round(points, 6) AS points, bars_held, exit_reason"


def _simulations() -> dict[str, str]:
    out = {}
    known = _strategies()
    for name, blocks in known.items():
        if " " not in name and name != "rules":
            out[f"signals_{name}"] = given(blocks) + " SELECT symbol, ts, go_long, go_short, leave_long, leave_short, stop_dist, target_dist FROM g"
            out[f"backtest_{name}"] = given(blocks, SIMULATED, METRICS) + " " + ALL_FIGURES
    out["rules_strategy"] = given(known["rules"], SIMULATED, METRICS) + " " + ALL_FIGURES
    out["backtest_metrics"] = out["backtest_ema_crossover"]
    out["backtest_trades"] = given(known["ema_crossover with stops"], SIMULATED) + f" SELECT {TRADE_COLUMNS} FROM tr"
    peak = f"greatest(100000, max(cash + side * (close - entry)) OVER ({S} ROWS UNBOUNDED PRECEDING))"
    out["backtest_equity"] = given(known["ema_crossover"], SIMULATED) + f" SELECT symbol, '1h' AS tf, ts, bar_seq, equity, round_even((cash + side * (close - entry) - {peak}) / {peak} * 1e6, 0) / 1e6 AS dd FROM z"
    buckets = """SELECT symbol, 'session' AS kind, CASE WHEN hour(entry_time) < 7 THEN 'Asia' WHEN hour(entry_time) < 12 THEN 'London' WHEN hour(entry_time) < 16 THEN 'Overlap'
    WHEN hour(entry_time) < 22 THEN 'NewYork' ELSE 'OffHrs' END AS bucket, pnl FROM tr
  UNION ALL SELECT symbol, 'hour', CAST(hour(entry_time) AS VARCHAR), pnl FROM tr
  UNION ALL SELECT symbol, 'weekday', ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(entry_time)], pnl FROM tr"""
    out["backtest_sessions"] = given(known["ema_crossover"], SIMULATED, f"x2 AS ({buckets})", """k AS (
  SELECT 'session' AS kind, unnest(['Asia','London','Overlap','NewYork','OffHrs']) AS bucket
  UNION ALL SELECT 'hour', CAST(unnest(range(24)) AS VARCHAR) UNION ALL SELECT 'weekday', unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])
)""") + """
SELECT s.symbol, '1h' AS tf, k.kind, k.bucket, count(pnl) AS n_trades, round(coalesce(100.0 * count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 0), 6) AS win_rate_pct,
  round(coalesce(sum(pnl), 0), 6) AS total_pnl, round(coalesce(avg(pnl), 0), 6) AS avg_trade, round(coalesce(max(pnl), 0), 6) AS best_trade, round(coalesce(min(pnl), 0), 6) AS worst_trade,
  round(CASE WHEN coalesce(sum(pnl) FILTER (pnl < 0), 0) <> 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl < 0))
    WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 999.0 ELSE 0.0 END, 6) AS profit_factor, round(coalesce(avg(pnl), 0), 6) AS expectancy
FROM (SELECT DISTINCT symbol FROM tr) s CROSS JOIN k LEFT JOIN x2 ON x2.symbol = s.symbol AND x2.kind = k.kind AND x2.bucket = k.bucket GROUP BY 1, 3, 4"""
    return out


# --- feature tables -----------------------------------------------------------------------------------------------------


def before(cond: str, value: str, back: int | None = None, own: bool = False) -> str:
    """The value at the latest bar with the condition before this one (or up to it), ``back`` bars back at most."""
    far = "UNBOUNDED" if back is None else str(back)
    return f"last_value(CASE WHEN {cond} THEN {value} END IGNORE NULLS) OVER ({S} ROWS BETWEEN {far} PRECEDING AND {'CURRENT ROW' if own else '1 PRECEDING'})"


def _confirmed(side: str, n: int) -> str:
    top, beyond, passed = ("max", ">", ">=") if side == "high" else ("min", "<", "<=")
    mid = lag(side, n)
    return f"bar_seq >= {2 * n} AND {mid} {beyond} {top}({side}) OVER {frame(n, n + 1)} AND {mid} {passed} {top}({side}) OVER {frame(n)}"


BACK = {5: "last_5", 10: "last_10", 20: "last_20"}
EVENTS = {"pivot_high": "is_pivot_high", "pivot_low": "is_pivot_low", "hh": "is_hh", "ll": "is_ll", "choch": "is_choch", "bos": "is_bos"}


def structure_blocks() -> list[str]:
    """Up to ``s``: all market structure columns. The trend's two states are a recursion."""
    sweep = "len(list_filter({0}, lambda v: v IS NOT NULL AND {1})) > 0"
    levels = f"({S} ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)"
    ahead = f"({S} ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING)"
    first = "first_value(CASE WHEN {0} THEN bar_seq END IGNORE NULLS) OVER " + ahead
    broke = "(is_choch = 1 OR is_bos = 1)"
    rising = "(is_choch_bullish = 1 OR is_bos_bullish = 1)"
    counted = ", ".join(f"CAST(sum({x}) OVER {frame(n)} AS INT) AS {k}_{v}" for k, x in EVENTS.items() for n, v in BACK.items())
    any_ = ", ".join(f"{flag(f'{k}_{v} > 0')} AS any_{k}_{v}" for k in EVENTS for v in BACK.values())
    score = ", ".join(f"{' + '.join(f'any_{k}_last_{n}' for k in ('pivot_high', 'pivot_low', 'choch', 'bos'))} AS smc_activity_score_{n}" for n in (5, 10))
    return [
        f"""s1 AS MATERIALIZED (SELECT symbol, tf, ts, bar_seq, open, high, low, close, volume,
  {flag(_confirmed('high', 8))} AS is_pivot_high, {flag(_confirmed('low', 8))} AS is_pivot_low, {flag(_confirmed('high', 3))} AS sh, {flag(_confirmed('low', 3))} AS sl,
  {flag(f"{lag('high', 3)} < {lag('low')}")} AS is_fvg_bullish, {flag(f"{lag('low', 3)} > {lag('high')}")} AS gap_down, {lag('high', 3)} AS h3, {lag('low', 3)} AS l3 FROM bars)""",
        f"""s2 AS MATERIALIZED (SELECT *, CASE WHEN is_fvg_bullish = 0 AND gap_down = 1 THEN 1 ELSE 0 END AS is_fvg_bearish,
  {before('is_pivot_high = 1', 'high')} AS ph, {before('is_pivot_low = 1', 'low')} AS pl,
  CASE WHEN bar_seq >= 50 THEN {before('is_pivot_high = 1', 'high', 49)} END AS near_h, CASE WHEN bar_seq >= 50 THEN {before('is_pivot_low = 1', 'low', 49)} END AS near_l,
  list(CASE WHEN is_pivot_high = 1 THEN high END) OVER {levels} AS hs, list(CASE WHEN is_pivot_low = 1 THEN low END) OVER {levels} AS ls,
  {before('sh = 1', 'h3', 13, True)} AS idm_h, {before('sl = 1', 'l3', 13, True)} AS idm_l FROM s1)""",
        f"""s3 AS MATERIALIZED (SELECT *, greatest(is_fvg_bullish, is_fvg_bearish) AS is_fvg,
  {flag('is_pivot_high = 1 AND high > ph')} AS is_hh, {flag('is_pivot_high = 1 AND high <= ph')} AS is_lh, {flag('is_pivot_low = 1 AND low > pl')} AS is_hl, {flag('is_pivot_low = 1 AND low <= pl')} AS is_ll,
  {before('near_h IS NOT NULL', 'near_h', own=True)} AS hi, {before('near_l IS NOT NULL', 'near_l', own=True)} AS lo,
  {flag(sweep.format('hs', 'high > v AND close < v'))} AS is_sweep_bearish, {flag(sweep.format('ls', 'low < v AND close > v'))} AS is_sweep_bullish FROM s2)""",
        walk("st", {"state": ("0", "CASE WHEN e.state = 0 AND b.close > b.hi THEN 1 WHEN e.state = 1 AND b.close < b.lo THEN 0 ELSE e.state END")}, "s3"),
        f"""s4 AS MATERIALIZED (SELECT s3.*, CAST(state AS INT) AS market_structure, coalesce(lag(state) OVER (PARTITION BY s3.symbol ORDER BY s3.bar_seq), 0) AS was FROM s3 JOIN st USING (symbol, bar_seq))""",
        f"""s5 AS MATERIALIZED (SELECT *, greatest(is_sweep_bearish, is_sweep_bullish) AS is_sweep,
  {flag('was = 0 AND market_structure = 1')} AS is_choch_bullish, {flag('was = 1 AND market_structure = 0')} AS is_choch_bearish,
  {flag('bar_seq >= 50 AND market_structure = 1 AND close > hi * 1.001')} AS is_bos_bullish, {flag('bar_seq >= 50 AND market_structure = 0 AND close < lo * 0.999')} AS is_bos_bearish,
  {flag('market_structure = 1 AND low < idm_l AND close > idm_l')} AS is_idm_bearish, {flag('market_structure = 0 AND high > idm_h AND close < idm_h')} AS is_idm_bullish FROM s4)""",
        "s6 AS MATERIALIZED (SELECT *, greatest(is_choch_bullish, is_choch_bearish) AS is_choch, greatest(is_bos_bullish, is_bos_bearish) AS is_bos, greatest(is_idm_bullish, is_idm_bearish) AS is_idm FROM s5)",
        f"""s7 AS MATERIALIZED (SELECT *, {first.format(f'{broke} AND {rising}')} AS b_up, {first.format(f'{broke} AND NOT {rising}')} AS b_dn, {first.format('close < open')} AS red, {first.format('close > open')} AS green FROM s6)""",
        f"""s8 AS MATERIALIZED (SELECT *, {flag('close < open AND b_up IS NOT NULL AND (red IS NULL OR b_up <= red)')} AS is_ob_bullish, {flag('close > open AND b_dn IS NOT NULL AND (green IS NULL OR b_dn <= green)')} AS is_ob_bearish,
  {flag('close > open')} AS is_bullish_candle, {flag('close < open')} AS is_bearish_candle, {flag('abs(close - open) < (high - low) * 0.1')} AS is_doji,
  (high - low) / nullif(close, 0) * 100 AS range_pct, abs(close - open) / nullif(close, 0) * 100 AS body_pct,
  {full('avg', 'volume', 20)} AS volume_sma_20, {', '.join(f"{full('avg', 'close', n)} AS sma_{n}" for n in (8, 21, 50))}, {counted} FROM s7)""",
        f"""s9 AS MATERIALIZED (SELECT *, greatest(is_ob_bullish, is_ob_bearish) AS is_ob, {flag('volume > volume_sma_20 * 1.5')} AS is_high_volume, {', '.join(f"{flag(f'close > sma_{n}')} AS above_sma_{n}" for n in (8, 21, 50))},
  2 * is_hh + is_hl - 2 * is_lh - is_ll AS trend_strength, {any_} FROM s8)""",
        f"s AS MATERIALIZED (SELECT *, {score} FROM s9)",
    ]


_STRUCTURE = ["is_pivot_high", "is_pivot_low", "is_fvg_bullish", "is_fvg_bearish", "is_fvg", "is_hh", "is_lh", "is_hl", "is_ll", "is_sweep_bearish", "is_sweep_bullish", "is_sweep", "market_structure", "is_choch_bullish", "is_choch_bearish", "is_bos_bullish", "is_bos_bearish", "is_idm_bearish", "is_idm_bullish", "is_choch", "is_bos", "is_idm", "is_ob_bullish", "is_ob_bearish", "is_bullish_candle", "is_bearish_candle", "is_doji", *[f"{k}_{v}" for k in EVENTS for v in BACK.values()], "is_ob", "is_high_volume", "above_sma_8", "above_sma_21", "above_sma_50", "trend_strength", *[f"any_{k}_{v}" for k in EVENTS for v in BACK.values()], "smc_activity_score_5", "smc_activity_score_10"]
_MEASURES = ["range_pct", "body_pct", "volume_sma_20", "sma_8", "sma_21", "sma_50"]
_KEYS = "symbol, tf, ts, bar_seq"
_PRICES = rounded(["open", "high", "low", "close"])


def compact_blocks() -> list[str]:
    """Up to ``c5``: the compact features before their last fill."""
    states = {**{k: v for n in (8, 21, 50, 200) for k, v in ema(n).items()}, **{k: v for n in (7, 14, 21) for k, v in rsi(n).items()}, **supertrend(), **macd(), **atr(), **adx(), **heikin()}
    w11 = frame(11)
    def only(side: str, top: str) -> str:
        return f"bar_seq >= 10 AND {lag(side, 5)} = {side}_top AND len(list_filter({side}_all, lambda v: v = {side}_top)) = 1"

    some = "(is_pivot_high + is_pivot_low + is_fvg_bull + is_fvg_bear)"
    sweeps = [("is_sweep_bear", "bar_seq >= 30 AND high > sh30 AND close < sh30"), ("is_sweep_bull", "bar_seq >= 30 AND low < sl30 AND close > sl30")]
    return [
        walk("e", states), JOINED,
        f"""c1 AS MATERIALIZED (SELECT * EXCLUDE (ms, mf, mg, tr), {', '.join(f'{rsi_of(n)} AS rsi_{n}' for n in (7, 14, 21))}, sd AS supertrend_dir, mf - ms AS macd_line, mg AS macd_signal, mf - ms - mg AS macd_hist,
  atr AS atr_14, adx AS adx_14, {PLUS_DI} AS plus_di, {MINUS_DI} AS minus_di, tr AS true_range, {full('avg', 'close', 20)} AS sma_20, {full('avg', 'close', 50)} AS sma_50,
  ({full('avg', 'close', 20)}) + 2 * ({full('stddev_samp', 'close', 20)}) AS bb_upper, ({full('avg', 'close', 20)}) - 2 * ({full('stddev_samp', 'close', 20)}) AS bb_lower,
  100 * (close - ({full('min', 'low', 14)})) / nullif(({full('max', 'high', 14)}) - ({full('min', 'low', 14)}), 0) AS stoch_k,
  {', '.join(f"{change('close', n)} AS ret_{n}" for n in (1, 3, 5, 10, 20))}, {change('close', 2)} AS price_velocity_2, {change('close', 4)} AS price_change_4,
  avg(volume) OVER {frame(20)} AS volume_sma_20, {change('volume', 4)} AS volume_momentum_4,
  max(high) OVER {w11} AS high_top, list(high) OVER {w11} AS high_all, min(low) OVER {w11} AS low_top, list(low) OVER {w11} AS low_all,
  {flag('hc > ho')} AS ha_bull, {flag('hc < ho')} AS ha_bear FROM m)""",
        f"""c2 AS MATERIALIZED (SELECT *, {', '.join(f'(ema_{a} - ema_{b}) / nullif(close, 0) AS ema_{a}_{b}_diff_pct' for a, b in ((8, 21), (21, 50), (50, 200)))},
  {flag('close > ema_50')} AS above_ema_50, {flag('close > ema_200')} AS above_ema_200, {flag('ema_8 > ema_21 AND ema_21 > ema_50 AND ema_50 > ema_200')} AS ma_bullish_alignment, {flag('ema_8 < ema_21 AND ema_21 < ema_50 AND ema_50 < ema_200')} AS ma_bearish_alignment,
  {flag('macd_hist > 0')} AS macd_hist_pos, atr_14 / nullif(close, 0) AS atr_pct, (high - low) / nullif(close, 0) AS range_pct,
  abs(close - open) / nullif(high - low, 0) AS body_pct, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_pct, (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_pct,
  {flag('close > open')} AS is_bullish_candle, {flag('close < open')} AS is_bearish_candle, {flag('abs(close - open) / nullif(high - low, 0) < 0.1')} AS is_doji,
  plus_di - minus_di AS di_diff, CASE WHEN adx_14 IS NOT NULL THEN greatest(0, least(2, adx_14 / 50)) END AS trend_strength,
  CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, {flag('hour(ts) < 7')} AS session_asia, {flag('hour(ts) BETWEEN 7 AND 11')} AS session_london, {flag('hour(ts) BETWEEN 12 AND 15')} AS session_overlap, {flag('hour(ts) BETWEEN 16 AND 21')} AS session_ny,
  {flag(only('high', 'max'))} AS is_pivot_high, {flag(only('low', 'min'))} AS is_pivot_low, {flag(f"{lag('high', 2)} < low")} AS is_fvg_bull, {flag(f"{lag('low', 2)} > high")} AS is_fvg_bear,
  {flag(f"ha_bull <> {lag('ha_bull')}")} AS turn FROM c1)""",
        f"""c3 AS MATERIALIZED (SELECT *, {full('avg', 'stoch_k', 3)} AS stoch_d, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pos, nullif(bb_upper - bb_lower, 0) / nullif(close, 0) AS bb_width_pct,
  volume / nullif(volume_sma_20, 0) AS volume_ratio_20, {flag('volume > volume_sma_20 * 1.5')} AS is_high_volume, sum(turn) OVER ({S} ROWS UNBOUNDED PRECEDING) AS run,
  {before('is_pivot_high = 1', 'high')} AS ph, {before('is_pivot_low = 1', 'low')} AS pl, {before('is_pivot_high = 1', 'high', 30)} AS sh30, {before('is_pivot_low = 1', 'low', 30)} AS sl30 FROM c2)""",
        f"""c4 AS MATERIALIZED (SELECT *, {flag('is_pivot_high = 1 AND high > ph')} AS is_hh, {flag('is_pivot_high = 1 AND high <= ph')} AS is_lh, {flag('is_pivot_low = 1 AND low > pl')} AS is_hl, {flag('is_pivot_low = 1 AND low <= pl')} AS is_ll,
  {', '.join(f'{flag(c)} AS {n}' for n, c in sweeps)}, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY bar_seq) AS INT) AS ha_streak FROM c3)""",
        f"""c5 AS MATERIALIZED (SELECT *, {flag(f'sum(is_hh + is_hl - is_lh - is_ll) OVER {frame(20)} > 0')} AS market_structure,
  {', '.join(f"CAST(coalesce({full('sum', some, n)}, 0) AS INT) AS smc_activity_{n}" for n in (5, 10))} FROM c4)""",
    ]


def _compact() -> str:
    from tickloom.operators.compact import NAMES

    filled = ", ".join(f"round(coalesce({before(f'{n} IS NOT NULL', n, own=True)}, 0), 6) AS {n}" for n in NAMES)
    return given(*compact_blocks()) + f" SELECT {_KEYS}, {_PRICES}, {filled} FROM c5"


def _features() -> dict[str, str]:
    counted = ["is_pivot_high", "is_pivot_low", "is_hh", "is_ll", "is_choch", "is_bos", "is_idm", "is_ob", "is_sweep", "is_fvg"]
    some = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(sum({f}) AS BIGINT) AS n, round(sum({f}) * 100.0 / count(*), 6) AS percent FROM s" for f in counted)
    return {
        "structure_features": given(*structure_blocks()) + f" SELECT {_KEYS}, {_PRICES}, volume, {', '.join(_STRUCTURE)}, {rounded(_MEASURES)} FROM s",
        "structure_summary": given(*structure_blocks()) + " " + some,
        "compact_features": _compact(),
    }


# --- trades by what indicators say, scores --------------------------------------------------------------------------------

#: By bar: what the conditioned insights look at.
_ENTRY = [
    walk("e", {**rsi(14), **macd(), **adx(), **{k: v for n in (8, 13, 21, 50, 200) for k, v in ema(n).items()}}), JOINED,
    f"""y1 AS (SELECT *, {rsi_of(14)} AS rsi, mf - ms AS macd, mg AS macd_signal, mf - ms - mg AS macd_hist, {PLUS_DI} AS pdi, {MINUS_DI} AS mdi,
  100 * (close - ({full('min', 'low', 14)})) / nullif(({full('max', 'high', 14)}) - ({full('min', 'low', 14)}), 0) AS k FROM m)""",
    f"y AS MATERIALIZED (SELECT *, {full('avg', 'k', 3)} AS kd FROM y1)",
    """j AS MATERIALIZED (
  SELECT t.symbol, t.trade_id, t.side = 'long' AS lg, t.entry_time, t.pnl > 0 AS won, y.* EXCLUDE (symbol), abs((close - ema_21) / nullif(close, 0)) AS d21, abs((close - ema_50) / nullif(close, 0)) AS d50
  FROM t ASOF LEFT JOIN y ON t.symbol = y.symbol AND t.entry_time >= y.ts WHERE rsi IS NOT NULL AND macd IS NOT NULL AND adx IS NOT NULL
), md AS (SELECT symbol, quantile_cont(d21, 0.5) AS m21, quantile_cont(d50, 0.5) AS m50, count(d21) AS k21, count(d50) AS k50, count(*) AS n, count(*) FILTER (won) AS w FROM j GROUP BY 1
), jj AS MATERIALIZED (SELECT j.*, m21, m50, k21, k50 FROM j JOIN md USING (symbol))""",
]


def _conditions() -> list[tuple[str, str, str]]:
    def sided(a: str, b: str) -> str:
        return f"CASE WHEN lg THEN {a} ELSE {b} END"

    def stack(*n: int) -> tuple[str, str]:
        a, b, c = (f"ema_{x}" for x in n)
        return f"({a} > {b} AND {b} > {c})", f"({a} < {b} AND {b} < {c})"

    out = [("rsi_extremes", f"{k}", sided(f"rsi < {100 - k}", f"rsi > {k}")) for k in range(70, 100, 5)]
    out += [("macd", "direction", sided("macd > macd_signal", "macd < macd_signal")), ("macd", "zero", sided("macd > 0", "macd < 0")), ("macd", "histogram", sided("macd_hist > 0", "macd_hist < 0"))]
    out += [("adx_gt", f"{k}", f"adx > {k}") for k in range(15, 55, 5)] + [("adx_ge", f"{k}", f"adx >= {k}") for k in (15, 20, 25)]
    out += [("adx_di", "long", "lg AND pdi > mdi AND adx > 25"), ("adx_di", "short", "NOT lg AND pdi < mdi AND adx > 25"), ("adx_di", "both", f"({sided('pdi > mdi', 'pdi < mdi')}) AND adx > 25")]
    out += [("stochastic", f"{k}", sided(f"k < {k} AND kd < {k}", f"k > {100 - k} AND kd > {100 - k}")) for k in range(10, 35, 5)]
    up, down = stack(8, 21, 50)
    out += [("ema", "8>21>50", sided(up, down)), ("ema", "8>13>21", sided(*stack(8, 13, 21))), ("ema", "21>50>200", sided(*stack(21, 50, 200))), ("ema", "price_21", sided("close > ema_21", "close < ema_21")), ("ema", "counter", sided(down, up))]
    out += [("distance", f"{n}_{w}", f"k{n} >= 20 AND d{n} {op} m{n}") for n in (21, 50) for w, op in (("near", "<="), ("far", ">"))]
    return [*out, ("trend", "with", sided("close > ema_200", "NOT (close > ema_200)")), ("trend", "counter", sided("NOT (close > ema_200)", "close > ema_200")), ("hours", "13-16", "hour(entry_time) BETWEEN 13 AND 16")]


def _technical() -> list[str]:
    counts = " UNION ALL ".join(f"SELECT symbol, '{t}' AS test, '{n}' AS label, count(*) FILTER (coalesce({c}, false)) AS trades, count(*) FILTER (coalesce({c}, false) AND won) AS w FROM jj GROUP BY 1" for t, n, c in _conditions())
    return [TRADES, *_ENTRY, f"q AS ({counts})", """tb AS MATERIALIZED (
  SELECT q.symbol, '1h' AS tf, test, label, trades, coalesce(100.0 * q.w / nullif(trades, 0), 0) AS win_rate_pct,
    CASE WHEN trades > 0 THEN (q.w / trades - md.w / md.n) * 100 ELSE 0 END AS improvement_vs_base_pct, 100.0 * trades / md.n AS retention_pct
  FROM q JOIN md USING (symbol) WHERE md.n >= 10
)"""]


_RULES = """rx AS (
  SELECT symbol, 'session' AS kind, CASE WHEN hour(entry_time) BETWEEN 8 AND 12 THEN 'London' WHEN hour(entry_time) BETWEEN 13 AND 15 THEN 'Overlap'
    WHEN hour(entry_time) BETWEEN 16 AND 21 THEN 'US' ELSE 'Asian' END AS bucket, pnl FROM t
  UNION ALL SELECT symbol, 'hour', CAST(hour(entry_time) AS VARCHAR), pnl FROM t
  UNION ALL SELECT symbol, 'weekday', ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(entry_time)], pnl FROM t
), rb AS (SELECT symbol, count(*) AS n, count(*) FILTER (pnl > 0) / count(*) AS wr FROM t GROUP BY 1
), ri AS MATERIALIZED (
  SELECT rx.symbol, kind, bucket, count(*) AS trades, 100.0 * count(*) FILTER (pnl > 0) / count(*) AS win_rate_pct, (count(*) FILTER (pnl > 0) / count(*) - any_value(wr)) * 100 AS imp
  FROM rx JOIN rb USING (symbol) GROUP BY 1, 2, 3
)"""


def _insights() -> dict[str, str]:
    best = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {}) = 1"
    return {
        "insight_rules": given(TRADES, _RULES, f"""ok AS (SELECT * FROM ri WHERE trades >= 5),
  hi AS (SELECT * FROM ok WHERE kind = 'session' {best.format('win_rate_pct DESC, trades DESC, bucket DESC')}), lo AS (SELECT * FROM ok WHERE kind = 'session' {best.format('win_rate_pct, trades DESC, bucket')}),
  wd AS (SELECT * FROM ok WHERE kind = 'weekday' {best.format('win_rate_pct DESC, trades DESC, bucket DESC')})""") + """
SELECT symbol, 'best_session' AS rule, hi.bucket, round(hi.win_rate_pct, 6) AS win_rate_pct, hi.trades FROM hi JOIN lo USING (symbol) WHERE hi.bucket <> lo.bucket
UNION ALL SELECT symbol, 'worst_session', lo.bucket, round(lo.win_rate_pct, 6), lo.trades FROM hi JOIN lo USING (symbol) WHERE hi.bucket <> lo.bucket
UNION ALL SELECT symbol, 'best_weekday', bucket, round(win_rate_pct, 6), trades FROM wd""",
        "technical_insights": given(*_technical()) + f" SELECT symbol, tf, test, label, trades, {rounded(['win_rate_pct', 'improvement_vs_base_pct', 'retention_pct'])} FROM tb",
        "insight_highlights": given(*_technical()) + """
SELECT symbol, tf, test, label, round(win_rate_pct, 6) AS win_rate_pct, trades FROM tb WHERE test IN ('rsi_extremes', 'adx_gt') AND trades >= 30
  QUALIFY row_number() OVER (PARTITION BY symbol, test ORDER BY win_rate_pct DESC, trades DESC) = 1
UNION ALL SELECT symbol, tf, test, label, round(win_rate_pct, 6), trades FROM tb WHERE test = 'trend' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY win_rate_pct DESC, label DESC) = 1""",
        "spotlights": given(*_technical(), _RULES, """sc AS (
  SELECT symbol, kind AS test, bucket AS label, trades, win_rate_pct, imp, 'time' AS category FROM ri WHERE kind IN ('session', 'hour')
  UNION ALL SELECT symbol, test, label, trades, win_rate_pct, improvement_vs_base_pct, 'indicator' FROM tb WHERE test IN ('macd', 'adx_gt', 'rsi_extremes')
), sd2 AS (
  SELECT sc.*, imp * ln(1 + trades) * CASE test WHEN 'hour' THEN 0.92 WHEN 'adx_gt' THEN 1.05 ELSE 1 END AS score FROM sc JOIN rb USING (symbol)
  WHERE n >= 15 AND trades >= greatest(8, least(40, floor(0.04 * n + 10))) AND imp >= 0.75
), se AS (SELECT * FROM sd2 QUALIFY test <> 'hour' OR row_number() OVER (PARTITION BY symbol, test ORDER BY imp DESC, TRY_CAST(label AS INT)) = 1
), sf AS (SELECT *, row_number() OVER w AS r, first_value(category) OVER w AS top FROM se WINDOW w AS (PARTITION BY symbol ORDER BY score DESC, test, label)
), sg AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN r = 1 THEN 0 WHEN category <> top THEN 1 ELSE 2 END, r) AS rank FROM sf)""") + f"""
SELECT symbol, '1h' AS tf, CAST(rank AS INT) AS rank, category, test, label, trades, {rounded(['win_rate_pct', 'imp', 'score'])} FROM sg WHERE rank <= 2""",
    }


_CONTEXT = ["rsi_14", "adx_14", "atr_pct", "bb_pos", "ret_5", "ret_20", "ema_diff_pct", "vol_ratio"]


def _scores() -> dict[str, str]:
    clamp = "greatest(0, least(1, {}))"
    mid, sd = full("avg", "close", 20), full("stddev_samp", "close", 20)
    made = {"rsi_14": rsi_of(14), "adx_14": "adx", "atr_pct": "atr / nullif(close, 0)", "bb_pos": f"(close - (({mid}) - 2 * ({sd}))) / nullif(4 * ({sd}), 0)", "ret_5": change("close", 5), "ret_20": change("close", 20), "ema_diff_pct": "(ema_9 - ema_50) / nullif(close, 0)", "vol_ratio": f"volume / nullif({full('avg', 'volume', 20)}, 0)"}
    assert list(made) == _CONTEXT
    fallback = clamp.format("0.5 + greatest(-0.2, least(0.2, trend_strength / 12.0)) + greatest(0, least(0.12, (smc_activity_score_5 + smc_activity_score_10) * 0.015)) + 0.05 * least(1, is_bos_bullish + is_bos_bearish)")
    context = clamp.format("""0.5 + CASE WHEN adx_14 >= 25 THEN 0.1 WHEN adx_14 < 15 THEN -0.1 ELSE 0 END + CASE WHEN CASE WHEN lg THEN ema_diff_pct > 0 ELSE ema_diff_pct < 0 END THEN 0.1 ELSE -0.1 END
  + CASE WHEN rsi_14 BETWEEN 40 AND 60 THEN 0.05 WHEN rsi_14 >= 80 OR rsi_14 <= 20 THEN -0.1 ELSE 0 END + CASE WHEN bb_pos BETWEEN 0.3 AND 0.7 THEN 0.05 WHEN bb_pos >= 1 OR bb_pos <= 0 THEN -0.05 ELSE 0 END
  + CASE WHEN atr_pct > 0.03 THEN -0.05 ELSE 0 END""")
    return {
        "fallback_scores": given(TRADES, *structure_blocks()) + f" SELECT t.symbol, t.trade_id, round(CASE WHEN s.bar_seq >= 1 THEN {fallback} ELSE 0.5 END, 6) AS score FROM t ASOF LEFT JOIN s ON t.symbol = s.symbol AND t.entry_time >= s.ts",
        "context_scores": given(
            TRADES, walk("e", {**rsi(14), **adx(), **atr(), **ema(9), **ema(50)}), JOINED, f"y AS MATERIALIZED (SELECT symbol, ts, {', '.join(f'{x} AS {n}' for n, x in made.items())} FROM m)",
            f"j AS MATERIALIZED (SELECT t.symbol, t.trade_id, t.side = 'long' AS lg, {', '.join(_CONTEXT)} FROM t ASOF JOIN y ON t.symbol = y.symbol AND t.entry_time >= y.ts)",
            f"md AS (SELECT symbol, {', '.join(f'quantile_cont({n}, 0.5) AS m_{n}' for n in _CONTEXT)} FROM j GROUP BY 1)",
            f"o AS (SELECT symbol, trade_id, lg, {', '.join(f'coalesce({n}, m_{n}, 0) AS {n}' for n in _CONTEXT)} FROM j JOIN md USING (symbol))",
        ) + f" SELECT symbol, trade_id, round({context}, 6) AS score FROM o",
        "choose_threshold": given(TRADES, """th AS (SELECT round(unnest(range(1, 50)) / 50.0, 2) AS threshold
), kp AS (SELECT symbol, threshold, count(*) FILTER (score >= threshold) AS kept, count(*) AS n, coalesce(sum(pnl) FILTER (score >= threshold), 0) AS total_points FROM t CROSS JOIN th GROUP BY 1, 2
), ex AS (
  SELECT t.symbol, threshold, coalesce(b.bar_seq, 0) AS bar_seq, sum(t.pnl) AS pnl
  FROM (SELECT * FROM t CROSS JOIN th WHERE score >= threshold) t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.exit_time >= b.ts GROUP BY 1, 2, 3
), cu AS (
  SELECT b.symbol, th.threshold, b.bar_seq, 100000 + coalesce(sum(ex.pnl) OVER (PARTITION BY b.symbol, th.threshold ORDER BY b.bar_seq ROWS UNBOUNDED PRECEDING), 0) AS eq
  FROM bars b CROSS JOIN th LEFT JOIN ex ON ex.symbol = b.symbol AND ex.threshold = th.threshold AND ex.bar_seq = b.bar_seq
), cr AS (SELECT symbol, threshold, eq / lag(eq) OVER (PARTITION BY symbol, threshold ORDER BY bar_seq) - 1 AS r FROM cu
), sh AS (SELECT symbol, threshold, CASE WHEN stddev_pop(r) > 0 THEN sqrt(252) * avg(r) / stddev_pop(r) ELSE 0 END AS sharpe_ratio FROM cr GROUP BY 1, 2)""") + """
SELECT symbol, '1h' AS tf, threshold, kept, round(total_points, 6) AS total_points, round(sharpe_ratio, 6) AS sharpe_ratio FROM kp JOIN sh USING (symbol, threshold)
WHERE kept >= greatest(1, floor(0.1 * n)) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(total_points, 9) DESC, sharpe_ratio DESC, threshold) = 1""",
    }


# --- flags ----------------------------------------------------------------------------------------------------------------


def seeded(k: str, seed: str, at: int, step: str) -> tuple[str, str]:
    """Null before bar ``at``, there its seed, then the step."""
    return ("NULL" if at else seed), f"CASE WHEN b.bar_seq < {at} THEN NULL WHEN b.bar_seq = {at} THEN {seed} ELSE {step} END"


def _flag_memory() -> tuple[str, dict]:
    """Seeds by window (block ``sd``), and the states that begin with them."""
    emas = (8, 13, 21, 34, 50, 200)
    seeds = {f"e{n}": f"avg(close) OVER {frame(n)}" for n in emas} | {"q12": f"avg(close) OVER {frame(12)}", "q26": f"avg(close) OVER {frame(26)}"}
    seeds |= {f"{s}{n}": f"avg({x}) OVER {frame(n)}" for n in (14, 21) for s, x in (("u", "greatest(dc, 0)"), ("w", "greatest(-dc, 0)"))}
    moves = {"pm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "nm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"}
    seeds |= {f"{k}13": f"sum({x}) OVER {frame(13)}" for k, x in (*moves.items(), ("tr", "tr"))} | {"tr14": f"avg(tr) OVER {frame(14)}"}
    block = "sd AS MATERIALIZED (SELECT *, " + ", ".join(f"{x} AS seed_{k}" for k, x in seeds.items()) + " FROM d)"
    st = {f"ema_{n}": seeded("", f"b.seed_e{n}", n - 1, f"e.ema_{n} + 2.0/{n + 1} * (b.close - e.ema_{n})") for n in emas}
    for n in (14, 21):
        st |= {f"{s}{n}": seeded("", f"b.seed_{s}{n}", n, f"e.{s}{n} + 1.0/{n} * ({x} - e.{s}{n})") for s, x in (("u", "greatest(b.dc, 0)"), ("w", "greatest(-b.dc, 0)"))}
    fast, slow = (seeded("", f"b.seed_q{n}", 25, f"e.m{n} + 2.0/{n + 1} * (b.close - e.m{n})") for n in (12, 26))
    line = f"(({fast[1]}) - ({slow[1]}))"
    st |= {"m12": fast, "m26": slow, "msum": ("0", f"CASE WHEN b.bar_seq BETWEEN 25 AND 33 THEN e.msum + {line} ELSE e.msum END"), "msig": ("NULL", f"CASE WHEN b.bar_seq < 33 THEN NULL WHEN b.bar_seq = 33 THEN (e.msum + {line}) / 9 ELSE e.msig + 0.2 * ({line} - e.msig) END")}
    sums = {k: seeded("", f"b.seed_{k}13", 13, f"e.{k} - e.{k} / 14 + ({x})") for k, x in (("pm", moves["pm"].replace("up", "b.up").replace("dn", "b.dn")), ("nm", moves["nm"].replace("up", "b.up").replace("dn", "b.dn")), ("tr", "b.tr"))}
    st |= {f"{k}s": (a, x.replace(f"e.{k}", f"e.{k}s")) for k, (a, x) in sums.items()}
    pdi, mdi = (f"(100 * ({st[k][1]}) / nullif({st['trs'][1]}, 0))" for k in ("pms", "nms"))
    dx = f"(100 * abs({pdi} - {mdi}) / nullif({pdi} + {mdi}, 0))"
    st |= {"xsum": ("0", f"CASE WHEN b.bar_seq BETWEEN 14 AND 27 THEN e.xsum + {dx} ELSE e.xsum END"), "adx": ("NULL", f"CASE WHEN b.bar_seq < 27 THEN NULL WHEN b.bar_seq = 27 THEN (e.xsum + {dx}) / 14 ELSE e.adx + 1.0/14 * ({dx} - e.adx) END")}
    st |= {"atr": seeded("", "b.seed_tr14", 14, "e.atr + 1.0/14 * (b.tr - e.atr)")}
    return block, st | {"kal": ("b.close", "e.kal + (e.kv + 0.01) / (e.kv + 1.01) * (b.close - e.kal)"), "kv": ("1", "(e.kv + 0.01) * (1 - (e.kv + 0.01) / (e.kv + 1.01))")}


def _over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def flag_blocks() -> list[str]:
    """Up to ``v``: bars with all that the flags of the families compare."""
    block, states = _flag_memory()
    one = {
        "rsi_14": "CASE WHEN u14 + w14 = 0 THEN 0 ELSE 100 * u14 / (u14 + w14) END", "rsi_21": "CASE WHEN u21 + w21 = 0 THEN 0 ELSE 100 * u21 / (u21 + w21) END",
        "macd": "CASE WHEN msig IS NOT NULL THEN m12 - m26 END", "macd_sig": "msig", "pdi": f"CASE WHEN bar_seq >= 14 THEN {_over('100 * pms', 'trs')} END", "mdi": f"CASE WHEN bar_seq >= 14 THEN {_over('100 * nms', 'trs')} END",
        "atr_pct": _over("atr", "close"), "tr_pct": _over("tr", "close"), "hl_pct": _over("high - low", "close"), "tp": "(high + low + close) / 3",
        "c1x": change("close"), **{f"c{n}": change("close", n) for n in (2, 3, 5, 10, 12, 20, 60, 120, 240)}, "v1": change("volume"), "v5": change("volume", 5), "v12": change("volume", 12),
        "vm": full("avg", "volume", 20), "vs": full("stddev_samp", "volume", 20), "mid": full("avg", "close", 20), "sdp": full("stddev_pop", "close", 20),
        "z50": _over(f"close - ({full('avg', 'close', 50)})", full("stddev_samp", "close", 50)),
        **{f"hh{n}": full("max", "high", n) for n in (14, 20, 50, 72, 100, 288)}, **{f"ll{n}": full("min", "low", n) for n in (14, 20, 50, 72, 100, 288)},
        **{f"far{n}": _over(f"abs(close - ema_{n})", "close") for n in (8, 21, 50, 200)}, **{f"sep{a}_{b}": _over(f"abs(ema_{a} - ema_{b})", "close") for a, b in ((8, 21), (13, 34), (50, 200))},
        "kd1": f"kal - {lag('kal')}", "slope": _over(f"ema_21 - {lag('ema_21')}", "close"), "step": "CASE WHEN dc > 0 THEN volume WHEN dc < 0 THEN -volume WHEN bar_seq = 0 THEN volume ELSE 0 END",
    }
    two = {
        "bbw": _over("4 * sdp", "mid"), "bbu": "mid + 2 * sdp", "bbd": "mid - 2 * sdp", "raw_k": _over("100 * (close - ll14)", "hh14 - ll14"), "wr": _over("-100 * (hh14 - close)", "hh14 - ll14"),
        "move1": "abs(c1x)", **{f"move{n}": f"abs(c{n})" for n in (3, 5, 10)}, "span20": _over("hh20 - ll20", "close"), "span50": _over("hh50 - ll50", "close"), "kal_step": "abs(kd1)",
        "eff": f"CASE WHEN v12 > 0 THEN {_over('abs(c12)', 'v12')} ELSE 0 END", "obv": f"sum(step) OVER ({S} ROWS UNBOUNDED PRECEDING)", "tpd": f"tp - {lag('tp')}",
        "tps": f"list(tp) OVER {frame(14)}", "tpm": full("avg", "tp", 14), **{f"{x}_1": lag(x) for x in ("macd", "macd_sig", "pdi", "mdi", "rsi_14", "rsi_21", "ema_8", "ema_13", "ema_21", "ema_34", "ema_50", "ema_200", "hh20", "ll20", "hh50", "ll50", "vm", "vs", "volume", "kd1", "hh288", "ll288", "c5", "c12")},
        "rsi_14_2": lag("rsi_14", 2), "rsi_21_2": lag("rsi_21", 2), "h2": lag("high", 2), "l2": lag("low", 2), "h3": lag("high", 3), "l3": lag("low", 3), **{f"{x}_2": lag(x, 2) for x in ("hh20", "ll20", "hh50", "ll50")},
    }
    ranks = {"atr100": ("atr_pct", 100), "atr_own100": ("atr", 100), "tr50": ("tr_pct", 50), "move50": ("move1", 50), "range100": ("hl_pct", 100), "bbw50": ("bbw", 50), "bbw100": ("bbw", 100), "span20": ("span20", 100), "span50": ("span50", 100), "rsi200": ("rsi_14", 200), "ema21_100": ("far21", 100), "kal50": ("kal_step", 50)}
    quants = {f"sep{a}_{b}_{int(p * 100)}": (f"sep{a}_{b}", 50, p) for a, b in ((8, 21), (13, 34), (50, 200)) for p in (0.7, 0.3)} | {f"far{n}_{int(p * 100)}": (f"far{n}", 50, p) for n in (8, 21, 50, 200) for p in (0.8, 0.2)}
    quants |= {f"move{n}_{int(p * 100)}": (f"move{n}", 50, p) for n in (3, 5, 10) for p in (0.75, 0.25)} | {"impulse": ("move5", 100, 0.8), "displace": ("move3", 50, 0.85), "absorb": ("move1", 20, 0.3)}
    three = {f"r_{k}": rank(x, n) for k, (x, n) in ranks.items()} | {f"q_{k}": quantile(x, n, p) for k, (x, n, p) in quants.items()} | {
        "k": full("avg", "raw_k", 3), "cci": f"CASE WHEN len(tps) = 14 THEN {_over('tp - tpm', '0.015 * list_avg(list_transform(tps, lambda v: abs(v - tpm)))')} END",
        "mp": f"sum(CASE WHEN tpd > 0 THEN tp * volume ELSE 0 END) OVER {frame(14)}", "mn": f"sum(CASE WHEN tpd < 0 THEN tp * volume ELSE 0 END) OVER {frame(14)}",
        "eff_top": "coalesce(quantile_cont(CASE WHEN eff > 0 THEN eff END, 0.8) OVER (PARTITION BY symbol), 0)",
    }
    four = {"dk": full("avg", "k", 3), "mfi": f"CASE WHEN bar_seq >= 14 THEN {_over('100 * mp', 'mp + mn')} END", "k_1": lag("k")}
    out, source = [block, walk("e", states, "sd"), "m AS MATERIALIZED (SELECT d.*, e.* EXCLUDE (symbol, bar_seq) FROM d JOIN e USING (symbol, bar_seq))"], "m"
    for name, cols in (("v1x", one), ("v2x", two), ("v3x", three), ("v4x", four)):
        out.append(f"{name} AS MATERIALIZED (SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in cols.items()) + f" FROM {source})")
        source = name
    return [*out, f"v AS MATERIALIZED (SELECT *, {lag('dk')} AS dk_1 FROM v4x)"]


def _crossed(a: str, b: str, up: str, down: str) -> dict[str, str]:
    return {up: f"{a} > {b} AND {a}_1 <= {b}_1", down: f"{a} < {b} AND {a}_1 >= {b}_1"}


def _extremes(x: str, name: str, low: float, high: float, lowest: float, highest: float) -> dict[str, str]:
    return {f"{name}_oversold": f"{x} < {low}", f"{name}_overbought": f"{x} > {high}", f"{name}_extreme_oversold": f"{x} < {lowest}", f"{name}_extreme_overbought": f"{x} > {highest}"}


def _thirds(x: str, names: tuple[str, str, str], low: float, high: float) -> dict[str, str]:
    return dict(zip(names, (f"{x} < {low}", f"{x} BETWEEN {low} AND {high}", f"{x} > {high}"), strict=True))


def _trend_flags() -> dict[str, str]:
    out = {}
    for a, b in ((8, 21), (13, 34), (50, 200)):
        x, y, p = f"ema_{a}", f"ema_{b}", f"{a}_{b}"
        out |= {f"ema_trend_{p}_bullish": f"{x} > {y}", f"ema_trend_{p}_bearish": f"{x} < {y}", f"ema_strong_trend_{p}": f"sep{p} > q_sep{p}_70", f"ema_weak_trend_{p}": f"sep{p} < q_sep{p}_30"}
        out |= _crossed(x, y, f"ema_bullish_cross_{p}", f"ema_bearish_cross_{p}")
    for n in (8, 21, 50, 200):
        out |= {f"price_above_ema_{n}": f"close > ema_{n}", f"price_below_ema_{n}": f"close < ema_{n}", f"price_far_from_ema_{n}": f"far{n} > q_far{n}_80", f"price_near_ema_{n}": f"far{n} < q_far{n}_20"}
    up, down = "coalesce(ema_8 > ema_21 AND ema_21 > ema_50, false)", "coalesce(ema_8 < ema_21 AND ema_21 < ema_50, false)"
    return out | {
        "adx_strong_trend": "adx > 25", "adx_weak_trend": "adx BETWEEN 20 AND 25", "adx_no_trend": "adx < 20", "adx_very_strong_trend": "adx > 40", "adx_bullish_direction": "pdi > mdi", "adx_bearish_direction": "pdi < mdi",
        **_crossed("pdi", "mdi", "di_bullish_cross", "di_bearish_cross"), "ma_bullish_alignment": up, "ma_bearish_alignment": down, "ma_mixed_alignment": f"NOT {up} AND NOT {down}",
        "trend_strength_weak": "adx < 25", "trend_strength_moderate": "adx >= 25 AND adx < 50", "trend_strength_strong": "adx >= 50",
    }


def _momentum_flags() -> dict[str, str]:
    out = {}
    for n in (14, 21):
        r, p, p2 = f"rsi_{n}", f"rsi_{n}_1", f"rsi_{n}_2"
        out |= _extremes(r, r, 30, 70, 20, 80) | {
            f"{r}_weak_bearish": f"{r} >= 30 AND {r} < 40", f"{r}_neutral": f"{r} BETWEEN 40 AND 60", f"{r}_weak_bullish": f"{r} > 60 AND {r} <= 70", f"{r}_rising": f"{r} - {p} > 0", f"{r}_falling": f"{r} - {p} < 0",
            f"{r}_accelerating_up": f"{r} - {p} > {p} - {p2}", f"{r}_accelerating_down": f"{r} - {p} < {p} - {p2}", f"{r}_reversal_from_oversold": f"{r} > 30 AND {p} <= 30", f"{r}_reversal_from_overbought": f"{r} < 70 AND {p} >= 70",
        }
    g, g1 = "macd - macd_sig", "macd_1 - macd_sig_1"
    out |= {"macd_bullish": "macd > macd_sig", "macd_bearish": "macd < macd_sig", "macd_histogram_positive": f"{g} > 0", "macd_histogram_negative": f"{g} < 0", "macd_histogram_increasing": f"{g} > {g1}", "macd_histogram_decreasing": f"{g} < {g1}", "macd_above_zero": "macd > 0", "macd_below_zero": "macd < 0"}
    out |= _crossed("macd", "macd_sig", "macd_bullish_cross", "macd_bearish_cross") | _extremes("k", "stoch", 20, 80, 10, 90) | {"stoch_rising": "k > k_1", "stoch_falling": "k < k_1"} | _crossed("k", "dk", "stoch_bullish_cross", "stoch_bearish_cross")
    out |= _extremes("wr", "williams", -80, -20, -90, -10) | _extremes("cci", "cci", -100, 100, -200, 200) | {"cci_neutral": "cci BETWEEN -100 AND 100"} | _extremes("mfi", "mfi", 20, 80, 10, 90)
    second = "(rsi_14 - rsi_14_1) - (rsi_14_1 - rsi_14_2)"
    return out | {"momentum_accelerating_up": f"{second} > 0", "momentum_accelerating_down": f"{second} < 0", "rsi_reversal_bullish": "rsi_14 > 30 AND rsi_14_1 <= 30 AND rsi_14_2 <= 30", "rsi_reversal_bearish": "rsi_14 < 70 AND rsi_14_1 >= 70 AND rsi_14_2 >= 70"}


def _volatility_flags() -> dict[str, str]:
    a, t, mv, rel = "r_atr100", "r_tr50", "r_move50", "atr_pct"
    sd = f"({full('stddev_samp', 'slope', 50)})"
    out = _thirds(a, ("volatility_low", "volatility_normal", "volatility_high"), 0.25, 0.75) | _thirds(t, ("range_small", "range_normal", "range_large"), 0.33, 0.66) | _thirds(mv, ("movement_small", "movement_normal", "movement_large"), 0.33, 0.66)
    out |= _thirds(a, ("volatility_regime_low", "volatility_regime_medium", "volatility_regime_high"), 0.33, 0.66)
    return out | {
        "volatility_extreme": f"{a} > 0.9", "range_extreme": f"{t} > 0.9", "volatility_regime_extreme": f"{a} > 0.9",
        "consistent_upward_movement": f"bar_seq >= 4 AND sum({flag('c1x > 0')}) OVER {frame(5)} >= 4", "consistent_downward_movement": f"bar_seq >= 4 AND sum({flag('c1x < 0')}) OVER {frame(5)} >= 4",
        "volatility_expanding": f"{rel} > {full('avg', rel, 20)}", "volatility_contracting": f"{rel} < {full('avg', rel, 20)}", "low_volatility_period": f"{rel} < ({full('avg', rel, 50)}) * 0.5", "high_volatility_period": f"{rel} > ({full('avg', rel, 50)}) * 1.5",
        "trend_slope_flat": f"abs(slope) < {sd} * 0.5", "trend_slope_moderate": f"abs(slope) >= {sd} * 0.5 AND abs(slope) < {sd} * 1.5", "trend_slope_steep": f"abs(slope) >= {sd} * 1.5",
    }


def _volume_flags() -> dict[str, str]:
    up, vup = flag("c1x > 0"), flag("volume > vm")
    sd = f"({full('stddev_samp', 'move1', 20)})"
    grew, rose = (f"sum({flag(f'{x} > {x1}')}) OVER {frame(5)}" for x, x1 in (("volume", "volume_1"), ("close", "c1")))
    return {
        "volume_normal": "volume <= vm + vs", "volume_above_average": "volume > vm AND volume <= vm + 2 * vs", "volume_surge": "volume > vm + 2 * vs", "volume_extreme_surge": "volume > vm + 3 * vs", "volume_low": "volume < vm - vs",
        "volume_increasing": "v1 > 0", "volume_decreasing": "v1 < 0", "volume_stable": "abs(v1) < 0.1", "volume_price_confirmed_up": f"{up} = 1 AND {vup} = 1", "volume_price_confirmed_down": f"{up} = 0 AND {vup} = 1", "volume_price_unconfirmed": f"{up} <> {vup}",
        "obv_rising": f"obv > {full('avg', 'obv', 20)}", "obv_falling": f"obv < {full('avg', 'obv', 20)}", "obv_momentum_up": f"obv - {lag('obv')} > 0", "obv_momentum_down": f"obv - {lag('obv')} < 0",
        "volume_spike_small_movement": f"volume > vm + 2 * vs AND move1 < 0.5 * {sd}", "volume_spike_large_movement": f"volume > vm + 2 * vs AND move1 > 1.5 * {sd}", "decreasing_volume_trend_continuation": f"bar_seq >= 4 AND {grew} <= 2 AND {rose} >= 4",
        "high_volume_efficiency": "false", "low_volume_efficiency": "false", "climax_volume_reversal": f"volume_1 > vm_1 + 3 * vs_1 AND c1x * {lag('c1x')} < 0",
        "stealth_accumulation": f"abs(c10) < 0.005 AND {full('avg', 'volume', 10)} > vm * 1.2", "volume_momentum_divergence": "v5 * c5 < 0",
    }


def _range_flags() -> dict[str, str]:
    out = {}
    for n in (20, 50):
        hi, lo, hi1, lo1, hi2, lo2 = (f"{x}{n}{k}" for k in ("", "_1", "_2") for x in ("hh", "ll"))
        span, span1 = f"({hi} - {lo})", f"({hi1} - {lo1})"
        at = _over(f"close - {lo}", span)
        for k in ("236", "382", "500", "618", "786"):
            out[f"near_fib_{k}_{n}"] = _over(f"abs(close - ({hi} - 0.{k} * {span}))", "close") + " < 0.005"
        out |= _thirds(at, (f"in_lower_range_{n}", f"in_middle_range_{n}", f"in_upper_range_{n}"), 0.33, 0.66) | _thirds(f"r_span{n}", (f"narrow_range_{n}", f"normal_range_{n}", f"wide_range_{n}"), 0.25, 0.75) | {
            f"near_resistance_{n}": _over(f"{hi} - close", "close") + " < 0.01", f"at_resistance_{n}": _over(f"{hi} - close", "close") + " < 0.005", f"near_support_{n}": _over(f"close - {lo}", "close") + " < 0.01", f"at_support_{n}": _over(f"close - {lo}", "close") + " < 0.005",
            f"breakout_above_resistance_{n}": f"close > {hi} AND c1 <= {hi1}", f"breakdown_below_support_{n}": f"close < {lo} AND c1 >= {lo1}",
            f"in_fib_golden_zone_{n}": f"close BETWEEN {hi} - 0.618 * {span} AND {hi} - 0.786 * {span}", f"above_fib_618_{n}": f"close > {hi} - 0.618 * {span}", f"below_fib_382_{n}": f"close < {hi} - 0.382 * {span}",
            f"structure_break_bullish_{n}": f"close > {hi1} AND c1 <= {hi1}", f"structure_break_bearish_{n}": f"close < {lo1} AND c1 >= {lo1}", f"failed_breakout_above_{n}": f"high > {hi1} AND close < {hi1}", f"failed_breakdown_below_{n}": f"low < {lo1} AND close > {lo1}",
            f"strong_breakout_above_{n}": f"close > {hi1} + 0.1 * {span1}", f"strong_breakdown_below_{n}": f"close < {lo1} - 0.1 * {span1}", f"weak_breakout_above_{n}": f"close > {hi1} AND close <= {hi1} + 0.05 * {span1}", f"weak_breakdown_below_{n}": f"close < {lo1} AND close >= {lo1} - 0.05 * {span1}",
            f"in_consolidation_{n}": _over(f"abs(close - ({hi} + {lo}) / 2)", span) + " < 0.25", f"bos_bullish_{n}": f"close > {hi1} AND c1 <= {hi2}", f"bos_bearish_{n}": f"close < {lo1} AND c1 >= {lo2}",
            f"strong_bos_bullish_{n}": f"close > {hi1} + 0.1 * {span1} AND c1 <= {hi2}", f"strong_bos_bearish_{n}": f"close < {lo1} - 0.1 * {span1} AND c1 >= {lo2}",
        }
    for n in (10, 20):
        hi, lo = f"({full('max', 'high', n, 1)})", f"({full('min', 'low', n, 1)})"
        out |= {f"making_higher_high_{n}": f"high > {hi}", f"making_lower_low_{n}": f"low < {lo}", f"making_higher_low_{n}": f"low > {lo} AND l1 = {lo}", f"making_lower_high_{n}": f"high < {hi} AND h1 = {hi}"}
        for x, name in (("rsi_14", "rsi"), ("macd", "macd")):
            out |= {f"{name}_bullish_divergence_{n}": f"close < {lag('close', n)} AND {x} > {lag(x, n)}", f"{name}_bearish_divergence_{n}": f"close > {lag('close', n)} AND {x} < {lag(x, n)}"}
    for n in (20, 50, 100):
        out |= {f"price_clustered_middle_{n}": f"abs(close - (hh{n} + ll{n}) / 2) < (hh{n} - ll{n}) * 0.2", f"range_bound_tight_{n}": _over(f"hh{n} - ll{n}", "close") + " < 0.02", f"oscillating_pattern_{n}": f"abs(close - {lag('close', n // 4)}) < (hh{n} - ll{n}) * 0.3"}
    out |= {"local_high": "high > h1 AND h1 > h2", "local_low": "low < l1 AND l1 < l2", "local_high_confirmed": "h1 > h2 AND h1 > high AND h1 > h3", "local_low_confirmed": "l1 < l2 AND l1 < low AND l1 < l3"}
    chop = f"(CASE WHEN hh14 - ll14 > 0 THEN 100 * log10(({full('sum', 'atr', 14)}) / (hh14 - ll14)) / log10(14) END)"
    at = _over("close - ll72", "hh72 - ll72")
    return out | _thirds(chop, ("market_trending", "market_transitional", "market_choppy"), 38.2, 61.8) | {
        "near_daily_high": _over("hh288 - close", "close") + " < 0.01", "near_daily_low": _over("close - ll288", "close") + " < 0.01", "at_daily_high": _over("hh288 - close", "close") + " < 0.002", "at_daily_low": _over("close - ll288", "close") + " < 0.002",
        "daily_high_sweep": "high > hh288_1 AND close < hh288_1", "daily_low_sweep": "low < ll288_1 AND close > ll288_1", "above_session_high": "close > hh72", "below_session_low": "close < ll72",
        **_thirds(at, ("in_session_lower_third", "in_session_middle_third", "in_session_upper_third"), 0.33, 0.67),
    }


def _candle_flags() -> dict[str, str]:
    b, u, w = (_over(x, "high - low") for x in ("abs(close - open)", "high - greatest(open, close)", "least(open, close) - low"))
    bull, bear = "close > open", "close < open"
    gap = _over("greatest(low - h1, l1 - high)", "close")
    buy, sell = _over("close - low", "high - low"), _over("high - close", "high - low")

    def run(x: str, n: int) -> str:
        return f"sum({flag(x)}) OVER {frame(n)}"

    return {
        "small_body": f"{b} < 0.3", "medium_body": f"{b} BETWEEN 0.3 AND 0.7", "large_body": f"{b} > 0.7", "long_upper_shadow": f"{u} > 0.4", "long_lower_shadow": f"{w} > 0.4", "no_upper_shadow": f"{u} < 0.1", "no_lower_shadow": f"{w} < 0.1",
        "bullish_candle": bull, "bearish_candle": bear, "doji_candle": f"{b} < 0.1", "hammer_pattern": f"{b} < 0.3 AND {w} > 0.6 AND {u} < 0.2", "inverted_hammer_pattern": f"{b} < 0.3 AND {u} > 0.6 AND {w} < 0.2", "shooting_star_pattern": f"{bear} AND {u} > 0.6 AND {w} < 0.2",
        "bullish_marubozu": f"{bull} AND {u} < 0.05 AND {w} < 0.05", "bearish_marubozu": f"{bear} AND {u} < 0.05 AND {w} < 0.05", "spinning_top": f"{b} < 0.3 AND {u} > 0.3 AND {w} > 0.3",
        "bullish_engulfing": f"{bull} AND c1 < o1 AND open < c1 AND close > o1", "bearish_engulfing": f"{bear} AND c1 > o1 AND open > c1 AND close < o1", "inside_bar": "high <= h1 AND low >= l1", "outside_bar": "high >= h1 AND low <= l1",
        "consecutive_bullish_2": f"{bull} AND c1 > o1", "consecutive_bearish_2": f"{bear} AND c1 < o1", "consecutive_bullish_3": f"{run(bull, 3)} = 3", "consecutive_bearish_3": f"{run(bear, 3)} = 3",
        "large_candle_range": "r_range100 > 0.8", "extreme_candle_range": "r_range100 > 0.95", "efficient_candle": f"{b} > 0.7", "inefficient_candle": f"{b} < 0.3", "wick_dominated_candle": f"{u} + {w} > 0.6",
        "gap_up": "low > h1", "gap_down": "high < l1", "no_gap": "low <= h1 AND high >= l1", "small_gap": f"{gap} > 0 AND {gap} < 0.005", "medium_gap": f"{gap} >= 0.005 AND {gap} < 0.01", "large_gap": f"{gap} >= 0.01",
        "upper_wick_rejection": f"high - greatest(open, close) > 2 * abs(close - open) AND {bear}", "lower_wick_rejection": f"least(open, close) - low > 2 * abs(close - open) AND {bull}",
        "bullish_fvg_present": "low > h2 AND l1 > h2", "bearish_fvg_present": "high < l2 AND h1 < l2", "large_bullish_fvg": f"low > h2 AND l1 > h2 AND {_over('low - h2', 'close')} > 0.005", "large_bearish_fvg": f"high < l2 AND h1 < l2 AND {_over('l2 - high', 'close')} > 0.005",
        "buying_pressure_dominant": f"{buy} > 0.7", "selling_pressure_dominant": f"{sell} > 0.7", "balanced_pressure": f"{buy} > 0.3 AND {buy} < 0.7", "strong_bull_sequence": f"bar_seq >= 3 AND {run(bull, 4)} >= 3", "strong_bear_sequence": f"bar_seq >= 3 AND {run(bear, 4)} >= 3",
    }


def _band_flags() -> dict[str, str]:
    pct = _over("close - bbd", "bbu - bbd")
    return _thirds("r_bbw50", ("bb_squeeze", "bb_normal_width", "bb_expansion"), 0.2, 0.8) | {
        "above_bb_upper": "close > bbu", "below_bb_lower": "close < bbd", "between_bb_bands": "close <= bbu AND close >= bbd", "above_bb_middle": "close > mid", "below_bb_middle": "close < mid",
        "touching_bb_upper": "high >= bbu * 0.999", "touching_bb_lower": "low <= bbd * 1.001", "bb_reversal_from_upper": "close < bbu AND c1 >= bbu", "bb_reversal_from_lower": "close > bbd AND c1 <= bbd",
        "bb_percent_oversold": f"{pct} < 0.2", "bb_percent_overbought": f"{pct} > 0.8", "bb_percent_neutral": f"{pct} BETWEEN 0.4 AND 0.6", "price_3std_above_mean": "z50 > 3", "price_3std_below_mean": "z50 < -3", "price_2std_extreme": "abs(z50) > 2",
        "rsi_extreme_historical_context": "(rsi_14 < 20 AND r_rsi200 < 0.1) OR (rsi_14 > 80 AND r_rsi200 > 0.9)", "price_stretch_from_ema": "r_ema21_100 > 0.95",
        "bb_squeeze_expansion_potential": f"bar_seq >= 9 AND sum({flag('r_bbw100 < 0.2')}) OVER {frame(10)} >= 8", "volatility_compression_extreme": f"bar_seq >= 14 AND sum({flag('r_atr_own100 < 0.1')}) OVER {frame(15)} >= 12",
    }


def _time_flags() -> dict[str, str]:
    h = "hour(ts)"
    busy, start = f"volume > ({full('avg', 'volume', 72)}) * 1.5", f"{h} IN (8, 13)"
    asia, london = f"({h} >= 23 OR {h} < 8)", f"({h} >= 8 AND {h} < 16)"
    return {
        "asian_session": asia, "london_session": london, "us_session": f"{h} BETWEEN 13 AND 20", "overlap_session": f"{h} BETWEEN 13 AND 15", "high_liquidity_time": london, "low_liquidity_time": asia,
        **{n: f"isodow(ts) = {i}" for i, n in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday"), 1)},
        "london_open_volume_surge": f"{h} IN (8, 9) AND {busy}", "ny_open_volume_surge": f"{h} IN (13, 14) AND {busy}", "session_transition_momentum_shift": f"{start} AND abs(c12 - {lag('c12', 12)}) > 0.005",
        "london_open_significant_gap": f"{h} = 8 AND {_over('abs(open - c1)', 'atr')} > 0.5", "ny_open_volatility_spike": f"{h} IN (13, 14) AND atr > ({full('avg', 'atr', 48)}) * 1.5", "session_start_high_efficiency": f"{start} AND eff > eff_top",
    }


def _move_flags() -> dict[str, str]:
    out = {}
    for n in (3, 5, 10):
        out |= {f"strong_momentum_{n}": f"move{n} > q_move{n}_75", f"weak_momentum_{n}": f"move{n} < q_move{n}_25", f"positive_momentum_{n}": f"c{n} > 0", f"negative_momentum_{n}": f"c{n} < 0"}
    for n in (60, 120, 240):
        quick, slow = full("avg", "close", n // 4), full("avg", "close", n)
        out |= {f"htf_trend_bullish_{n}": f"({quick}) > ({slow})", f"htf_trend_bearish_{n}": f"({quick}) < ({slow})", f"htf_momentum_positive_{n}": f"c{n} > 0", f"htf_momentum_negative_{n}": f"c{n} < 0", f"htf_momentum_strong_{n}": f"abs(c{n}) > {full('stddev_samp', f'c{n}', n)}"}
    near = _over("abs(close - 50 * greatest(36, least(100, round(close / 50))))", "close")
    surge = f"volume > ({full('avg', 'volume', 20)}) * 1.5"
    turned = f"((kd1 > 0 AND kd1_1 <= 0) OR (kd1 < 0 AND kd1_1 >= 0))"
    return out | {
        "near_round_number": f"{near} < 0.005", "at_round_number": f"{near} < 0.001", "near_psychological_half": _over("abs(fmod(close, 50) - 25)", "close") + " < 0.002", "near_psychological_quarter": _over("abs(fmod(close, 25) - 12.5)", "close") + " < 0.001",
        "v_bottom_pattern": "c2 < -0.01 AND c1x > 0.01", "v_top_pattern": "c2 > 0.01 AND c1x < -0.01", "impulse_wave_up": "c5 > q_impulse", "impulse_wave_down": "c5 < -q_impulse",
        "correction_wave_up": "c5 > 0 AND c20 < 0 AND abs(c5) < q_impulse", "correction_wave_down": "c5 < 0 AND c20 > 0 AND abs(c5) < q_impulse",
        "three_wave_up": f"sum({flag('close > c1')}) OVER {frame(3)} = 3", "three_wave_down": f"sum({flag('close < c1')}) OVER {frame(3)} = 3", "choch_bullish": "c5 > 0.01 AND c20 < -0.01 AND c5_1 <= 0", "choch_bearish": "c5 < -0.01 AND c20 > 0.01 AND c5_1 >= 0",
        "bullish_displacement": f"c3 > q_displace AND {surge}", "bearish_displacement": f"c3 < -q_displace AND {surge}", "kalman_trend_bullish": "kd1 > 0", "kalman_trend_bearish": "kd1 < 0", "kalman_trend_strong": "r_kal50 > 0.8", "trend_regime_change_signal": f"{turned} AND volume > vm",
    }


FLAG_FAMILIES = {"trend": _trend_flags, "momentum": _momentum_flags, "volatility": _volatility_flags, "volume": _volume_flags, "ranges": _range_flags, "candles": _candle_flags, "bands": _band_flags, "time": _time_flags, "moves": _move_flags}


def _longer_blocks() -> list[str]:
    """Flags of longer bars, by bar: each bar has those of the longer bar that it is in, which know its last close."""
    out, sizes = [], {"1h": ("1 hour", 50, 5, 10), "4h": ("4 hours", 20, 3, 5), "1d": ("1 day", 10, 0, 0)}
    for t, (step, least, back, length) in sizes.items():
        out.append(f"""b{t} AS MATERIALIZED (
  SELECT *, row_number() OVER w - 1 AS bar_seq, close - lag(close) OVER w AS dc, count(*) OVER (PARTITION BY symbol) AS n
  FROM (SELECT symbol, time_bucket(INTERVAL '{step}', ts, TIMESTAMP '1970-01-01') AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY ts)
)""")
        spans = (20,) if t == "1d" else (21, 50)
        out.append(walk(f"a{t}", {k: (a, b) for n in spans for k, a, b in ((f"num{n}", "b.close", f"e.num{n} * (1 - 2.0/{n + 1}) + b.close"), (f"den{n}", "1", f"e.den{n} * (1 - 2.0/{n + 1}) + 1"))}, f"b{t}"))
        if t == "1d":
            made = {"trend_bullish": "close > num20 / den20", "trend_bearish": "NOT (close > num20 / den20)"}
            out.append(f"g{t} AS (SELECT b.symbol, b.ts, n > {least} AS long_enough, {', '.join(f'CAST(n > {least} AND {c} AS INT) AS htf_{t}_{k}' for k, c in made.items())} FROM b{t} b JOIN a{t} USING (symbol, bar_seq))")
            continue
        out.append(f"""w{t} AS (SELECT *, num21 / den21 AS quick, num50 / den50 AS slow, {full('avg', 'greatest(coalesce(dc, 0), 0)', 14)} AS gain, {full('avg', '-least(coalesce(dc, 0), 0)', 14)} AS loss,
  abs({change('close', back)}) AS moved FROM b{t} b JOIN a{t} USING (symbol, bar_seq))""".replace("PARTITION BY symbol ORDER BY bar_seq", "PARTITION BY b.symbol ORDER BY b.bar_seq"))
        strength = "CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100 END ELSE 100 - 100 / (1 + gain / loss) END"
        made = {"trend_bullish": "quick > slow", "trend_bearish": "quick < slow", "price_above_ema": "close > quick", "price_below_ema": "close < quick", "momentum_bullish": f"({strength}) > 50", "momentum_bearish": f"({strength}) < 50"}
        out.append(f"g{t} AS (SELECT symbol, ts, n, n > {least} AS long_enough, {flag('close > quick')} AS up, {flag('close < quick')} AS dn, {flag(f'({rank("moved", length)}) > 0.7')} AS strong, {', '.join(f'CAST(n > {least} AND coalesce({c}, false) AS INT) AS htf_{t}_{k}' for k, c in made.items())} FROM w{t})")
    names = [f"htf_{t}_{x}" for t in ("1h", "4h") for x in ("trend_bullish", "trend_bearish", "price_above_ema", "price_below_ema", "momentum_bullish", "momentum_bearish")] + ["htf_1d_trend_bullish", "htf_1d_trend_bearish"]
    both = "(x.n > 20 AND y.n > 10)"
    join = " ".join(f"JOIN g{t} {a} ON {a}.symbol = bars.symbol AND {a}.ts = time_bucket(INTERVAL '{sizes[t][0]}', bars.ts, TIMESTAMP '1970-01-01')" for t, a in (("1h", "x"), ("4h", "y"), ("1d", "q")))
    return [*out, f"""lg AS MATERIALIZED (SELECT bars.symbol, bars.bar_seq, {', '.join(names)}, CAST({both} AND x.strong = 1 AS INT) AS htf_1h_strong_trend, CAST({both} AND y.strong = 1 AS INT) AS htf_4h_strong_trend,
  CAST({both} AND x.up * y.up = 1 AS INT) AS mtf_momentum_aligned_bull, CAST({both} AND x.dn * y.dn = 1 AS INT) AS mtf_momentum_aligned_bear,
  CAST(x.long_enough AS INT) AS has_1h, CAST(y.long_enough AS INT) AS has_4h, CAST(q.long_enough AS INT) AS has_1d FROM bars {join})"""]


LONGER = [f"htf_{t}_{x}" for t in ("1h", "4h") for x in ("trend_bullish", "trend_bearish", "price_above_ema", "price_below_ema", "momentum_bullish", "momentum_bearish", "strong_trend")] + ["htf_1d_trend_bullish", "htf_1d_trend_bearish", "mtf_momentum_aligned_bull", "mtf_momentum_aligned_bear"]


def _counted() -> dict[str, str]:
    """Flags of flags."""
    def seen(x: str, n: int, off: int = 0) -> str:
        return f"(CASE WHEN bar_seq >= {n - 1 + off} THEN sum({x}) OVER {frame(n, off)} END)"

    votes = {s: f"(rsi_14_{a} + macd_{b} + stoch_{a})" for s, a, b in (("bull", "rising", "bullish"), ("bear", "falling", "bearish"))}
    big = {"bull": "(large_candle_range * bullish_candle)", "bear": "(large_candle_range * bearish_candle)"}
    up, down = "close > c1", "close < c1"
    buy, sell = _over("close - low", "high - low"), _over("high - close", "high - low")
    vm50 = full("avg", "volume", 50)
    kinds = {s: [f"htf_trend_{s}_{n}" for n in (60, 120, 240)] + [f"htf_{t}_trend_{s}" for t in ("1h", "4h", "1d")] for s in ("bullish", "bearish")}
    has = ["CAST(nb >= 60 AS INT)", "CAST(nb >= 120 AS INT)", "CAST(nb >= 240 AS INT)", "has_1h", "has_4h", "has_1d"]
    some = " + ".join(has)
    every = {s: f"({some}) >= 2 AND " + " AND ".join(f"({h} = 0 OR {x} = 1)" for h, x in zip(has, kinds[s], strict=True)) for s in kinds}
    there = "list_filter([" + ", ".join(f"{{'o': {h}, 'v': {x}}}" for h, x in zip(has, kinds["bullish"], strict=True)) + "], lambda s: s.o = 1)"
    weights = "[0.3::DOUBLE, 0.5, 0.7, 1.0]"
    top = " + ".join(f"coalesce(({there})[{i}].v * {w}::DOUBLE, 0)" for i, w in enumerate((0.3, 0.5, 0.7, 1.0), 1))
    score = f"(CASE WHEN len({there}) >= 2 THEN ({top}) / list_sum({weights}[1:least(len({there}), 4)]) END)"
    hour = "hour(ts)"
    prev = {s: f"CASE WHEN {hour} BETWEEN 8 AND 15 THEN {lag(f'f_asia_{s}', 9)} WHEN {hour} BETWEEN 13 AND 20 THEN {lag(f'f_london_{s}', 8)} ELSE {lag(f'f_ny_{s}', 8)} END" for s in "hl"}
    return {
        "above_prev_session_high": _over(f"close - ({prev['h']})", "close") + " > 0.002", "below_prev_session_low": _over(f"({prev['l']}) - close", "close") + " > 0.002", "above_prev_day_high": _over("close - day1_h", "close") + " > 0.002", "below_prev_day_low": _over("day1_l - close", "close") + " > 0.002",
        "momentum_strong_bullish": f"{votes['bull']} >= 2", "momentum_strong_bearish": f"{votes['bear']} >= 2", "momentum_mixed": f"{votes['bull']} > 0 AND {votes['bear']} > 0",
        "momentum_regime_bullish": f"{votes['bull']} > 2", "momentum_regime_bearish": f"{votes['bull']} < 1", "momentum_regime_neutral": f"{votes['bull']} BETWEEN 1 AND 2",
        "volume_confirmed_breakout_above": "strong_breakout_above_20 = 1 AND volume_surge = 1", "volume_confirmed_breakdown_below": "strong_breakdown_below_20 = 1 AND volume_surge = 1",
        "five_wave_up": f"n3_up + {lag('n3_up')} >= 4", "five_wave_down": f"n3_dn + {lag('n3_dn')} >= 4", "in_bullish_fvg_zone": f"low <= h2 AND high >= l2 AND {lag('bullish_fvg_present')} = 1",
        "increasing_buying_pressure": f"{buy} > {full('avg', buy, 10)}", "increasing_selling_pressure": f"{sell} > {full('avg', sell, 10)}", "bullish_absorption": f"volume_surge = 1 AND move1 < q_absorb AND {buy} > 0.7", "bearish_absorption": f"volume_surge = 1 AND move1 < q_absorb AND {sell} > 0.7",
        "sideways_with_momentum_buildup": f"price_clustered_middle_20 = 1 AND (abs(rsi_14 - 50) > 15 OR abs(macd) > {full('avg', 'macd', 20)})",
        **{f"false_breakout_zone_{n}": f"{seen(f'failed_breakout_above_{n}', n)} + {seen(f'failed_breakdown_below_{n}', n)} >= 2" for n in (20, 50)},
        "low_volume_sideways": f"volume < ({vm50}) * 0.7 AND range_bound_tight_20 = 1", "volume_at_resistance": f"near_resistance_20 = 1 AND volume > ({vm50}) * 1.5", "volume_at_support": f"near_support_20 = 1 AND volume > ({vm50}) * 1.5",
        "shallow_bull_retracement": f"{down} AND {seen('bullish_displacement', 5, 1)} > 0 AND abs(c3) < 0.005", "shallow_bear_retracement": f"{up} AND {seen('bearish_displacement', 5, 1)} > 0 AND abs(c3) < 0.005",
        "healthy_retracement_after_bull_candle": f"{down} AND {seen(big['bull'], 3, 1)} > 0 AND move1 < 0.01", "healthy_retracement_after_bear_candle": f"{up} AND {seen(big['bear'], 3, 1)} > 0 AND move1 < 0.01",
        "momentum_continuation_bull": f"{lag(big['bull'])} = 1 AND {up}", "momentum_continuation_bear": f"{lag(big['bear'])} = 1 AND {down}", "exhaustion_volume_pattern": "volume_surge = 1 AND small_body = 1",
        "mean_reversion_probability_high": "price_2std_extreme + rsi_extreme_historical_context + price_stretch_from_ema >= 2", "support_resistance_magnetic_effect": f"{seen('greatest(near_support_20, near_resistance_20)', 3)} >= 2",
        "mtf_all_bullish": every["bullish"], "mtf_all_bearish": every["bearish"], "multi_timeframe_trend_alignment_strong": f"{score} > 0.75", "multi_timeframe_trend_alignment_weak": f"{score} < 0.25",
        "volatility_regime_consistent_high": f"{seen('volatility_regime_high', 10)} >= 7", "volatility_regime_consistent_low": f"{seen('volatility_regime_low', 10)} >= 7",
    }


def all_flag_blocks() -> tuple[list[str], list[str]]:
    """Up to ``fl``: every flag; and the flags' names."""
    first = {k: c for f in FLAG_FAMILIES.values() for k, c in f().items()}
    masks = {"asia": ("(hour(ts) >= 23 OR hour(ts) < 8)", 9), "london": ("hour(ts) BETWEEN 8 AND 15", 8), "ny": ("hour(ts) BETWEEN 13 AND 20", 8)}
    sides = [(f"{n}_{s}", f"{fn}(CASE WHEN {m} THEN {x} END) OVER {frame(k)}") for n, (m, k) in masks.items() for s, fn, x in (("h", "max", "high"), ("l", "min", "low"))]
    second = _counted()
    kept = ["momentum_regime_persistent_bull", "momentum_regime_persistent_bear"]
    blocks = [
        *flag_blocks(), *_longer_blocks(), f"f1 AS MATERIALIZED (SELECT v.*, {flags(first)} FROM v)",
        f"""f2 AS MATERIALIZED (SELECT f1.*, lg.* EXCLUDE (symbol, bar_seq), count(*) OVER (PARTITION BY f1.symbol) AS nb FROM f1 JOIN lg USING (symbol, bar_seq))""",
        f"""f3 AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS s_{n}' for n, x in sides)}, max(high) OVER {frame(24, 24)} AS day1_h, min(low) OVER {frame(24, 24)} AS day1_l,
  {full('sum', flag('close > c1'), 3)} AS n3_up, {full('sum', flag('close < c1'), 3)} AS n3_dn FROM f2)""",
        f"f4 AS MATERIALIZED (SELECT *, {', '.join(f'{before(f"s_{n} IS NOT NULL", f"s_{n}", own=True)} AS f_{n}' for n, _ in sides)} FROM f3)",
        f"f5 AS MATERIALIZED (SELECT *, {flags(second)} FROM f4)",
        f"""fl AS MATERIALIZED (SELECT *, (~mtf_all_bullish) & (~mtf_all_bearish) AS mtf_mixed_signals,
  {', '.join(f"{flag(f'bar_seq >= 19 AND sum(momentum_regime_{x}) OVER {frame(20)} >= 15')} AS momentum_regime_persistent_{s}" for s, x in (('bull', 'bullish'), ('bear', 'bearish')))} FROM f5)""",
    ]
    return blocks, [*first, *second, *LONGER, "mtf_mixed_signals", *kept]


def _flags() -> dict[str, str]:
    # In the blocks c1 is the close before, as in ``d``; the relative change over one bar is c1x.
    blocks = given(*flag_blocks())
    every, names = all_flag_blocks()
    return {f"flags_{name}": f"{blocks}\nSELECT {_KEYS}, {flags(f())} FROM v" for name, f in FLAG_FAMILIES.items()} | {"flags_all": f"{given(*every)}\nSELECT {_KEYS}, {', '.join(names)} FROM fl"}


def _merged() -> str:
    every, names = all_flag_blocks()
    own = [*_STRUCTURE, *_MEASURES, "volume", "open", "high", "low", "close"]
    first = ", ".join([*(f"s.{n}" for n in [*_STRUCTURE, "volume"]), *(f"round(s.{n}, 6) AS {n}" for n in [*_MEASURES, "open", "high", "low", "close"])])
    return f"""{given(*structure_blocks(), *every)}
SELECT s.symbol, s.tf, s.ts, s.bar_seq, {first}, {', '.join(f'fl.{n}' for n in names if n not in own)} FROM s JOIN fl USING (symbol, bar_seq)"""


# --- Renko ----------------------------------------------------------------------------------------------------------------


def renko_blocks(size: str = "20.0", mode: str = "wicks") -> list[str]:
    """Up to ``rk``: bricks. The recursion goes on by a brick of the bar at hand, or to the next bar where none is left to do."""
    turns = "heading * sign(move) < 0"
    go = f"CASE WHEN {turns} THEN CASE WHEN abs(move) >= 2 THEN 2 ELSE 0 END WHEN abs(move) >= 1 THEN 1 ELSE 0 END"
    todo = f"CASE WHEN jump = 0 THEN 0 WHEN made THEN todo - 1 WHEN {turns} THEN CAST(floor(abs(move) - 2) AS INT) ELSE CAST(floor(abs(move)) AS INT) - 1 END"
    turn_open = "before + dir * size" if mode in ("normal", "wicks", "reverse-wicks", "fake-r-wicks") else "other" if mode == "fake-r-nongap" else "wick"
    turn_far = "before + dir * size" if mode == "normal" else "other" if mode.startswith("fake-r") else "wick"
    on_open, on_far = "wick" if mode == "nongap" else "own", "wick" if mode in ("wicks", "nongap") else "own"
    last = "last_value(CASE WHEN dir = {0} THEN price END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        f"sz AS (SELECT symbol, {size} AS size FROM bars GROUP BY 1)",
        f"""p AS (
  SELECT b.symbol, b.bar_seq AS bar, 0 AS n, floor(close / size) * size AS price, 0 AS heading, floor(close / size) * size AS lo, floor(close / size) * size AS hi,
    1 AS held, size, close, false AS made, 0.0::DOUBLE AS wick, 0 AS counted, 0 AS todo FROM bars b JOIN sz USING (symbol) WHERE b.bar_seq = 0
  UNION ALL
  SELECT symbol, CASE WHEN jump > 0 THEN bar ELSE bar + 1 END, CASE WHEN jump > 0 THEN n + 1 ELSE n END, CASE WHEN jump > 0 THEN level ELSE price END, CASE WHEN jump > 0 THEN way ELSE heading END,
    CASE WHEN jump = 0 THEN least(lo, coming) WHEN way > 0 THEN level ELSE lo END, CASE WHEN jump = 0 THEN greatest(hi, coming) WHEN way > 0 THEN hi ELSE level END,
    CASE WHEN jump = 0 THEN held + 1 ELSE 1 END, size, CASE WHEN jump = 0 THEN coming ELSE close END, jump > 0, CASE WHEN way > 0 THEN lo ELSE hi END, held, {todo}
  FROM (
    SELECT *, CAST(sign(move) AS INT) AS way, price + sign(move) * jump * size AS level FROM (
      SELECT *, CASE WHEN bar = 0 THEN 0 WHEN made THEN CASE WHEN todo > 0 THEN 1 ELSE 0 END ELSE {go} END AS jump FROM (
        SELECT p.*, (p.close - p.price) / p.size AS move, x.close AS coming, x.bar_seq AS next_seq FROM p LEFT JOIN bars x ON x.symbol = p.symbol AND x.bar_seq = p.bar + 1
      )
    ) WHERE jump > 0 OR next_seq IS NOT NULL
  )
)""",
        f"""pb AS (SELECT symbol, n, bar, price, heading AS dir, wick, counted, size FROM p WHERE made)""",
        f"""pc AS (SELECT *, coalesce(lag(price) OVER w, 0) AS before, coalesce(lag(dir) OVER w, 0) AS before_dir,
  coalesce(CASE WHEN dir = 1 THEN {last.format(1)} ELSE {last.format(-1)} END, 0) AS own, coalesce(CASE WHEN dir = 1 THEN {last.format(-1)} ELSE {last.format(1)} END, 0) AS other
  FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY n))""",
        f"""rk AS MATERIALIZED (
  SELECT pc.symbol, b.tf, b.ts, n - 2 AS bar_seq, CASE WHEN before_dir = dir THEN {on_open} ELSE {turn_open} END AS open, price AS close, dir,
    CASE WHEN before_dir = dir THEN {on_far} ELSE {turn_far} END AS far, CAST(counted AS DOUBLE) AS volume, bar AS source_seq
  FROM pc JOIN bars b ON b.symbol = pc.symbol AND b.bar_seq = pc.bar WHERE n > 1
)""",
    ]


_BRICKS = "symbol, tf, ts, CAST(bar_seq AS BIGINT) AS bar_seq, round(open, 6) AS open, round(CASE WHEN dir = 1 THEN close ELSE far END, 6) AS high, round(CASE WHEN dir = 1 THEN far ELSE close END, 6) AS low, round(close, 6) AS close, volume, source_seq"


def _renko() -> dict[str, str]:
    modes = ("normal", "wicks", "nongap", "reverse-wicks", "reverse-nongap", "fake-r-wicks", "fake-r-nongap")
    out = {f"renko_{m.replace('-', '_')}": given(*renko_blocks(mode=m)) + f" SELECT {_BRICKS} FROM rk" for m in modes}
    own = "greatest(median(close) * 0.001, median(high - low) * 0.25, 1e-9)"
    return out | {"renko_auto": given(*renko_blocks(own)) + f" SELECT {_BRICKS} FROM rk"}


def more() -> dict[str, str]:
    return _simulations() | _features() | _insights() | _scores() | _flags() | {"features_merged": _merged()} | _renko()
