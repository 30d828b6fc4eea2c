"""Strategies as rules over columns.

A strategy prepares columns (recurrences in one grouped map, the rest as
expressions) and names four conditions and two distances: when a flat position
goes long or short, when a long or a short one leaves, and how far stop and
target are. What needs the position is left to the simulator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.operators import indicators as I
from tickloom.operators.candles import heikin_ashi

#: What every prepared frame has for the simulator.
SIGNALS = ["go_long", "go_short", "leave_long", "leave_short", "stop_dist", "target_dist"]


@dataclass
class Strategy:
    name: str
    text: str
    defaults: dict
    ranges: dict
    prepare: Callable[[DataFrame, dict], DataFrame]
    warmup: Callable[[dict], int]
    rules: Callable[[dict], tuple[Column, Column, Column, Column]]
    distances: Callable[[dict], tuple[Column | None, Column | None]] = field(default=lambda p: (None, None))
    reasons: dict = field(default_factory=dict)
    used: Callable[[dict], list[str]] = field(default=lambda p: [])

    def params(self, given: dict | None = None) -> dict:
        return self.defaults | (given or {})

    def signals(self, bars: DataFrame, given: dict | None = None) -> DataFrame:
        """Bars with the columns of SIGNALS: conditions as booleans (false before the warm-up), distances or null."""
        p = self.params(given)
        df = self.prepare(bars, p)
        live = F.col("bar_seq") >= self.warmup(p)
        conds = [F.coalesce(live & c, F.lit(False)) for c in self.rules(p)]
        # No distance where it is null or 0.
        dist = [F.lit(None).cast("double") if d is None else F.nullif(d, F.lit(0.0)) for d in self.distances(p)]
        return df.select(*bars.columns, *[c.alias(n) for n, c in zip(SIGNALS, [*conds, *dist], strict=True)])

    def describe(self, given: dict | None = None) -> dict:
        p = self.params(given)
        return {"name": self.name, "description": self.text, "params": p, "param_ranges": self.ranges, "entry_rules": [self.reasons["long"], self.reasons["short"]], "exit_rules": [self.reasons["leave"]], "indicators": self.used(p)}


def _crosses(a: str, b: str | None = None, level: float = 0.0) -> tuple[Column, Column]:
    x, y = F.col(a), F.lit(level) if b is None else F.col(b)
    x1, y1 = W.lag(a), F.lit(level) if b is None else W.lag(b)
    return W.cross_up(x, y, x1, y1), W.cross_down(x, y, x1, y1)


def _ha(bars: DataFrame, p: dict) -> DataFrame:
    df = heikin_ashi(bars)
    wanted = {n: ("ema", {"period": p[k], "source": "ha_close"}) for n, k in (("fast_avg", "ema_fast"), ("slow_avg", "ema_slow"), ("trend_avg", "ema_trend"))}
    return I.recursive(df, wanted | ({"atr_now": ("atr", {"period": p["atr_period"]})} if p["use_sl_tp"] else {}))


def _ha_rules(p: dict):
    up, down = _crosses("fast_avg", "slow_avg")
    c, t = F.col("close"), F.col("trend_avg")
    return up & (c > t), down & (c < t), down, up


def _atr_distances(p: dict) -> tuple[Column | None, Column | None]:
    return (F.col("atr_now") * p["atr_sl_mult"], F.col("atr_now") * p["atr_tp_mult"]) if p["use_sl_tp"] else (None, None)


def _points(p: dict) -> bool:
    return bool(p["tp_points"] or p["sl_points"])


def _ema(bars: DataFrame, p: dict) -> DataFrame:
    wanted = {"fast_avg": ("ema", {"period": p["ema_fast"]}), "slow_avg": ("ema", {"period": p["ema_slow"]})}
    if p["use_adx_filter"]:
        wanted["adx_now"] = ("adx", {"period": p["adx_period"]})
    if p["use_sl_tp"] and not _points(p):
        wanted["atr_now"] = ("atr", {"period": p["atr_period"]})
    return I.recursive(bars, wanted)


def _ema_rules(p: dict):
    up, down = _crosses("fast_avg", "slow_avg")
    ok = F.col("adx_now_adx") >= p["adx_threshold"] if p["use_adx_filter"] else F.lit(True)
    return up & ok, down & ok, down, up


def _ema_distances(p: dict) -> tuple[Column | None, Column | None]:
    if p["tp_points"] > 0 or p["sl_points"] > 0:
        return tuple(F.lit(float(p[k])) if p[k] > 0 else None for k in ("sl_points", "tp_points"))
    return _atr_distances(p) if not _points(p) else (None, None)


def _rsi(bars: DataFrame, p: dict) -> DataFrame:
    return I.recursive(bars, {"rsi_now": ("rsi", {"period": p["rsi_period"]})} | ({"trend_avg": ("ema", {"period": p["ema_trend"]})} if p["use_trend_filter"] else {}))


def _trend_ok(p: dict) -> tuple[Column, Column]:
    return (F.col("close") > F.col("trend_avg"), F.col("close") < F.col("trend_avg")) if p["use_trend_filter"] else (F.lit(True), F.lit(True))


def _rsi_rules(p: dict):
    up, down = _trend_ok(p)
    r = F.col("rsi_now")
    return _crosses("rsi_now", level=p["rsi_lower"])[0] & up, _crosses("rsi_now", level=p["rsi_upper"])[1] & down, r >= p["rsi_exit_mid"], r <= p["rsi_exit_mid"]


def _bollinger(bars: DataFrame, p: dict) -> DataFrame:
    return bars.withColumns(I.bollinger_bands(p["bb_period"], p["bb_std"]))


def _bollinger_rules(p: dict):
    c, mid = F.col("close"), F.col("bb_middle")
    on = F.lit(bool(p["exit_on_middle"]))
    return _crosses("close", "bb_upper")[0], _crosses("close", "bb_lower")[1], on & (c < mid), on & (c > mid)


def _macd(bars: DataFrame, p: dict) -> DataFrame:
    return I.recursive(bars, {"m": ("macd", {k: p[k] for k in ("fast", "slow", "signal")})} | ({"trend_avg": ("ema", {"period": p["ema_trend"]})} if p["use_trend_filter"] else {}))


def _macd_rules(p: dict):
    up, down = _crosses("m_macd_hist")
    long_ok, short_ok = _trend_ok(p)
    return up & long_ok, down & short_ok, down, up


#: The parameters' defaults and the values that searches try.
REGISTRY: dict[str, Strategy] = {s.name: s for s in (
    Strategy("heikin_ashi_ema_cross", "Averages of Heikin Ashi closes cross on the trend's side.", {"ema_fast": 9, "ema_slow": 21, "ema_trend": 55, "use_sl_tp": False, "atr_period": 14, "atr_sl_mult": 1.5, "atr_tp_mult": 3.0}, {"ema_fast": [5, 7, 9, 12], "ema_slow": [15, 21, 26, 34], "ema_trend": [50, 55, 100, 200]}, _ha, lambda p: max(p["ema_trend"], p["ema_slow"]) + 1, _ha_rules, _atr_distances, {"long": "fast average crosses over slow, close over trend", "short": "fast average crosses under slow, close under trend", "leave": "opposite cross"}, lambda p: ["heikin_ashi", *(f"ema({p[k]})" for k in ("ema_fast", "ema_slow", "ema_trend")), *([f"atr({p['atr_period']})"] if p["use_sl_tp"] else [])]),
    Strategy("ema_crossover", "Averages of closes cross, optionally only in a trend, with stops in points or ATRs.", {"ema_fast": 9, "ema_slow": 21, "use_adx_filter": False, "adx_period": 14, "adx_threshold": 20, "tp_points": 0.0, "sl_points": 0.0, "use_sl_tp": False, "atr_period": 14, "atr_sl_mult": 1.5, "atr_tp_mult": 2.5}, {"ema_fast": [5, 9, 12, 20], "ema_slow": [13, 21, 26, 50], "adx_threshold": [15, 20, 25]}, _ema, lambda p: p["ema_slow"] + 1, _ema_rules, _ema_distances, {"long": "fast average crosses over slow", "short": "fast average crosses under slow", "leave": "opposite cross"}, lambda p: [f"ema({p['ema_fast']})", f"ema({p['ema_slow']})", *([f"adx({p['adx_period']})"] if p["use_adx_filter"] else [])]),
    Strategy("rsi_mean_reversion", "RSI comes back from an extreme; out at the middle.", {"rsi_period": 14, "rsi_lower": 30, "rsi_upper": 70, "rsi_exit_mid": 50, "use_trend_filter": False, "ema_trend": 200}, {"rsi_period": [7, 14, 21], "rsi_lower": [20, 25, 30], "rsi_upper": [70, 75, 80]}, _rsi, lambda p: p["rsi_period"] + 1, _rsi_rules, reasons={"long": "RSI crosses up through the lower bound", "short": "RSI crosses down through the upper bound", "leave": "RSI back at the middle"}, used=lambda p: [f"rsi({p['rsi_period']})"]),
    Strategy("bollinger_breakout", "Close breaks out of its band; out through the middle.", {"bb_period": 20, "bb_std": 2.0, "exit_on_middle": True}, {"bb_period": [10, 20, 30], "bb_std": [1.5, 2.0, 2.5]}, _bollinger, lambda p: p["bb_period"] + 1, _bollinger_rules, reasons={"long": "close crosses over the upper band", "short": "close crosses under the lower band", "leave": "close back through the middle"}, used=lambda p: [f"bollinger_bands({p['bb_period']}, {p['bb_std']})"]),
    Strategy("macd_trend", "The MACD histogram changes sign on the trend's side.", {"fast": 12, "slow": 26, "signal": 9, "use_trend_filter": True, "ema_trend": 200}, {"fast": [8, 12, 16], "slow": [21, 26, 34], "signal": [7, 9, 12]}, _macd, lambda p: max(p["slow"], p["ema_trend"]) + 1, _macd_rules, reasons={"long": "histogram crosses over 0", "short": "histogram crosses under 0", "leave": "opposite cross"}, used=lambda p: [f"macd({p['fast']}, {p['slow']}, {p['signal']})"]),
)}


def get(name: str) -> Strategy:
    if name not in REGISTRY:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def register(s: Strategy) -> None:
    REGISTRY[s.name] = s


# --- rules written as data --------------------------------------------------------------------------------------------

_OPS: dict[str, Callable[[Column, Column], Column]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}


def condition(rule: dict, columns: set[str]) -> Column:
    """{"all": [...]}, {"any": [...]}, {"not": ...} or {"left", "op", "right"}: columns or numbers, compared or crossing
    ("crosses_above", "crosses_below"). Names must be columns; nothing is evaluated as text."""
    if "all" in rule or "any" in rule:
        key = "all" if "all" in rule else "any"
        out = F.lit(key == "all")
        for r in rule[key]:
            c = condition(r, columns)
            out = out & c if key == "all" else out | c
        return out
    if "not" in rule:
        return ~condition(rule["not"], columns)

    def side(x) -> tuple[Column, Column]:
        if isinstance(x, bool) or not isinstance(x, int | float | str):
            raise ValueError(f"not a column or number: {x!r}")
        if isinstance(x, str):
            if x not in columns:
                raise ValueError(f"unknown column {x!r}")
            return F.col(x), W.lag(x)
        return F.lit(float(x)), F.lit(float(x))

    (a, a1), (b, b1) = side(rule["left"]), side(rule["right"])
    if rule["op"] == "crosses_above":
        return W.cross_up(a, b, a1, b1)
    if rule["op"] == "crosses_below":
        return W.cross_down(a, b, a1, b1)
    if rule["op"] not in _OPS:
        raise ValueError(f"unknown comparison {rule['op']!r}")
    return _OPS[rule["op"]](a, b)


def from_rules(name: str, doc: dict) -> Strategy:
    """A strategy from a document: indicators {column: {"name", params...}}, long, short, leave_long, leave_short (rules),
    warmup, stop and target (columns or points)."""
    found = {k: dict(v) for k, v in doc.get("indicators", {}).items()}

    def prepare(bars: DataFrame, p: dict) -> DataFrame:
        memory = {k: (v["name"], {a: b for a, b in v.items() if a != "name"}) for k, v in found.items() if v["name"] in I.RECURSIVE}
        df = I.recursive(bars, memory) if memory else bars
        for k, v in found.items():
            if v["name"] in I.WINDOWED:
                cols = I.WINDOWED[v["name"]][1]
                df = I.compute(v["name"], df, **{a: b for a, b in v.items() if a != "name"})
                df = df.withColumnsRenamed({c: k if len(cols) == 1 else f"{k}_{c}" for c in cols})
            elif v["name"] not in I.RECURSIVE:
                raise KeyError(f"unknown indicator {v['name']!r}")
        return df

    names = {"open", "high", "low", "close", "volume"} | {k if len((I.RECURSIVE | I.WINDOWED)[v["name"]][1]) == 1 else f"{k}_{c}" for k, v in found.items() for c in (I.RECURSIVE | I.WINDOWED)[v["name"]][1]}

    def rules(p: dict):
        return tuple(condition(doc[k], names) if k in doc else F.lit(False) for k in ("long", "short", "leave_long", "leave_short"))

    def distance(x) -> Column | None:
        return None if x is None else F.col(x) if isinstance(x, str) else F.lit(float(x))

    return Strategy(name, doc.get("description", ""), {}, {}, prepare, lambda p: int(doc.get("warmup", 1)), rules, lambda p: (distance(doc.get("stop")), distance(doc.get("target"))), {"long": str(doc.get("long")), "short": str(doc.get("short")), "leave": str(doc.get("leave_long"))}, lambda p: sorted(found))
