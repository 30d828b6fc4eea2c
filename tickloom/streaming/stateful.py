"""Indicators of a stream of bars, carried in state: the columns of the batch operators, whatever the micro-batches.

A series' state is small and of fixed size: one value state with the numbers that
the recurrences need (averages with the weight of their past, SuperTrend's bands
and direction, the volume balance), one list state with the last bars that frames
and pivots look back on, and, with ``lateness``, one map state of the bars that
wait for the watermark. Each batch reads and writes a series' state once.

Without ``lateness`` bars are taken as they come, those of one batch in order of
ts, and a bar that isn't after the last one taken is passed over: it belongs to
``upsert_stream`` and a rebuild. With it, bars wait in the map until the watermark
is past them (a timer a bar), so rows out of order within that time give what the
ordered stream gives; of two with one ts the later arrival counts.

Output: a row a bar (``kind`` bar) with the columns of ``COLUMNS``, and a row for
each pivot (``kind`` high or low; price in ``pivot``), ts that of the pivot's own
bar, which comes out when ``swing`` more bars are there. A pivot is the extreme of
the 2 * swing + 1 bars around it, ties included.

Defined results: a null price is no value, as in the batch columns: averages stay,
frames give null. Null volume counts 0 in the balance. Null ts is passed over.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BAR = ("open", "high", "low", "close", "volume")
COLUMNS = ("sma", "bb_upper", "bb_lower", "stoch_k", "roc", "ema", "rsi", "macd", "macd_signal", "macd_hist", "atr", "adx", "plus_di", "minus_di", "supertrend", "supertrend_dir", "obv")
SCHEMA = "symbol string, tf string, ts timestamp, kind string, pivot double, close double, " + ", ".join(f"{c} double" for c in COLUMNS)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAN = math.nan


def _ratio(a: float, b: float) -> float:
    return NAN if b == 0 or math.isnan(b) else a / b


class Average:
    """One exponential average: its value and the weight of its past, which gaps lessen."""

    def __init__(self, state: list[float], at: int, alpha: float):
        self.state, self.at, self.alpha = state, at, alpha

    def step(self, x: float) -> float:
        y, keep = self.state[self.at], self.state[self.at + 1]
        if math.isnan(x):
            keep *= 1 - self.alpha
        elif math.isnan(y):
            y, keep = x, 1.0
        else:
            old = keep * (1 - self.alpha)
            y, keep = (old * y + self.alpha * x) / (old + self.alpha), 1.0
        self.state[self.at], self.state[self.at + 1] = y, keep
        return y


#: Averages: name -> length, as a span (weights 2 / (n + 1)) or as Wilder's (1 / n).
SPANS = {"ema": 20, "fast": 12, "slow": 26, "signal": 9}
WILDER = {"up": 14, "down": 14, "atr": 14, "plus": 14, "minus": 14, "dx": 14, "band": 10}
PERIOD, STOCH, ROC, DEVIATIONS, BAND = 20, 14, 12, 2.0, 3.0


class Series:
    """The state of one series between bars: numbers and the last bars. ``take`` gives a bar's columns."""

    EMPTY = [NAN, 1.0] * (len(SPANS) + len(WILDER)) + [NAN, NAN, 1.0, 0.0, 0.0]

    def __init__(self, numbers: list[float] | None, frame: list[tuple], swing: int):
        self.numbers = list(numbers) if numbers is not None else list(self.EMPTY)
        self.swing, self.size = swing, max(PERIOD, STOCH, ROC + 1, 2 * swing + 1)
        self.frame: deque[tuple] = deque(frame, self.size)
        alphas = {k: 2 / (n + 1) for k, n in SPANS.items()} | {k: 1 / n for k, n in WILDER.items()}
        self.mean = {k: Average(self.numbers, 2 * i, a) for i, (k, a) in enumerate(alphas.items())}
        self.rest = 2 * len(alphas)

    def _values(self, field: int, n: int) -> list[float] | None:
        """The last n of a field; None where there are fewer, or a null among them."""
        if len(self.frame) < n:
            return None
        got = [self.frame[-k][field] for k in range(n, 0, -1)]
        return None if any(math.isnan(x) for x in got) else got

    def take(self, ts, bar: tuple[float, ...]) -> dict[str, float]:
        _, high, low, close, volume = bar
        last = self.frame[-1] if self.frame else None
        self.frame.append((ts, *bar))
        before = last[4] if last else NAN
        m, out = self.mean, {}

        closes = self._values(4, PERIOD)
        if closes:
            mean, deviation = float(np.mean(closes)), float(np.std(closes, ddof=1))
            out |= {"sma": mean, "bb_upper": mean + DEVIATIONS * deviation, "bb_lower": mean - DEVIATIONS * deviation}
        lows, highs = self._values(3, STOCH), self._values(2, STOCH)
        if lows and highs:
            out["stoch_k"] = _ratio(100 * (close - min(lows)), max(highs) - min(lows))
        if len(self.frame) > ROC:
            out["roc"] = 100 * (_ratio(close, self.frame[-1 - ROC][4]) - 1)

        out["ema"] = m["ema"].step(close)
        change = close - before
        up, down = m["up"].step(change if math.isnan(change) else max(change, 0.0)), m["down"].step(change if math.isnan(change) else max(-change, 0.0))
        out["rsi"] = 100 - 100 / (1 + rs) if not math.isnan(rs := _ratio(up, down)) else NAN
        line = m["fast"].step(close) - m["slow"].step(close)
        signal = m["signal"].step(line)
        out |= {"macd": line, "macd_signal": signal, "macd_hist": line - signal}

        reach = [x for x in (high - low, abs(high - before), abs(low - before)) if not math.isnan(x)]
        true = max(reach) if reach else NAN
        out["atr"] = atr = m["atr"].step(true)
        rise, fall = (high - last[2], last[3] - low) if last else (NAN, NAN)
        plus = m["plus"].step(rise if math.isnan(rise) else rise if rise > fall and rise > 0 else 0.0)
        minus = m["minus"].step(fall if math.isnan(fall) else fall if fall > rise and fall > 0 else 0.0)
        p, q = 100 * _ratio(plus, atr), 100 * _ratio(minus, atr)
        out |= {"plus_di": p, "minus_di": q, "adx": m["dx"].step(100 * _ratio(abs(p - q), p + q))}

        n = self.numbers
        band = m["band"].step(true)
        over, under = (high + low) / 2 + BAND * band, (high + low) / 2 - BAND * band
        top, bottom, side = n[self.rest : self.rest + 3]
        if last:
            # The direction is held against the bands before this bar's.
            side = 1.0 if close > top else -1.0 if close < bottom else side
            over, under = over if over < top or before > top else top, under if under > bottom or before < bottom else bottom
            out["supertrend"] = under if side > 0 else over
        out["supertrend_dir"] = side
        balance = n[self.rest + 3] + (0.0 if math.isnan(change) or math.isnan(volume) else math.copysign(volume, change) * (change != 0))
        n[self.rest :] = [over, under, side, balance, n[self.rest + 4] + 1]
        out["obv"] = balance
        return out

    def pivots(self) -> Iterator[tuple[object, str, float, float]]:
        """Of the bar that now has ``swing`` bars on both sides: ts, kind, price, close."""
        w = 2 * self.swing + 1
        for kind, field, best in (("high", 2, max), ("low", 3, min)):
            around = self._values(field, w)
            if around and around[self.swing] == best(around):
                bar = self.frame[-1 - self.swing]
                yield bar[0], kind, bar[field], bar[4]


class Indicators(StatefulProcessor):
    def __init__(self, swing: int = 8, lateness: bool = False):
        self.swing, self.lateness = swing, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "last long, v array<double>")
        self.frame = handle.getListState("frame", "ts long, open double, high double, low double, close double, volume double")
        if self.lateness:
            self.waiting = handle.getMapState("waiting", "ts long", "open double, high double, low double, close double, volume double")

    def _run(self, key: tuple, bars: list[tuple[int, tuple[float, ...]]]) -> pd.DataFrame | None:
        """Bars (microseconds, prices) in order, those not after the last one passed over."""
        held = self.numbers.get() if self.numbers.exists() else None
        last = held[0] if held else None
        bars = [b for b in bars if last is None or b[0] > last]
        if not bars:
            return None
        nan = lambda r: tuple(NAN if x is None else x for x in r)
        s = Series([NAN if x is None else x for x in held[1]] if held else None, [(r[0], *nan(r[1:])) for r in self.frame.get()] if held else [], self.swing)
        rows = []
        for at, bar in bars:
            got = s.take(at, bar)
            rows.append((at, "bar", NAN, bar[3], *(got.get(c, NAN) for c in COLUMNS)))
            rows += [(ts, kind, price, close, *[NAN] * len(COLUMNS)) for ts, kind, price, close in s.pivots()]
        self.numbers.update((bars[-1][0], [float(x) for x in s.numbers]))
        self.frame.put([(int(r[0]), *[float(x) for x in r[1:]]) for r in s.frame])
        df = pd.DataFrame(rows, columns=["ts", "kind", "pivot", "close", *COLUMNS])
        df["ts"] = pd.to_datetime(df["ts"], unit="us")
        df.insert(0, "symbol", key[0])
        df.insert(1, "tf", key[1])
        return df.astype({c: "float64" for c in ("pivot", "close", *COLUMNS)}).replace({np.nan: None})

    @staticmethod
    def _bars(rows: Iterator[pd.DataFrame]) -> list[tuple[int, tuple[float, ...]]]:
        """In order of ts; of one ts the last arrival."""
        df = pd.concat(list(rows)).dropna(subset=["ts"])
        at = df["ts"].to_numpy("datetime64[us]").astype(np.int64)
        got = dict(zip(at.tolist(), df[list(BAR)].astype(float).itertuples(index=False, name=None), strict=True))
        return sorted(got.items())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bars = self._bars(rows)
        if not self.lateness:
            out = self._run(key, bars)
            if out is not None:
                yield out
            return
        last = self.numbers.get()[0] if self.numbers.exists() else None
        for at, bar in bars:
            if last is None or at > last:
                self.waiting.updateValue((at,), bar)
                self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All bars that the watermark has passed, in order; the first timer of a batch takes them, later ones find none."""
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((k[0], tuple(NAN if x is None else x for x in v)) for k, v in self.waiting.iterator() if k[0] <= until)
        for at, _ in ready:
            self.waiting.removeKey((at,))
        out = self._run(key, ready)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def live_indicators(bars: DataFrame, swing: int = 8, lateness: str | None = None) -> DataFrame:
    """A stream of bars (symbol, tf, ts, prices) with the columns of this module. ``lateness`` is how long a bar may come
    after later ones, for instance "10 minutes"."""
    use_rocksdb(bars.sparkSession)
    rows = bars.select("symbol", "tf", F.col("ts").cast("timestamp").alias("ts"), *BAR)
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy("symbol", "tf").transformWithStateInPandas(Indicators(swing, lateness is not None), SCHEMA, "Append", "EventTime" if lateness else "None")


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind is kept by RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
