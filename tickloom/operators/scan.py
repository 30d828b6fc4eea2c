"""Recurrences over series of any length: blocks, maps of states, and a second walk from the right state.

A series is cut into blocks of bars. What a block does to the state before it is a
map of a family that is closed under composition, so a few numbers stand for it:

    Seeded, Summed   affine maps of an average or a running sum; a block also says
                     what it ends with if nothing has been seeded before it
    Adjusted, Faded  affine maps of averages from the first value on, with either rule for gaps
    Total, Last      sums, and the last value that isn't null
    Level            the Kalman level: in homogeneous coordinates (level, variance,
                     1) a bar is a 3 x 3 matrix, although the gain is a fraction
    Trend            two states: a table of where each leads
    Ratchet          SuperTrend's bands: the identity on an interval and constants
                     beside it; each constant remembers the last close beyond it

Three steps a stage: blocks give their maps; a series' maps are applied in order (a
row a block); blocks run once more from the state that they begin with. A stage may
use what earlier ones give (an average of a ratio of averages), so a scan of k
stages walks the blocks k + 1 times. No task holds more than a block and its halo,
or a row a block of one series.

A series' first values are taken to begin in its first block: a recurrence that is
seeded by n values of an earlier stage needs those in one block.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["symbol", "tf"]
BLOCK, HALO = 100_000, 256
NAN = math.nan
Numbers = list[float]


class Recurrence:
    """Inputs are arrays of a block's own bars; with a halo, ``before`` has those of the bars before it too."""

    def start(self) -> Numbers:
        raise NotImplementedError

    def summary(self) -> Numbers:
        raise NotImplementedError

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        raise NotImplementedError

    def run(self, state: Numbers) -> np.ndarray:
        raise NotImplementedError


class Seeded(Recurrence):
    """y += alpha * (x - y), seeded by the mean of the first n values; a null after them stays null for good."""

    def __init__(self, x: np.ndarray, n: int, alpha: float, own: int = 0):
        self.x, self.n, self.alpha, self.own = x, n, alpha, own

    def start(self) -> Numbers:
        return [NAN, 0.0]

    def _seed(self) -> tuple[int, float]:
        """Where the seed is complete (len(x) if it isn't) and the value there."""
        ok = np.flatnonzero(~np.isnan(self.x))
        if len(ok) < self.n or ok[0] + self.n > len(self.x):
            return len(self.x), NAN
        return int(ok[0]) + self.n - 1, float(self.x[ok[0] : ok[0] + self.n].mean())

    def _next(self, y: float, x: float) -> float:
        return y + self.alpha * (x - y)

    def _walk(self, y: float, xs: np.ndarray) -> Numbers:
        out = []
        for x in xs.tolist():
            y = self._next(y, x)
            out.append(y)
        return out

    def fresh(self) -> np.ndarray:
        at, y = self._seed()
        out = np.full(len(self.x), NAN)
        if at < len(self.x):
            out[at] = y
            out[at + 1 :] = self._walk(y, self.x[at + 1 :])
        return out[self.own :]

    def summary(self) -> Numbers:
        own = self.x[self.own :]
        zero = self._walk(0.0, own)
        plus = zero[-1] if zero else 0.0
        at, _ = self._seed()
        new = self.fresh()
        return [self._times() ** len(own), plus, float(new[-1]) if len(new) else NAN, float(at < len(self.x))]

    def _times(self) -> float:
        return 1 - self.alpha

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        y, seeded = state
        times, plus, new, done = summary
        return [times * y + plus, 1.0] if seeded else [new, done]

    def run(self, state: Numbers) -> np.ndarray:
        y, seeded = state
        return np.array(self._walk(y, self.x[self.own :])) if seeded else self.fresh()


class Summed(Seeded):
    """Wilder's running sum: the first n - 1 values added up, then s - s / n + x."""

    def __init__(self, x: np.ndarray, n: int, own: int = 0):
        super().__init__(x, n, 1 / n, own)

    def _seed(self) -> tuple[int, float]:
        ok = np.flatnonzero(~np.isnan(self.x))
        if len(ok) < self.n or ok[0] + self.n > len(self.x):
            return len(self.x), NAN
        at = int(ok[0]) + self.n - 1
        return at, self._next(float(self.x[ok[0] : at].sum()), float(self.x[at]))

    def _next(self, y: float, x: float) -> float:
        return y - y / self.n + x


class Total(Recurrence):
    """A running sum."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def start(self) -> Numbers:
        return [0.0]

    def summary(self) -> Numbers:
        return [float(self.x.sum())]

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        return [state[0] + summary[0]]

    def run(self, state: Numbers) -> np.ndarray:
        return state[0] + np.cumsum(self.x)


class Adjusted(Recurrence):
    """The mean with weights (1 - alpha)^age over all values so far."""

    def __init__(self, x: np.ndarray, alpha: float):
        self.x, self.alpha = x, alpha

    def start(self) -> Numbers:
        return [0.0, 0.0]

    def _walk(self, num: float, den: float) -> list[tuple[float, float]]:
        out = []
        for v in self.x.tolist():
            num, den = num * (1 - self.alpha), den * (1 - self.alpha)
            if v == v:
                num, den = num + v, den + 1
            out.append((num, den))
        return out

    def summary(self) -> Numbers:
        num, den = (self._walk(0.0, 0.0) or [(0.0, 0.0)])[-1]
        return [(1 - self.alpha) ** len(self.x), num, den]

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        return [summary[0] * state[0] + summary[1], summary[0] * state[1] + summary[2]]

    def run(self, state: Numbers) -> np.ndarray:
        return np.array([num / den if den else NAN for num, den in self._walk(*state)])


class Last(Recurrence):
    """The last value that isn't null."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def start(self) -> Numbers:
        return [NAN]

    def summary(self) -> Numbers:
        at = np.flatnonzero(~np.isnan(self.x))
        return [float(self.x[at[-1]]) if len(at) else NAN]

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        return state if math.isnan(summary[0]) else summary

    def run(self, state: Numbers) -> np.ndarray:
        return pd.Series(np.concatenate((state, self.x))).ffill().to_numpy()[1:]


class Faded(Recurrence):
    """The average from the first value on; a gap of nulls lessens the weight of the past."""

    def __init__(self, x: np.ndarray, alpha: float):
        self.x, self.alpha = x, alpha

    def start(self) -> Numbers:
        return [NAN, 1.0]

    def summary(self) -> Numbers:
        """Nulls before the first value, that value, the affine map of the rest, nulls behind the last."""
        a, at = self.alpha, np.flatnonzero(~np.isnan(self.x))
        if not len(at):
            return [float(len(self.x)), NAN, 1.0, 0.0, 0.0]
        times, plus = 1.0, 0.0
        for gap, v in zip((np.diff(at) - 1).tolist(), self.x[at[1:]].tolist(), strict=True):
            old = (1 - a) ** (gap + 1)
            times, plus = times * old / (old + a), (plus * old + a * v) / (old + a)
        return [float(at[0]), float(self.x[at[0]]), times, plus, float(len(self.x) - 1 - at[-1])]

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        (y, keep), (lead, head, times, plus, trail), a = state, summary, self.alpha
        if math.isnan(head):
            return [y, keep * (1 - a) ** lead]
        if math.isnan(y):
            first = head
        else:
            old = keep * (1 - a) ** (lead + 1)
            first = (old * y + a * head) / (old + a)
        return [times * first + plus, (1 - a) ** trail]

    def run(self, state: Numbers) -> np.ndarray:
        (y, keep), a, out = state, self.alpha, []
        for v in self.x.tolist():
            if v != v:
                keep *= 1 - a
            elif y != y:
                y, keep = v, 1.0
            else:
                old = keep * (1 - a)
                y, keep = (old * y + a * v) / (old + a), 1.0
            out.append(y)
        return np.array(out)


class Level(Recurrence):
    """The Kalman level with steps of variance q, seen with variance r; from the first bar's value with variance 1."""

    def __init__(self, x: np.ndarray, first: bool, q: float = 0.01, r: float = 1.0):
        self.x, self.first, self.q, self.r = x, first, q, r

    def start(self) -> Numbers:
        return [NAN, 1.0]

    def summary(self) -> Numbers:
        """The product of the bars' matrices over (level * w, variance * w, w), brought to size now and then. The first
        block's is that of the bars behind the first, with what that one gives."""
        q, r = self.q, self.r
        m = np.eye(3)
        seen = np.eye(3)
        blind = np.array([[1.0, 0, 0], [0, 1, q], [0, 0, 1]])
        for k, z in enumerate(self.x[1:].tolist() if self.first else self.x.tolist()):
            if z != z:
                m = blind @ m
            else:
                # level' = (r level + (variance + q) z) / (variance + q + r), variance' = r (variance + q) / (the same).
                seen = np.array([[r, z, q * z], [0, r, r * q], [0, 1, q + r]])
                m = seen @ m
            if k % 32 == 31:
                m /= np.abs(m[2]).max()
        return [*m.ravel().tolist(), float(self.x[0]) if self.first and len(self.x) else NAN, float(self.first)]

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        level, variance = (summary[9], 1.0) if summary[10] else state
        if math.isnan(level):
            return [NAN, 1.0]
        m = np.array(summary[:9]).reshape(3, 3)
        u, p, w = m @ np.array([level, variance, 1.0])
        return [float(u / w), float(p / w)]

    def run(self, state: Numbers) -> np.ndarray:
        (level, variance), q, r, out = state, self.q, self.r, []
        xs = self.x.tolist()
        if self.first and xs:
            level, variance = xs[0], 1.0
            out.append(level)
            xs = xs[1:]
        for z in xs:
            variance += q
            gain = variance / (variance + r)
            if z == z:
                level += gain * (z - level)
                variance *= 1 - gain
            out.append(level)
        return np.array(out)


class Trend(Recurrence):
    """Two states: 0 becomes 1 where ``up`` holds, 1 becomes 0 where ``down`` does; one change a bar. The first bar of a
    series has state 0 whatever holds."""

    def __init__(self, up: np.ndarray, down: np.ndarray, first: bool):
        self.up, self.down, self.first = up.astype(bool), down.astype(bool), first

    def start(self) -> Numbers:
        return [0.0]

    def _walk(self, s: int) -> list[int]:
        out = []
        for k, (u, d) in enumerate(zip(self.up.tolist(), self.down.tolist(), strict=True)):
            if not (self.first and k == 0):
                s = 1 if s == 0 and u else 0 if s == 1 and d else s
            out.append(s)
        return out

    def summary(self) -> Numbers:
        return [float((self._walk(s) or [s])[-1]) for s in (0, 1)]

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        return [summary[int(state[0])]]

    def run(self, state: Numbers) -> np.ndarray:
        return np.array(self._walk(int(state[0])), float)


class Ratchet(Recurrence):
    """SuperTrend: bands that only tighten until a close is beyond them, and the direction that the last such close gives.

    The upper band is ``x`` as it stays while last closes <= x <= up, else up; so a block is the identity on an interval
    and, beside it, a constant for each bar at which a value can leave it. Of a value at the block's begin one keeps what
    it ends as, and the last bar whose close was beyond it. The lower band is the upper one of prices times -1.
    """

    def __init__(self, up: np.ndarray, down: np.ndarray, close: np.ndarray, before: float, first: bool):
        self.up, self.down, self.close, self.before, self.first = up, down, close, before, first

    def start(self) -> Numbers:
        return [NAN, NAN, 1.0]

    @staticmethod
    def _ends(band: np.ndarray, close: np.ndarray, before: float, skip: bool) -> tuple[list[float], list[float], list[float]]:
        """Breaks, and of the values between them (and beyond) the end and the last bar with a close beyond (-1: none).
        An end that is NaN is the value itself. Bar i first holds its close against the band, then the band moves."""
        b, c = band.tolist(), close.tolist()
        n = len(b)
        prev = [before, *c[:-1]]
        ends, beyond = [0.0] * n, [-1.0] * n  # of the band that bar i has set anew
        # From the back: the next bar that sets a value anew. Candidates are kept on two stacks, of falling closes and rising bands.
        low: list[tuple[float, int]] = []  # (close before bar j, j): first j > i with prev[j] > value
        high: list[tuple[float, int]] = []  # (band of bar j, j): first j > i with b[j] < value
        for i in range(n - 1, -1, -1):
            v = b[i]
            j = min(Ratchet._first(low, v), Ratchet._first(high, -v), n)
            if j < n:
                ends[i] = ends[j]
                # A close beyond the value at the bar before j is why it was set anew there, or bar j's own close is beyond it.
                own = j if c[j] > v else j - 1 if j - 1 > i and c[j - 1] > v else -1
                beyond[i] = beyond[j] if beyond[j] >= 0 else float(own)
            else:
                ends[i] = v
                beyond[i] = float(n - 1) if n - 1 > i and c[n - 1] > v else -1.0
            for stack, key in ((low, prev[i]), (high, -b[i])):
                while stack and stack[-1][0] <= key:
                    stack.pop()
                stack.append((key, i))
        # Values at the begin: they leave at the first bar with prev > value or band < value.
        breaks = sorted({x for s in (low,) for x, _ in s} | {-x for x, _ in high})
        points = [-math.inf, *breaks, math.inf]
        out_end, out_at = [], []
        at_break_end, at_break_at = [], []

        def leave(v: float) -> tuple[float, float]:
            j = min(Ratchet._first(low, v), Ratchet._first(high, -v), n)
            if j == n:
                return NAN, float(n - 1) if n and c[n - 1] > v else -1.0
            own = j if c[j] > v else j - 1 if j > 0 and c[j - 1] > v else -1
            return ends[j], beyond[j] if beyond[j] >= 0 else float(own)

        for a, z in zip(points, points[1:], strict=False):
            mid = z - 1.0 if a == -math.inf and z != math.inf else a + 1.0 if z == math.inf and a != -math.inf else 0.0 if a == -math.inf else (a + z) / 2
            e, k = leave(mid)
            out_end.append(e)
            out_at.append(k)
            if z != math.inf:
                e, k = leave(z)
                at_break_end.append(e)
                at_break_at.append(k)
        return breaks, [x for p in zip(out_end, [*at_break_end, NAN], strict=True) for x in p][:-1], [x for p in zip(out_at, [*at_break_at, NAN], strict=True) for x in p][:-1]

    @staticmethod
    def _first(stack: list[tuple[float, int]], v: float) -> int:
        """The nearest bar of a stack (keys fall towards its top, bars too) whose key is over v."""
        lo, hi = 0, len(stack)
        while lo < hi:
            mid = (lo + hi) // 2
            if stack[mid][0] > v:
                lo = mid + 1
            else:
                hi = mid
        return stack[lo - 1][1] if lo else 1 << 60

    def _own(self) -> slice:
        return slice(1, None) if self.first else slice(None)

    def summary(self) -> Numbers:
        s = self._own()
        before = float(self.close[0]) if self.first and len(self.close) else self.before
        out: Numbers = [float(self.first), float(self.up[0]) if len(self.up) else NAN, float(self.down[0]) if len(self.down) else NAN]
        for sign, band in ((1, self.up), (-1, self.down)):
            breaks, ends, at = self._ends(sign * band[s], sign * self.close[s], sign * before, self.first)
            # Neighbouring places with one outcome are one.
            out += [float(len(breaks)), *breaks, *ends, *at]
        return out

    def carry(self, state: Numbers, summary: Numbers) -> Numbers:
        top, bottom, side = (summary[1], summary[2], 1.0) if summary[0] else state
        at, new, last = 3, [], []
        for sign, v in ((1, top), (-1, bottom)):
            n = int(summary[at])
            breaks, ends, bars = summary[at + 1 : at + 1 + n], summary[at + 1 + n : at + 2 + 3 * n], summary[at + 2 + 3 * n : at + 3 + 5 * n]
            at += 3 + 5 * n
            place = 2 * bisect_left(breaks, sign * v) + (bisect_right(breaks, sign * v) > bisect_left(breaks, sign * v))
            new.append(v if math.isnan(ends[place]) else sign * ends[place])
            last.append(bars[place])
        if max(last) >= 0:
            side = 1.0 if last[0] >= last[1] else -1.0
        return [*new, side]

    def run(self, state: Numbers) -> np.ndarray:
        """Two rows: value (null in a series' first bar) and direction."""
        top, bottom, side = state
        up, down, close = self.up.tolist(), self.down.tolist(), self.close.tolist()
        value, way, before = [], [], self.before
        for k, c in enumerate(close):
            if self.first and k == 0:
                top, bottom, side = up[0], down[0], 1.0
                value.append(NAN)
            else:
                side = 1.0 if c > top else -1.0 if c < bottom else side
                top, bottom = up[k] if up[k] < top or before > top else top, down[k] if down[k] > bottom or before < bottom else bottom
                value.append(bottom if side > 0 else top)
            way.append(side)
            before = c
        return np.array([value, way])


# --- stages over blocks ---------------------------------------------------------------------------------------------------

#: What a stage makes of a block: arrays (``s``: own bars and halo; ``own``: how many bars the halo has) and the columns of
#: earlier stages (own bars only) -> recurrences by name, and how their runs become columns.
Stage = tuple[Callable[[dict, int, dict], dict[str, Recurrence]], Callable[[dict, int, dict, dict], dict]]


def _flat(parts: list[Numbers]) -> Numbers:
    """Lists of numbers as one, each behind its length."""
    return [x for p in parts for x in (float(len(p)), *p)]


def _parts(flat: Numbers) -> list[Numbers]:
    out, at = [], 0
    while at < len(flat):
        n = int(flat[at])
        out.append(flat[at + 1 : at + 1 + n])
        at += 1 + n
    return out


def runs(bars: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Bars with ``__run``; the last ``halo`` bars of a block also go with the next."""
    if halo > block:
        raise ValueError("a halo is one block long at most")
    own = F.floor(F.col("bar_seq") / block).cast("long")
    with_next = F.array_compact(F.array(own, F.when(F.pmod(F.col("bar_seq"), F.lit(block)) >= block - halo, own + 1)))
    return bars.withColumn("__run", F.explode(with_next))


def scan(bars: DataFrame, stages: list[Stage], columns: list[str], block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Bars with the columns that the stages make (doubles, NaN as null)."""
    cols = [f.name for f in bars.schema]
    numeric = [f.name for f in bars.schema if isinstance(f.dataType, T.NumericType)]
    rows = runs(bars, block, halo)
    group = [*KEYS, "__run"]
    head = "symbol string, tf string, __run long, "

    def arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, dict, int]:
        pdf = pdf.sort_values("bar_seq", kind="stable").reset_index(drop=True)
        own = int((pdf["bar_seq"].to_numpy() < int(pdf["__run"].iloc[0]) * block).sum())
        return pdf, {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in numeric}, own

    def upto(s: dict, own: int, states: list[Numbers]) -> dict:
        """The columns of the stages whose states are known."""
        made: dict = {}
        for (recur, finish), flat in zip(stages, states, strict=False):
            rs = recur(s, own, made)
            made |= finish(s, own, {k: r.run(p) for (k, r), p in zip(rs.items(), _parts(flat), strict=True)}, made)
        return made

    def summarise(k: int):
        def of(pdf: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
            if not len(pdf) or int(pdf["bar_seq"].max()) < int(pdf["__run"].iloc[0]) * block:
                return pd.DataFrame(columns=["symbol", "tf", "__run", "known", "v"])  # a halo with no block behind it
            p, s, own = arrays(pdf)
            states = _parts(list(known["known"].iloc[0])) if known is not None else []
            rs = stages[k][0](s, own, upto(s, own, states))
            return pd.DataFrame({"symbol": [p["symbol"].iloc[0]], "tf": [p["tf"].iloc[0]], "__run": [p["__run"].iloc[0]], "known": [_flat(states)], "v": [_flat([r.summary() for r in rs.values()])]})

        return of

    def compose(k: int):
        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__run", kind="stable")
            nothing = {c: np.zeros(0) for c in numeric}
            rs = list(stages[k][0](nothing, 0, _Nothing()).values())
            state = [r.start() for r in rs]
            out = []
            for r in pdf.itertuples(index=False):
                out.append((r.symbol, r.tf, r[2], _flat([*_parts(list(r.known)), _flat(state)])))
                state = [x.carry(a, v) for x, a, v in zip(rs, state, _parts(list(r.v)), strict=True)]
            return pd.DataFrame(out, columns=["symbol", "tf", "__run", "known"])

        return of

    states: DataFrame | None = None
    for k in range(len(stages)):
        schema, of = head + "known array<double>, v array<double>", summarise(k)
        found = rows.groupBy(*group).applyInPandas(_alone(of), schema) if states is None else rows.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(_with(of), schema)
        states = found.groupBy(*KEYS).applyInPandas(compose(k), head + "known array<double>")
    out = T.StructType([*bars.schema, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def finish(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(known):
            return pd.DataFrame(columns=out.names)
        p, s, own = arrays(pdf)
        made = upto(s, own, _parts(list(known["known"].iloc[0])))
        p = p.iloc[own:].reset_index(drop=True)
        return pd.concat([p[cols], pd.DataFrame({c: np.asarray(made[c], float) for c in columns})], axis=1)[out.names]

    return rows.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(finish, out)


def _alone(of: Callable) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: of(rows)


def _with(of: Callable) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda rows, known: of(rows, known)


class _Nothing(dict):
    """Columns of no bars."""

    def __missing__(self, key: str) -> np.ndarray:
        return np.zeros(0)
