"""Window expressions with the null rules that rolling indicators need.

A series is what shares ``symbol`` and ``tf``; its order is ``bar_seq``. A rolling
value is null until its frame holds n values that aren't null (``full``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ["symbol", "tf"]


def series() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("bar_seq")


def frame(n: int, offset: int = 0) -> WindowSpec:
    """The n rows that end ``offset`` rows before this one."""
    return series().rowsBetween(-(n - 1) - offset, -offset)


def running() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(value: Column, x: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(x).over(w) == n, value)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(_c(x), k).over(series())


def diff(x: Column | str, k: int = 1) -> Column:
    return _c(x) - lag(x, k)


def change(x: Column | str, k: int = 1) -> Column:
    """Relative change over k rows; null where the earlier value is 0."""
    return F.try_divide(_c(x), lag(x, k)) - 1


def rmean(x: Column | str, n: int) -> Column:
    return full(F.avg(_c(x)).over(frame(n)), _c(x), n, frame(n))


def rsum(x: Column | str, n: int) -> Column:
    return full(F.sum(_c(x)).over(frame(n)), _c(x), n, frame(n))


def rmax(x: Column | str, n: int, offset: int = 0) -> Column:
    w = frame(n, offset)
    return full(F.max(_c(x)).over(w), _c(x), n, w)


def rmin(x: Column | str, n: int, offset: int = 0) -> Column:
    w = frame(n, offset)
    return full(F.min(_c(x)).over(w), _c(x), n, w)


def rstd(x: Column | str, n: int) -> Column:
    """Sample deviation."""
    return full(F.stddev_samp(_c(x)).over(frame(n)), _c(x), n, frame(n))


def rstd_pop(x: Column | str, n: int) -> Column:
    return full(F.stddev_pop(_c(x)).over(frame(n)), _c(x), n, frame(n))


def rquantile(x: Column | str, n: int, p: float) -> Column:
    """Linear interpolation between the frame's values."""
    return full(F.percentile(_c(x), F.lit(p)).over(frame(n)), _c(x), n, frame(n))


def rrank(x: Column | str, n: int) -> Column:
    """Rank of the last value in its frame, ties averaged, over n."""
    x = _c(x)
    vals = F.collect_list(x).over(frame(n))
    below = F.size(F.filter(vals, lambda v: v < x))
    same = F.size(F.filter(vals, lambda v: v == x))
    return F.when((F.size(vals) == n) & x.isNotNull(), (below + (same + 1) / 2) / n)


def weighted_mean(x: Column | str, n: int) -> Column:
    """Weights 1 to n, the last row's the largest."""
    terms = [F.lag(_c(x), k).over(series()) * (n - k) for k in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / (n * (n + 1) / 2)


def forward_fill(x: Column | str) -> Column:
    return F.last(_c(x), ignorenulls=True).over(running())


def last_event(flag: Column, value: Column, lookback: int | None = None, inclusive: bool = False) -> Column:
    """The value at the latest row with the flag before this one (or up to it), within lookback rows if given."""
    w = series().rowsBetween(Window.unboundedPreceding if lookback is None else -lookback, 0 if inclusive else -1)
    return F.last(F.when(flag, value), ignorenulls=True).over(w)


def flag(cond: Column) -> Column:
    """1 or 0; unknown counts 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def cross_up(a: Column, b: Column, a1: Column, b1: Column) -> Column:
    return (a > b) & (a1 <= b1)


def cross_down(a: Column, b: Column, a1: Column, b1: Column) -> Column:
    return (a < b) & (a1 >= b1)


def in_blocks(bars: DataFrame, f: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, block: int = 1_000_000) -> DataFrame:
    """f over runs of ``block`` bars instead of whole series, for one long series must not be one task.

    f may look ``back`` bars back and ``ahead`` bars ahead; so many bars of the neighbours go with each run, and their
    rows are dropped again. f sees the run in ``tf`` (the windows' key) and keeps symbol, tf and bar_seq.
    """
    own, at = F.floor(F.col("bar_seq") / block).cast("long"), F.pmod(F.col("bar_seq"), F.lit(block))
    runs = F.array_compact(F.array(own, F.when(at >= block - back, own + 1), F.when((at < ahead) & (own > 0), own - 1)))
    rows = bars.withColumn("__run", F.explode(runs)).withColumn("tf", F.concat("tf", F.lit("#"), F.col("__run").cast("string"))).drop("__run")
    out = f(rows)
    return out.where(F.substring_index("tf", "#", -1).cast("long") == own).withColumn("tf", F.substring_index("tf", "#", 1))
