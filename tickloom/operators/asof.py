"""As-of lookups: the latest bar at or before a time, by one shuffle of both sides.

Rows of both sides are unioned and sorted together in each series; the last bar
seen is carried forward. Nothing is compared pairwise, whatever the lengths.

With ``rows`` a series is cut into blocks of time, so a long or hot one spreads
over tasks: a scan of two levels. Bounds of blocks are quantiles of all times, so
about ``rows`` rows of both sides together lie in a block (rows of one instant stay
together). Each block's last bar is one aggregate; a window over blocks, a row a
block, carries it on; within a block only its own bars are walked, and a row
before the first of them takes what was carried in. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks at most: their bounds are literals of the plan. Beyond, blocks hold more rows each.
MAX_BLOCKS = 4096


def block_bounds(times: DataFrame, rows: int) -> list[int]:
    """Bounds between blocks of about so many of these times (one long column, microseconds)."""
    n = times.count()
    parts = min(MAX_BLOCKS, -(-n // rows)) if n else 1
    if parts <= 1:
        return []
    at = [k / parts for k in range(1, parts)]
    return sorted(set(times.agg(F.percentile_approx(times.columns[0], at, 10 * parts).alias("q")).first()["q"] or []))


def block_of(at: Column, bounds: list[int]) -> Column:
    """How many bounds are at or before a time; a look in two short arrays."""
    if not bounds:
        return F.lit(0)
    side = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    far = F.size(F.filter(F.array(*[F.lit(r[0]) for r in runs]), lambda x: x <= at))
    near = F.get(F.array(*[F.array(*[F.lit(x) for x in r]) for r in runs]), F.greatest(far - 1, F.lit(0)))
    return F.when(far == 0, 0).otherwise((far - 1) * side + F.size(F.filter(near, lambda x: x <= at)))


def _micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def asof_blocks(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], columns: list[str], rows: int = 1_000_000) -> DataFrame:
    """asof() in blocks of about ``rows`` rows. Left rows without a time find nothing; right rows without one count nowhere."""
    bounds = block_bounds(left.select(_micros(left_time).alias("t")).unionByName(right.select(_micros(right_time).alias("t"))), rows)
    if not bounds:
        return asof(left, right, left_time, right_time, keys, columns)
    block = block_of(F.col("__us"), bounds)
    bar = F.struct(right_time, *columns)
    l = left.select(*keys, F.col(left_time).alias("__t"), _micros(left_time).alias("__us"), F.struct(*left.columns).alias("__left")).withColumn("__block", F.coalesce(block, F.lit(0)))  # noqa: E741
    r = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("__t")).agg(F.max(bar).alias("__bar")).withColumn("__us", _micros("__t")).withColumn("__block", block)
    last = r.groupBy(*keys, "__block").agg(F.max_by("__bar", "__t").alias("__last"))
    # Blocks with rows to fill, and what the blocks before them end with: a row a block and series.
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    asked = l.select(*keys, "__block").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType))
    carry = last.unionByName(asked).groupBy(*keys, "__block").agg(F.first("__last", ignorenulls=True).alias("__last")).withColumn("__in", F.last("__last", ignorenulls=True).over(over)).where("__in IS NOT NULL")
    # The carried bar stands before all of its block, so no join of the rows is needed.
    left_type, bar_type = l.schema["__left"].dataType, r.schema["__bar"].dataType
    none_left, none_bar = F.lit(None).cast(left_type), F.lit(None).cast(bar_type)
    parts = [
        carry.select(*keys, "__block", F.lit(None).cast("long").alias("__us"), F.lit(0).alias("__side"), none_left.alias("__left"), F.col("__in").alias("__bar")),
        r.select(*keys, "__block", "__us", F.lit(1).alias("__side"), none_left.alias("__left"), "__bar"),
        l.select(*keys, "__block", "__us", F.when(F.col("__us").isNull(), -1).otherwise(2).alias("__side"), "__left", none_bar.alias("__bar")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy(*keys, "__block").orderBy("__us", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__hit", F.last("__bar", ignorenulls=True).over(w)).where("__left IS NOT NULL")
    return got.select("__left.*", *[F.col("__hit")[c].alias(c) for c in columns])


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: list[str], columns: list[str], rows: int | None = None) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before its time (null if none). Of right
    rows at one time the one with the greatest columns counts, those without a time nowhere. With ``rows``, in blocks of about so many."""
    if rows is not None:
        return asof_blocks(left, right, left_time, right_time, keys, columns, rows)
    bar = F.struct(right_time, *columns)
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(bar.alias("b")).schema[0].dataType).alias("__bar"))  # noqa: E741
    r = right.where(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("__t")).agg(F.max(bar).alias("__bar")).select(*keys, "__t", F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__left"].dataType).alias("__left"), "__bar")
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__hit", F.last("__bar", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__left.*", *[F.col("__hit")[c].alias(c) for c in columns])


def with_positions(trades: DataFrame, bars: DataFrame, columns: list[str]) -> DataFrame:
    """Trades with the columns of the bar they enter on, only where that isn't the first bar of the series."""
    return asof(trades, bars, "entry_time", "ts", ["symbol", "tf"], ["bar_seq", *columns]).where(F.col("bar_seq") >= 1)


def equity_from_trades(trades: DataFrame, curve: DataFrame, keys: list[str], initial_capital: float = 100_000.0) -> DataFrame:
    """An equity curve on the given curve's times: each trade's pnl falls on the last time at or before its exit (the
    first, if all are later), sums run on, and the last row has the exact total."""
    c = curve.select(*keys, "ts", "bar_seq")
    first = c.groupBy(*keys).agg(F.min("ts").alias("__t0"), F.max("bar_seq").alias("__last"))
    got = asof(trades.select(*keys, "exit_time", "pnl"), c, "exit_time", "ts", keys, ["bar_seq"])
    per = got.groupBy(*keys, F.coalesce("bar_seq", F.lit(0)).alias("bar_seq")).agg(F.sum("pnl").alias("__pnl"))
    w = Window.partitionBy(*keys).orderBy("bar_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = c.join(per, [*keys, "bar_seq"], "left").join(first.drop("__t0"), keys)
    total = F.sum("__pnl").over(Window.partitionBy(*keys))
    run = F.when(F.col("bar_seq") == F.col("__last"), total).otherwise(F.sum("__pnl").over(w))
    return out.select(*keys, "ts", "bar_seq", (F.lit(initial_capital) + F.coalesce(run, F.lit(0.0))).alias("equity"))
