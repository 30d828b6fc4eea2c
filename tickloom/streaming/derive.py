"""Tables that follow a bar table: longer bars and features, kept up by what has changed.

A version of the table says which units it touched. Rows that differ between the
version that was last followed and the newest (read from those units alone) give
the keys of the longer bars that are to be made again; their source rows are found
in the units that they lie in, aggregated, and laid over the longer bars, buckets
that have lost all rows are taken out. How far the table has been followed is a
mark in the version that has the result, so a run that dies has done nothing, and a
run that comes again does nothing twice.

Features have a horizon: how many bars back a row looks, and how many ahead (pivots
that are known late). A change reaches the rows up to ``back`` bars after it and
``ahead`` before it; these are made again, unit by unit, from the bars that they
need. Numbers of bars in units are in the versions, so none is read to count them.
An average without bound has the horizon at which its past weighs less than 1e-12
(``fading``); a feature whose memory doesn't fade has None: all later rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.bars import PRICES, SECONDS, bucket
from tickloom.sources.snapshots import BarTable, Snapshot, _unit_column
from tickloom.sources.store import cut

#: Bars that columns look back on, and ahead; averages by their weights.
def fading(alpha: float, share: float = 1e-12) -> int:
    """Bars after which the past of an average weighs less than a share."""
    return math.ceil(math.log(share) / math.log(1 - alpha))


HORIZONS: dict[str, tuple[int | None, int]] = {
    "sma": (19, 0), "wma": (19, 0), "bollinger_bands": (19, 0), "stochastic": (15, 0), "roc": (12, 0), "ema": (fading(2 / 21), 0), "rsi": (fading(1 / 14) + 1, 0),
    "macd": (fading(2 / 27) + fading(2 / 10), 0), "atr": (fading(1 / 14) + 1, 0), "adx": (2 * fading(1 / 14) + 1, 0), "keltner_channel": (fading(1 / 20) + 1, 0), "supertrend": (None, 0), "obv": (None, 0),
}


def horizon(names: list[str]) -> tuple[int | None, int]:
    """That of several columns together."""
    found = [HORIZONS[n] for n in names]
    return None if any(b is None for b, _ in found) else max(b for b, _ in found), max(a for _, a in found)


def _touched(table: BarTable, now: Snapshot, mark: str, tf: str) -> set[str]:
    """Units of a timeframe that versions after the mark have touched, those that are gone too."""
    since = now.marks.get(mark, 0)
    units = set(now.units) if since == 0 else table.changes(since)[1]
    return {u for u in units if u.rsplit("-", 2)[1] == tf}


def changed_rows(table: BarTable, now: Snapshot, since: int, units: set[str]) -> DataFrame:
    """Rows of these units that aren't the same in both versions; a row that is corrected stands twice."""
    a = now.read(units)
    b = table.snapshot(since).read(units) if since else a.where("false")
    return a.unionByName(b).groupBy(*table.schema.names).count().where("count = 1").drop("count")


def refresh_bars(table: BarTable, base: str, longer: str) -> int:
    """Bring the longer bars up to the newest version of the base ones; the version that has them."""
    mark, now = f"bars {base} {longer}", table.snapshot()
    units = _touched(table, now, mark, base)
    if not units:
        return now.version
    at = bucket(F.col("ts"), longer).cast("timestamp_ntz")
    rows = changed_rows(table, now, now.marks.get(mark, 0), units)
    keys = cut(rows.select("symbol", at.alias("start")).distinct())
    # The units that the buckets lie in.
    length, unit = SECONDS[longer], SECONDS[base] * table.unit_bars
    first = F.unix_timestamp(F.col("start").cast("timestamp"))
    spans = F.sequence(F.floor(first / unit), F.floor((first + length - 1) / unit))
    names = keys.select("symbol", F.explode(spans).alias("k")).distinct().select("symbol", F.lit(base).alias("tf"), F.timestamp_seconds(F.col("k") * unit).cast("timestamp_ntz").alias("ts"))
    source = {r["u"] for r in names.select(_unit_column(table.unit_bars).alias("u")).distinct().collect()}
    src = now.read(source).withColumn("start", at).join(keys, ["symbol", "start"], "left_semi")
    new = src.groupBy("symbol", "start").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).dropna(subset=PRICES)
    new = cut(new.select("symbol", F.lit(longer).alias("tf"), F.col("start").alias("ts"), *PRICES))
    gone = keys.select("symbol", F.lit(longer).alias("tf"), F.col("start").alias("ts")).join(new.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    return table.upsert(new, gone, {mark: now.version})


def _reach(ordered: list[str], counts: dict[str, int], hit: set[str], back: int | None, ahead: int) -> set[str]:
    """Of a series' units in order: those hit, and those next to them that hold the ``back`` bars after and the ``ahead``
    bars before."""
    out = set(hit)
    for units, n in ((ordered, back), (ordered[::-1], ahead)):
        left: float = -1
        for u in units:
            if left > 0:
                out.add(u)
                left -= counts.get(u, 0)
            if u in hit:
                left = math.inf if n is None else n
    return out


def _place(unit: str) -> int:
    k = unit.rsplit("-", 1)[1]
    return -int(k[1:]) if k[0] == "m" else int(k)


def plan(now: Snapshot, hit: set[str], back: int | None, ahead: int) -> tuple[set[str], set[str], dict[str, int]]:
    """Units to make again, units to read for them, and for each series the number of bars before the first one read."""
    series: dict[str, list[str]] = {}
    for u in {*now.units, *hit}:
        series.setdefault(u.rsplit("-", 1)[0], []).append(u)
    again: set[str] = set()
    read: set[str] = set()
    before: dict[str, int] = {}
    counts = {u: n for u, (_, n) in now.units.items()}
    for name, units in series.items():
        own = hit & set(units)
        if not own:
            continue
        ordered = sorted(units, key=_place)
        mine = _reach(ordered, counts, own, back, ahead)
        need = set(ordered) if back is None else _reach(ordered, counts, mine, ahead, back)
        again |= mine
        read |= need
        before[name] = sum(counts.get(u, 0) for u in ordered[: min(i for i, u in enumerate(ordered) if u in need)])
    return again, read, before


def refresh_features(table: BarTable, features: BarTable, tf: str, compute: Callable[[DataFrame], DataFrame], back: int | None, ahead: int = 0) -> int:
    """Bring a table of features (symbol, tf, ts and the columns of its schema) up to the newest version of the bars.
    ``compute`` gets bars with their true bar_seq."""
    mark, now = f"bars of {tf}", table.snapshot()
    at = features.snapshot()
    since = at.marks.get(mark, 0)
    units = set(now.units) if since == 0 else table.changes(since)[1]
    hit = {u for u in units if u.rsplit("-", 2)[1] == tf}
    if not hit:
        return at.version
    again, read, before = plan(now, hit, back, ahead)
    spark = table.spark
    offsets = spark.createDataFrame(list(before.items()), "series string, __before long")
    w = Window.partitionBy("symbol", "tf").orderBy("ts")
    rows = now.read(read).withColumn("series", F.regexp_replace(_unit_column(table.unit_bars), "-[^-]*$", "")).join(F.broadcast(offsets), "series")
    rows = rows.withColumn("bar_seq", (F.row_number().over(w) - 1 + F.col("__before")).cast("long")).select("symbol", "tf", "ts", "bar_seq", *PRICES)
    wanted = spark.createDataFrame([(u,) for u in again], "unit string")
    made = compute(rows).select(*features.schema.names).withColumn("unit", _unit_column(table.unit_bars)).join(F.broadcast(wanted), "unit", "left_semi").drop("unit")
    return features.put_units(made, again, {mark: now.version})
