"""Bar tables: reading, deriving, resampling, slicing, upserting.

A bar has symbol, tf, ts (UTC, no zone; the start of its bucket), bar_seq (0.. in
order of ts), open, high, low, close and volume as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close", "volume"]
COLUMNS = ["symbol", "tf", "ts", "bar_seq", *PRICES]
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in PRICES]])
#: Names of timeframes and their seconds, other spellings, and the instruments known.
SECONDS = {"1m": 60, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
ALIASES = {"1min": "1m", "5min": "5m", "10min": "10m", "15min": "15m", "30min": "30m", "60min": "1h", "60m": "1h", "1hr": "1h", "1hour": "1h", "240m": "4h", "4hr": "4h", "4hour": "4h", "daily": "1d", "day": "1d", "1day": "1d", "d": "1d", "h1": "1h", "h4": "4h", "d1": "1d", "m1": "1m", "m5": "5m", "m10": "10m", "m15": "15m", "m30": "30m", "weekly": "1w", "1week": "1w"}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def timeframe(label: str) -> str:
    """The canonical name of a timeframe; unknown names come back stripped and in lower case."""
    s = "".join(label.split()).lower()
    return ALIASES.get(s, s)


def timeframe_column(c: Column) -> Column:
    flat = F.lower(F.regexp_replace(c, r"\s", ""))
    pairs = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.get(F.array(pairs[flat]), F.lit(0)), flat)


def bucket(ts: Column, tf: str) -> Column:
    """The start of the bucket of this length that holds ts, counted from the epoch."""
    return F.window(ts, f"{SECONDS[tf]} seconds").start


def numbered(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "tf").orderBy("ts")
    return df.withColumn("bar_seq", (F.row_number().over(w) - 1).cast("long")).select(*COLUMNS)


def from_ticks(ticks: DataFrame, tf: str, symbol: str, ts: str, price: str, tie: str) -> DataFrame:
    """Bars of single prices: volume counts them, ties in time go by the tie column."""
    at, p = F.struct(ts, tie), F.col(price)
    b = ticks.groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), tf).alias("ts")).agg(F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return numbered(b.withColumn("tf", F.lit(tf)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), tf, "event_type", "ts", "value", "event_id")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    return from_ticks(orders, "1d", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def resample(bars: DataFrame, tf: str) -> DataFrame:
    """Longer bars: first, highest, lowest, last, sum; empty buckets don't appear, nor bars with a null."""
    at = F.struct("ts", "bar_seq")
    b = bars.groupBy("symbol", bucket(F.col("ts"), tf).cast("timestamp_ntz").alias("ts")).agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
    return numbered(b.dropna(subset=PRICES).withColumn("tf", F.lit(tf)))


def normalise(df: DataFrame, symbol: str | None = None, tf: str | None = None, arrival: str | None = None) -> DataFrame:
    """Any table with prices as bars: names trimmed and lower-cased, ts from ``ts``, ``datetime`` or epoch seconds
    ``timestamp``, bad ts dropped, volume 0 where missing, of a ts the row with the greatest ``arrival`` kept (without such a
    column, the last of the table as Spark has it)."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    kinds = dict(df.dtypes)
    if "ts" not in kinds:
        if "datetime" in kinds:
            df = df.withColumn("ts", F.try_to_timestamp("datetime").cast("timestamp_ntz"))
        elif "timestamp" in kinds:
            df = df.withColumn("ts", F.timestamp_seconds(F.col("timestamp").try_cast("double")).cast("timestamp_ntz"))
        else:
            raise ValueError("no ts, datetime or timestamp column")
    if missing := [c for c in PRICES[:4] if c not in kinds]:
        raise ValueError(f"missing columns: {missing}")
    if "volume" not in kinds:
        df = df.withColumn("volume", F.lit(0.0))
    df = df.withColumn("symbol", F.upper(F.lit(symbol)) if symbol else F.upper("symbol")).withColumn("tf", F.lit(timeframe(tf)) if tf else F.col("tf"))
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).where(F.col("ts").isNotNull()).withColumns({c: F.col(c).try_cast("double") for c in PRICES})
    order = F.col(arrival) if arrival else F.monotonically_increasing_id()
    w = Window.partitionBy("symbol", "tf", "ts").orderBy(order.desc())
    return numbered(df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r"))


def read_parquet(spark: SparkSession, root: str, symbol: str | None = None, tf: str | None = None, start=None, end=None, version: int | None = None) -> DataFrame:
    """Stored bars of one version (the newest), only the units asked for, sliced inclusively; none where nothing is stored."""
    from tickloom.sources.snapshots import bar_table

    s = bar_table(spark, root).snapshot(version)
    df = s.read(s.named(symbol and symbol.upper(), tf and timeframe(tf)))
    return numbered(time_slice(df, start, end))


def read_csv(spark: SparkSession, path: str, symbol: str, tf: str) -> DataFrame:
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    # Arrival: by file, place in the file, and row; rows of a piece of a file come in order.
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return normalise(raw.withColumn("__arrival", at), symbol, tf, "__arrival")


def read_bars(spark: SparkSession, root: str, symbol: str, tf: str, csv: str | None = None, start=None, end=None) -> DataFrame:
    """Parquet where it has rows, else CSV."""
    df = read_parquet(spark, root, symbol, tf, start, end)
    return df if csv is None or not df.isEmpty() else numbered(time_slice(read_csv(spark, csv, symbol, tf), start, end))


def write_parquet(bars: DataFrame, root: str) -> None:
    """Put bars in place of what is stored of their series, as one version."""
    from tickloom.sources.snapshots import bar_table

    bar_table(bars.sparkSession, root).replace(bars.select("symbol", "tf", "ts", *PRICES))


def merge_last(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' bars; where both have a ts, the new one's."""
    both = old.select("symbol", "tf", "ts", *PRICES, F.lit(0).alias("__p")).unionByName(new.select("symbol", "tf", "ts", *PRICES, F.lit(1).alias("__p")))
    best = both.groupBy("symbol", "tf", "ts").agg(F.max_by(F.struct(*PRICES), "__p").alias("x")).select("symbol", "tf", "ts", "x.*")
    return numbered(best)


def upsert(spark: SparkSession, root: str, new: DataFrame) -> int:
    """Lay new bars over the stored ones, reading and writing only the units that they touch; the version made."""
    from tickloom.sources.snapshots import bar_table

    return bar_table(spark, root).upsert(new.select("symbol", "tf", "ts", *PRICES))


def latest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "tf").agg(F.max("ts").alias("latest_ts"))


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def time_slice(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive at both ends; a bare date means its midnight."""
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if end is None else bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def relative_slice(bars: DataFrame, value: int, unit: str) -> DataFrame:
    """The last value units of each series, back from its own last bar; a month is 30 days, a year 365."""
    last = F.max("ts").over(Window.partitionBy("symbol", "tf"))
    return bars.withColumn("__last", last).where(F.col("ts") >= F.col("__last") - F.make_dt_interval(F.lit(value * UNIT_DAYS[unit.rstrip("s")]))).drop("__last")


def tail(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol", "tf").orderBy(F.desc("bar_seq"))
    return bars.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def downsample(curve: DataFrame, points: int = 600) -> DataFrame:
    """Every k-th row of each series (k from its length), and its last."""
    n = F.count("*").over(Window.partitionBy("symbol", "tf"))
    k = F.greatest(F.lit(1), F.floor(n / points))
    return curve.withColumns({"__n": n, "__k": k}).where((F.col("bar_seq") % F.col("__k") == 0) | (F.col("bar_seq") == F.col("__n") - 1)).drop("__n", "__k")


def numeric_features(df: DataFrame, deny: set[str] = frozenset({"symbol", "tf", "ts", "bar_seq", *PRICES})) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType | T.BooleanType) and f.name.lower() not in deny]


def scrub(x: Column) -> Column:
    """0 for null, NaN and the infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
