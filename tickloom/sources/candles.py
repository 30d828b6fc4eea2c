"""The candle feed as a Spark data source: ``spark.read.format("candles")`` and ``spark.readStream.format("candles")``.

A read is planned in chunks of time, one partition a symbol and chunk. Bounds on
ts and choices of symbols are taken over from the query's filters, so chunks that
it doesn't need are never asked for. A stream's offset is the time that it has
read up to; a batch asks for what lies between two offsets, so a batch that runs
again, or a query that starts again from its checkpoint, gets the same rows.

What answers a request is a transport: ``candles(name, resolution, start, end)``
gives a decoded answer (``s``, ``t``, ``o``, ``h``, ``l``, ``c``, ``v``) with the
candles of [start, end) at least, ``symbols(resolution)`` the names it has, and
``span(names, resolution)`` the first and last time. ``FileTransport`` answers from
files that ``write_feed`` (or anything else) has laid down; a service is another
class with these three methods, named by the option ``transport``.

Options: ``path`` (of the file transport), ``transport`` (module:class, made with
the options), ``tf``, ``symbols`` (comma-separated; all if left out), ``asset_class``,
``start`` and ``end`` (ISO times, UTC; the feed's own span if left out), ``step_days``,
``retries``, ``on_failure`` (``fail``, or ``skip``: the other chunks stand), ``overlap``
(seconds that a stream's batch reads again, for corrections).

Defined results: a time that an answer holds twice counts once, the first of it;
candles outside a chunk are dropped, so a time at the seam of two chunks isn't
doubled; volume is 0 where it is missing; an answer that isn't ``ok`` has no rows.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tickloom.sources.bars import SECONDS, timeframe
from tickloom.sources.feed import CHUNK_DAYS, RESOLUTIONS, remote_symbol

SCHEMA = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
DAY = 86_400


def resolution(tf: str) -> str:
    return RESOLUTIONS.get(tf, str(SECONDS[tf] // 60))


def seconds(at: str | datetime) -> float:
    """UTC seconds of an ISO time or a datetime (UTC where it has no zone)."""
    t = datetime.fromisoformat(at) if isinstance(at, str) else at
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp()


class FileTransport:
    """Candles from Parquet files under path/remote=NAME/resolution=R/day=N, N in days since 1970; the path may be of any
    file system that pyarrow knows."""

    def __init__(self, options: dict[str, str]):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (pyarrow.fs.LocalFileSystem(), options["path"])
        self.columns = pa.schema([("t", pa.int64()), *[(c, pa.float64()) for c in "ohlcv"], ("remote", pa.string()), ("resolution", pa.string()), ("day", pa.int64())])

    def _files(self) -> ds.Dataset:
        return ds.dataset(self.root, self.columns, format="parquet", filesystem=self.fs, partitioning=ds.partitioning(pa.schema([self.columns.field(c) for c in ("remote", "resolution", "day")]), flavor="hive"))

    def candles(self, name: str, resolution: str, start: int, end: int) -> dict | None:
        day, t = ds.field("day"), ds.field("t")
        mine = (ds.field("remote") == name) & (ds.field("resolution") == resolution) & (day >= start // DAY) & (day <= end // DAY) & (t >= start) & (t < end)
        got = self._files().to_table(columns=["t", *"ohlcv"], filter=mine)
        return {"s": "ok" if len(got) else "no_data"} | {c: got.column(c).to_pylist() for c in got.column_names}

    def _parts(self, resolution: str) -> list[dict]:
        """The partition values of the files, from their names alone."""
        return [k for f in self._files().get_fragments() if (k := ds.get_partition_keys(f.partition_expression)).get("resolution") == resolution]

    def symbols(self, resolution: str) -> list[str]:
        return sorted({k["remote"] for k in self._parts(resolution)})

    def span(self, names: list[str], resolution: str) -> tuple[int, int] | None:
        """First and last time, from the files of the first and last day."""
        days = [k["day"] for k in self._parts(resolution) if k["remote"] in names]
        if not days:
            return None
        t = [self._files().to_table(columns=["t"], filter=(ds.field("day") == d) & (ds.field("resolution") == resolution) & ds.field("remote").isin(names)).column("t").to_numpy() for d in (min(days), max(days))]
        return int(t[0].min()), int(t[1].max())


def write_feed(bars: DataFrame, path: str, asset_class: str = "stock") -> None:
    """Lay bars down as a feed's answers, a folder a symbol, resolution and day."""
    name = F.when(F.lit(asset_class == "crypto"), F.concat(F.lit("BINANCE:"), F.upper("symbol"))).otherwise(F.col("symbol"))
    res = F.coalesce(*[F.when(F.col("tf") == k, resolution(k)) for k in SECONDS])
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = bars.select(t.alias("t"), *[F.col(c).cast("double").alias(c[0]) for c in ("open", "high", "low", "close", "volume")], name.alias("remote"), res.alias("resolution"), F.floor(t / DAY).alias("day"))
    rows.repartition("remote", "resolution", "day").write.mode("append").partitionBy("remote", "resolution", "day").parquet(path)


@dataclass
class Chunk(InputPartition):
    symbol: str
    start: int
    end: int


class Feed:
    """What both readers share: the transport, the span asked for, its chunks, and the rows of one."""

    def __init__(self, options):
        o = {k.lower(): v for k, v in dict(options).items()}
        module, _, name = o.get("transport", "").partition(":")
        self.transport = getattr(importlib.import_module(module), name)(o) if module else FileTransport(o)
        self.tf = timeframe(o.get("tf", "1m"))
        self.resolution, self.asset_class = resolution(self.tf), o.get("asset_class", "stock")
        self.symbols = [s.strip() for s in o["symbols"].split(",") if s.strip()] if "symbols" in o else self.transport.symbols(self.resolution)
        self.start, self.end = (int(seconds(o[k])) if k in o else None for k in ("start", "end"))
        self.step = max(1, int(float(o.get("step_days", CHUNK_DAYS)) * DAY))
        self.retries, self.skip, self.overlap = int(o.get("retries", 2)), o.get("on_failure", "fail") == "skip", int(o.get("overlap", 0))

    def named(self, symbol: str) -> str:
        return symbol if self.asset_class == "stock" else remote_symbol(symbol, self.asset_class)

    def span(self) -> tuple[int, int]:
        """[start, end) of the options, or of what there is."""
        if self.start is not None and self.end is not None:
            return self.start, self.end
        there = self.transport.span([self.named(s) for s in self.symbols], self.resolution) or (0, -1)
        return self.start if self.start is not None else there[0], self.end if self.end is not None else there[1] + 1

    def chunks(self, start: int, end: int, symbols: Sequence[str] | None = None) -> list[Chunk]:
        return [Chunk(s, at, min(end, at + self.step)) for s in (self.symbols if symbols is None else symbols) for at in range(start, end, self.step)]

    def rows(self, c: Chunk) -> Iterator[pa.RecordBatch]:
        for left in range(self.retries, -1, -1):
            try:
                answer = self.transport.candles(self.named(c.symbol), self.resolution, c.start, c.end)
                break
            except Exception:
                if left == 0 and not self.skip:
                    raise
        else:
            return
        if not answer or answer.get("s") != "ok":
            return
        t, first = np.unique(np.asarray(answer["t"], np.int64), return_index=True)
        first = first[(t >= c.start) & (t < c.end)]
        n = len(first)
        if n:
            t = np.asarray(answer["t"], np.int64)[first]
            volume = answer.get("v") or [0.0] * len(answer["t"])
            prices = [pa.array(np.asarray([np.nan if x is None else x for x in v], float)[first], from_pandas=True) for v in (answer["o"], answer["h"], answer["l"], answer["c"], [0.0 if x is None else x for x in volume])]
            yield pa.RecordBatch.from_arrays([pa.array([c.symbol] * n), pa.array([self.tf] * n), pa.array(t * 1_000_000, pa.timestamp("us")), *prices], ["symbol", "tf", "ts", "open", "high", "low", "close", "volume"])


class CandleReader(DataSourceReader):
    def __init__(self, options):
        self.feed, self.low, self.high, self.chosen = Feed(options), None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ts narrow the span (to whole seconds; Spark applies them to the rows), symbols and tf choose chunks."""
        for f in filters:
            name = f.attribute[0].lower() if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name == "ts" and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo) and isinstance(f.value, datetime):
                at = seconds(f.value)
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(int(at // 1), self.low if self.low is not None else int(at // 1))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(int(at // 1) + 1, self.high if self.high is not None else int(at // 1) + 1)
                yield f
            elif name in ("symbol", "tf") and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                if name == "tf":
                    values = set(self.feed.symbols) if self.feed.tf in values else set()
                self.chosen = values if self.chosen is None else self.chosen & values
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        start, end = self.feed.span()
        start, end = max(start, self.low) if self.low is not None else start, min(end, self.high) if self.high is not None else end
        return self.feed.chunks(start, end, [s for s in self.feed.symbols if self.chosen is None or s in self.chosen])

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.feed.rows(partition) if partition is not None else iter(())


class CandleStream(DataSourceStreamReader):
    """Offsets are {"at": seconds}: all times before it have been read."""

    def __init__(self, options):
        self.options = dict(options)
        self.feed = Feed(self.options)

    def initialOffset(self) -> dict:
        return {"at": self.feed.span()[0]}

    def latestOffset(self) -> dict:
        return {"at": max(self.feed.span())}

    def partitions(self, start: dict, end: dict) -> list[Chunk]:
        if end["at"] <= start["at"]:
            return []
        return self.feed.chunks(start["at"] - self.feed.overlap, end["at"])

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return self.feed.rows(partition)


class CandleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)

    def streamReader(self, schema) -> CandleStream:
        return CandleStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters handed over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CandleSource)


def read(spark: SparkSession, path: str, tf: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("candles").options(path=path, tf=tf, **options).load()


def stream(spark: SparkSession, path: str, tf: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("candles").options(path=path, tf=tf, **options).load()


def marker(checkpoint: str) -> int | None:
    """The time that a stream with this checkpoint folder has read up to (its last planned batch)."""
    fs, root = pyarrow.fs.FileSystem.from_uri(checkpoint) if ":" in checkpoint else (pyarrow.fs.LocalFileSystem(), checkpoint)
    found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
    if not found:
        return None
    with fs.open_input_stream(max(found, key=lambda f: int(f.base_name)).path) as s:
        return json.loads(s.read().decode().splitlines()[-1])["at"]
