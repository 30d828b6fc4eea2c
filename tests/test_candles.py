"""The candle source: what it plans, what it reads, and a stream that starts again."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tickloom.sources import candles
from tickloom.sources.bars import event_bars
from tickloom.sources.feed import remote_symbol

COLS = ["symbol", "tf", "ts", "open", "high", "low", "close", "volume"]


def rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


@pytest.fixture(scope="module")
def bars(spark, data):
    return event_bars(spark, data, "1h").cache()


@pytest.fixture(scope="module")
def feed(bars, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    candles.write_feed(bars, path)
    return path


def test_reads_what_was_laid_down(spark, bars, feed):
    assert rows(candles.read(spark, feed, "1h")) == rows(bars)
    assert rows(candles.read(spark, feed, "1h", step_days=0.1)) == rows(bars)  # seams double nothing
    assert candles.read(spark, feed, "5m").count() == 0


def test_filters_choose_chunks(spark, bars, feed):
    low, high = datetime(2024, 1, 8, 12), datetime(2024, 1, 15)
    where = (F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz")) & F.col("symbol").isin("click", "view")
    got = candles.read(spark, feed, "1h", step_days=1).where(where)
    assert rows(got) == rows(bars.where(where))
    assert got.rdd.getNumPartitions() < candles.read(spark, feed, "1h", step_days=1).rdd.getNumPartitions() / 3
    reader = candles.CandleReader({"path": feed, "tf": "1h", "step_days": "1"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("ts",), low), LessThan(("ts",), high), In(("symbol",), ("click", "view")), EqualTo(("close",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThanOrEqual", "LessThan", "EqualTo"]  # rows are still held against times
    plan = reader.partitions()
    assert {c.symbol for c in plan} == {"click", "view"}
    assert min(c.start for c in plan) == candles.seconds(low)
    assert max(c.end for c in plan) <= candles.seconds(high) + 1
    none = candles.CandleReader({"path": feed, "tf": "1h"})
    list(none.pushFilters([EqualTo(("tf",), "4h")]))
    assert none.partitions() == []


class Shaky:
    """Answers with a doubled time, one outside the chunk, a null price, no volume; one day fails at first, one always."""

    tried: dict = {}

    def __init__(self, options):
        self.bad = options.get("bad")

    def symbols(self, resolution):
        return ["A"]

    def span(self, names, resolution):
        return 0, 5 * candles.DAY - 1

    def candles(self, name, resolution, start, end):
        n = self.tried[start] = self.tried.get(start, 0) + 1
        if start == candles.DAY and n < 2 or self.bad and start == 2 * candles.DAY:
            raise OSError("no answer")
        if start == 3 * candles.DAY:
            return {"s": "no_data"}
        return {"s": "ok", "t": [start + 60, start + 60, start, end], "o": [1, 9, 2, 3], "h": [1, 9, None, 3], "l": [1, 9, 2, 3], "c": [1, 9, 2, 3]}


def shaky(**options):
    return candles.Feed({"transport": "tests.test_candles:Shaky" if __name__.startswith("tests") else f"{__name__}:Shaky", "tf": "1m", "step_days": "1"} | options)


def test_answers_are_cleaned_and_asked_for_again():
    Shaky.tried = {}
    f = shaky()
    got = [r for c in f.chunks(*f.span()) for b in f.rows(c) for r in b.to_pylist()]
    assert [(r["ts"].day, r["ts"].minute, r["open"], r["high"], r["volume"]) for r in got] == [(d, m, o, h, 0.0) for d in (1, 2, 3, 5) for m, o, h in ((0, 2.0, None), (1, 1.0, 1.0))]
    assert Shaky.tried[candles.DAY] == 2


def test_a_chunk_that_fails_is_an_error_or_left_out():
    f = shaky(bad="1", retries="1")
    with pytest.raises(OSError, match="no answer"):
        list(f.rows(f.chunks(*f.span())[2]))
    f = shaky(bad="1", retries="1", on_failure="skip")
    assert [len(list(f.rows(c))) for c in f.chunks(*f.span())] == [1, 1, 0, 0, 1]


def test_a_stream_goes_on_where_it_was(spark, bars, tmp_path):
    path, out, ckpt = (str(tmp_path / x) for x in ("feed", "out", "ckpt"))
    cut = datetime(2024, 1, 20, 5)

    def run():
        q = candles.stream(spark, path, "1h").writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.schema(candles.SCHEMA).parquet(out))

    before = bars.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    candles.write_feed(before, path)
    assert run() == rows(before)
    first = candles.marker(ckpt)
    assert run() == rows(before)  # nothing new
    candles.write_feed(bars.where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz")), path)
    assert run() == rows(bars)
    assert candles.marker(ckpt) > first
    # A batch that was planned but not committed runs again with the same rows.
    last = max((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == rows(bars)
    assert candles.marker(str(tmp_path / "none")) is None


def test_names():
    assert [remote_symbol(*x) for x in (("XAUUSD", "forex"), ("eurusd", "Forex"), ("BTCUSDT", "crypto"), ("AAPL", "stock"), ("oanda:x", "forex"))] == ["OANDA:XAU_USD", "OANDA:EURUSD", "BINANCE:BTCUSDT", "AAPL", "OANDA:X"]
