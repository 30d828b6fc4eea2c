"""Seconds per million bars of the operators that spread a long series; prints one JSON line.

    python bench_bars.py [BARS] [NAME...]

Bars come from ``events`` of $BENCH_SF_DIR, read over and over, one bar an event; half
of them are one symbol's. Each operator's whole result is written to a sink that
drops it, once (plans of these take seconds, the bars many times that).
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from tickloom.functions.order import rolling_order
    from tickloom.operators import flags, indicators
    from tickloom.operators import scan as S
    from tickloom.operators.asof import asof
    from tickloom.session import session
    from tickloom.sources import bars as B
    from tickloom.sources.store import cut

    spark = session("bench_bars", f"local[{cpus}]", **{"spark__sql__shuffle__partitions": str(4 * cpus), "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    copies = -(-n // events.count())
    rows = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("k", F.col("copy") * 1_000_003 + F.col("event_id"))
    symbol = F.when(F.hash("k") % 2 == 0, "HOT").otherwise(F.col("event_type"))
    at = (F.timestamp_seconds(F.col("k") * 60)).cast("timestamp_ntz")
    price = F.col("value") + 100
    bars = rows.select(symbol.alias("symbol"), F.lit("1m").alias("tf"), at.alias("ts"), price.alias("open"), (price * 1.01).alias("high"), (price * 0.99).alias("low"), (price + F.pmod(F.hash("k", F.lit(7)), F.lit(100)) / 100).alias("close"), (1.0 + F.pmod(F.hash("k", F.lit(8)), F.lit(50))).alias("volume"))
    bars = cut(B.numbered(bars))
    total = bars.count()

    def averages(s, own, made):
        return {f"e{k}": S.Faded(s["close"][own:], 2 / (k + 1)) for k in (9, 21, 50)}

    work = {
        "averages_one_task": lambda: indicators.recursive(bars, {f"e{k}": ("ema", {"period": k}) for k in (9, 21, 50)}),
        "averages_in_blocks": lambda: S.scan(bars, [(averages, lambda s, own, got, made: got)], ["e9", "e21", "e50"]),
        "order_in_blocks": lambda: rolling_order(bars, "close", {"r": ("rank", 50), "q": ("quantile", 50, 0.7)}),
        "asof_one_window": lambda: asof(bars, bars.where("bar_seq % 10 = 0"), "ts", "ts", B.COLUMNS[:2], ["close"]),
        "asof_in_blocks": lambda: asof(bars, bars.where("bar_seq % 10 = 0"), "ts", "ts", B.COLUMNS[:2], ["close"], 200_000),
        "flags_all": lambda: flags.flag_features(bars, "1m"),
    }
    times = {}
    for name, f in work.items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            began = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            times[name] = round((time.perf_counter() - began) / total * 1e6, 2)
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "seconds_per_million_bars", "bars": total, "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
