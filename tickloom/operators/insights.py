"""Trades by session, hour, weekday, month and by what indicators said at entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.operators.asof import asof
from tickloom.operators.indicators import recursive
from tickloom.operators.metrics import profit_factor

#: The session calendars (they differ, and are kept apart), hours in UTC.
SESSIONS = [("Asia", 0, 7), ("London", 7, 12), ("Overlap", 12, 16), ("NewYork", 16, 22), ("OffHrs", 22, 24)]
RULE_SESSIONS = ["Asian", "London", "Overlap", "US"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def session_of(hour: Column) -> Column:
    out = F.lit("OffHrs")
    for name, a, b in SESSIONS[:-1]:
        out = F.when((hour >= a) & (hour < b), name).otherwise(out)
    return out


def rule_session_of(hour: Column) -> Column:
    return F.when((hour >= 13) & (hour < 16), "Overlap").when((hour >= 8) & (hour < 13), "London").when((hour >= 16) & (hour < 22), "US").otherwise("Asian")


def _weekday(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def session_breakdown(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (session, hour, weekday), bucket and figures, with a row for every bucket. One pass over the trades:
    each counts in one bucket of each kind."""
    hour = F.hour("entry_time")
    kinds = F.array(F.struct(F.lit("session").alias("kind"), session_of(hour).alias("bucket")), F.struct(F.lit("hour").alias("kind"), hour.cast("string").alias("bucket")), F.struct(F.lit("weekday").alias("kind"), _weekday(F.col("entry_time")).alias("bucket")))
    x = F.col("pnl")
    rows = trades.where(F.col("entry_time").isNotNull()).select(*keys, "pnl", F.inline(kinds))
    got = rows.groupBy(*keys, "kind", "bucket").agg(F.count("*").alias("n_trades"), F.count_if(x > 0).alias("w"), F.sum(x).alias("total_pnl"), F.avg(x).alias("avg_trade"), F.max(x).alias("best_trade"), F.min(x).alias("worst_trade"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("gp"), F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)).alias("gl"))
    all_ = [("session", s) for s, _, _ in SESSIONS] + [("hour", str(h)) for h in range(24)] + [("weekday", d) for d in WEEKDAYS]
    dense = trades.select(*keys).distinct().select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bucket")) for k, b in all_])))
    z = F.lit(0.0)
    return dense.join(got, [*keys, "kind", "bucket"], "left").select(
        *keys, "kind", "bucket", F.coalesce("n_trades", F.lit(0)).alias("n_trades"), F.coalesce(100.0 * F.try_divide("w", "n_trades"), z).alias("win_rate_pct"), F.coalesce("total_pnl", z).alias("total_pnl"),
        F.coalesce("avg_trade", z).alias("avg_trade"), F.coalesce("best_trade", z).alias("best_trade"), F.coalesce("worst_trade", z).alias("worst_trade"), F.coalesce(profit_factor(F.col("gp"), F.col("gl")), z).alias("profit_factor"), F.coalesce("avg_trade", z).alias("expectancy"),
    )


def _bucket(pred: Column, win: Column, base_rate: Column, base_n: Column) -> Column:
    n = F.count_if(pred)
    rate = F.coalesce(F.try_divide(F.count_if(pred & win), n), F.lit(0.0))
    some = n > 0
    return F.struct(n.alias("trades"), (rate * 100).alias("win_rate_pct"), F.when(some, (rate - base_rate) * 100).otherwise(0.0).alias("improvement_vs_base_pct"), F.coalesce(F.try_divide(100.0 * n, base_n), F.lit(0.0)).alias("retention_pct"))


def rule_insights(trades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, bucket, trades, win_rate_pct, improvement_vs_base_pct, retention_pct, avg_points: all buckets of the
    rules' calendar, by one aggregate with a pair of counts for each."""
    hour, day = F.hour("entry_time"), F.weekday("entry_time")
    s = rule_session_of(hour)
    preds = [("session", b, s == b) for b in RULE_SESSIONS] + [("weekday", d, day == i) for i, d in enumerate(WEEKDAYS)] + [("hour", str(h), hour == h) for h in range(24)]
    win = F.col("pnl") > 0
    base_n = F.count("*")
    base_rate = F.try_divide(F.count_if(win), base_n)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bucket"), _bucket(p, win, base_rate, base_n).alias("x"), F.coalesce(F.avg(F.when(p, F.col("points"))), F.lit(0.0)).alias("avg_points")) for k, b, p in preds])
    return trades.where(F.col("entry_time").isNotNull()).groupBy(*keys).agg(rows.alias("r")).select(*keys, F.inline("r")).select(*keys, "kind", "bucket", "x.*", "avg_points")


def insight_rules(insights: DataFrame, keys: list[str], min_n: int = 5) -> DataFrame:
    """Best and worst session and best weekday among buckets of min_n trades: keys, rule, bucket, win_rate_pct, trades."""
    ok = insights.where(F.col("trades") >= min_n)
    s = ok.where("kind = 'session'").groupBy(*keys).agg(F.max(F.struct("win_rate_pct", "trades", "bucket")).alias("b"), F.min(F.struct("win_rate_pct", (-F.col("trades")).alias("n"), "bucket", "trades")).alias("w"))
    s = s.where("b.bucket <> w.bucket").select(*keys, F.inline(F.array(F.struct(F.lit("best_session").alias("rule"), F.col("b.bucket"), F.col("b.win_rate_pct"), F.col("b.trades")), F.struct(F.lit("worst_session").alias("rule"), F.col("w.bucket"), F.col("w.win_rate_pct"), F.col("w.trades")))))
    d = ok.where("kind = 'weekday'").groupBy(*keys).agg(F.max(F.struct("win_rate_pct", "trades", "bucket")).alias("b")).select(*keys, F.lit("best_weekday").alias("rule"), "b.bucket", "b.win_rate_pct", "b.trades")
    return s.unionByName(d)


def entry_features(bars: DataFrame) -> DataFrame:
    """What the conditioned insights look at, by bar."""
    df = recursive(bars, {"rsi_14": ("rsi", {}), "m": ("macd", {}), "a": ("adx", {}), **{f"ema_{n}": ("ema", {"period": n}) for n in (8, 13, 21, 50, 200)}})
    low = W.rmin("low", 14)
    df = df.withColumn("stoch_k", F.try_divide(100 * (F.col("close") - low), W.rmax("high", 14) - low)).withColumn("stoch_d", W.rmean("stoch_k", 3))
    return df.select("symbol", "tf", "ts", "bar_seq", "close", "rsi_14", F.col("m_macd").alias("macd"), F.col("m_macd_signal").alias("macd_signal"), F.col("m_macd_hist").alias("macd_hist"), F.col("a_adx").alias("adx"), F.col("a_plus_di").alias("plus_di"), F.col("a_minus_di").alias("minus_di"), "stoch_k", "stoch_d", *[f"ema_{n}" for n in (8, 13, 21, 50, 200)])


def aligned_trades(trades: DataFrame, features: DataFrame) -> DataFrame:
    cols = [c for c in features.columns if c not in ("symbol", "tf", "ts")]
    return asof(trades, features, "entry_time", "ts", ["symbol", "tf"], cols).where("rsi_14 IS NOT NULL AND macd IS NOT NULL AND adx IS NOT NULL")


def technical_insights(trades: DataFrame, features: DataFrame, min_trades: int = 10) -> DataFrame:
    """symbol, tf, test, label and the bucket's figures: every conditioned bucket of each series with enough aligned
    trades. One as-of join, one aggregate for the medians, one for the tests that trades pass."""
    t = aligned_trades(trades, features)
    keys = ["symbol", "tf"]
    c = F.col
    for n in (21, 50):
        t = t.withColumn(f"d{n}", F.abs(F.try_divide(c("close") - c(f"ema_{n}"), c("close"))))
    med = t.groupBy(*keys).agg(*[F.percentile(f"d{n}", F.lit(0.5)).alias(f"m{n}") for n in (21, 50)], *[F.count(f"d{n}").alias(f"k{n}") for n in (21, 50)])
    t = t.join(med, keys)
    long, short = c("side") == "long", c("side") == "short"

    def sided(a: Column, b: Column) -> Column:
        return (long & a) | (short & b)

    def stack(x: str, y: str, z: str) -> tuple[Column, Column]:
        return (c(x) > c(y)) & (c(y) > c(z)), (c(x) < c(y)) & (c(y) < c(z))

    up, down = stack("ema_8", "ema_21", "ema_50")
    trend = c("close") > c("ema_200")
    di = c("plus_di") > c("minus_di")
    preds: list[tuple[str, str, Column]] = [("rsi_extremes", f"{k}", sided(c("rsi_14") < 100 - k, c("rsi_14") > k)) for k in range(70, 100, 5)]
    preds += [("macd", "direction", sided(c("macd") > c("macd_signal"), c("macd") < c("macd_signal"))), ("macd", "zero", sided(c("macd") > 0, c("macd") < 0)), ("macd", "histogram", sided(c("macd_hist") > 0, c("macd_hist") < 0))]
    preds += [("adx_gt", f"{k}", c("adx") > k) for k in range(15, 55, 5)] + [("adx_ge", f"{k}", c("adx") >= k) for k in (15, 20, 25)]
    strong = c("adx") > 25
    preds += [("adx_di", "long", long & di & strong), ("adx_di", "short", short & ~di & (c("plus_di") < c("minus_di")) & strong), ("adx_di", "both", sided(di, c("plus_di") < c("minus_di")) & strong)]
    preds += [("stochastic", f"{k}", sided((c("stoch_k") < k) & (c("stoch_d") < k), (c("stoch_k") > 100 - k) & (c("stoch_d") > 100 - k))) for k in range(10, 35, 5)]
    preds += [("ema", "8>21>50", sided(up, down)), ("ema", "8>13>21", sided(*stack("ema_8", "ema_13", "ema_21"))), ("ema", "21>50>200", sided(*stack("ema_21", "ema_50", "ema_200"))), ("ema", "price_21", sided(c("close") > c("ema_21"), c("close") < c("ema_21"))), ("ema", "counter", sided(down, up))]
    preds += [("distance", f"{n}_{w}", (c(f"k{n}") >= 20) & p) for n in (21, 50) for w, p in (("near", c(f"d{n}") <= c(f"m{n}")), ("far", c(f"d{n}") > c(f"m{n}")))]
    preds += [("trend", "with", sided(trend, ~trend)), ("trend", "counter", sided(~trend, trend)), ("hours", "13-16", F.hour("entry_time").between(13, 16))]
    # Each trade gives the numbers of the tests that it passes; a pair of counts a test, and a row of none for each of them.
    passed = F.array_compact(F.array(F.lit(-1), *[F.when(p, F.lit(i)) for i, (_, _, p) in enumerate(preds)]))
    hits = t.select(*keys, (c("pnl") > 0).alias("won"), F.explode(passed).alias("i")).groupBy(*keys, "i").agg(F.count("*").alias("hits"), F.count_if("won").alias("wins"))
    of = F.map_from_entries(F.collect_list(F.struct("i", F.struct("hits", "wins"))))  # as many entries as tests
    by = hits.groupBy(*keys).agg(of.alias("of")).withColumns({"n": c("of")[-1]["hits"], "base": F.try_divide(c("of")[-1]["wins"], c("of")[-1]["hits"])}).where(c("n") >= min_trades)
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("test"), F.lit(b).alias("label")) for i, (a, b, _) in enumerate(preds)])
    out = by.select(*keys, "of", "n", "base", F.inline(names)).withColumn("x", F.try_element_at("of", "i"))
    k = F.coalesce(c("x.hits"), F.lit(0))
    rate = F.coalesce(F.try_divide(c("x.wins"), k), F.lit(0.0))
    return out.select(*keys, "test", "label", k.alias("trades"), (rate * 100).alias("win_rate_pct"), F.when(k > 0, (rate - c("base")) * 100).otherwise(0.0).alias("improvement_vs_base_pct"), F.coalesce(F.try_divide(100.0 * k, c("n")), F.lit(0.0)).alias("retention_pct"))


def highlights(buckets: DataFrame, min_n: int = 30) -> DataFrame:
    """The best RSI and ADX bucket of min_n trades, of equals the lowest limit, and how trades with the trend do against
    those counter to it."""
    keys = ["symbol", "tf"]
    first = (-F.col("label").try_cast("int")).alias("first")
    best = buckets.where(F.col("test").isin("rsi_extremes", "adx_gt") & (F.col("trades") >= min_n)).groupBy(*keys, "test").agg(F.max_by(F.struct("label", "win_rate_pct", "trades"), F.struct("win_rate_pct", "trades", first)).alias("b")).select(*keys, "test", "b.*")
    trend = buckets.where("test = 'trend'").groupBy(*keys).agg(F.max_by(F.struct("label", "win_rate_pct", "trades"), F.struct("win_rate_pct", "label")).alias("b")).select(*keys, F.lit("trend").alias("test"), "b.*")
    return best.unionByName(trend)


def monthly(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys, F.date_format("entry_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("trades"), (100.0 * F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate_pct"), F.sum("points").alias("total_points"))


def spotlights(rules: DataFrame, technical: DataFrame, trades: DataFrame) -> DataFrame:
    """Up to two buckets of each series worth showing: the top score, then the best of the other category (else the next).
    Score: improvement * ln(1 + n), hours by 0.92, ADX by 1.05; only buckets large enough that improve by 0.75 points."""
    keys = ["symbol", "tf"]
    base = trades.groupBy(*keys).agg(F.count("*").alias("N")).where("N >= 15")
    least = F.greatest(F.lit(8), F.least(F.lit(40), F.floor(0.04 * F.col("N") + 10)))
    a = rules.where("kind IN ('session', 'hour')").select(*keys, F.col("kind").alias("test"), F.col("bucket").alias("label"), "trades", "win_rate_pct", F.col("improvement_vs_base_pct").alias("imp"), F.lit("time").alias("category"))
    b = technical.where("test IN ('macd', 'adx_gt', 'rsi_extremes')").select(*keys, "test", "label", "trades", "win_rate_pct", F.col("improvement_vs_base_pct").alias("imp"), F.lit("indicator").alias("category"))
    factor = F.when(F.col("test") == "hour", 0.92).when(F.col("test") == "adx_gt", 1.05).otherwise(1.0)
    x = a.unionByName(b).join(base, keys).where((F.col("trades") >= least) & (F.col("imp") >= 0.75)).withColumn("score", F.col("imp") * F.log1p("trades") * factor)
    # Of hours only the one that improves most.
    best_hour = F.row_number().over(Window.partitionBy(*keys, "test").orderBy(F.desc("imp"), F.col("label").try_cast("int")))
    x = x.withColumn("__h", best_hour).where("test <> 'hour' OR __h = 1").drop("__h")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "test", "label")
    x = x.withColumn("__r", F.row_number().over(w)).withColumn("__top", F.first("category").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = Window.partitionBy(*keys).orderBy(F.when(F.col("__r") == 1, 0).when(F.col("category") != F.col("__top"), 1).otherwise(2), "__r")
    return x.withColumn("rank", F.row_number().over(rest)).where("rank <= 2").select(*keys, "rank", "category", "test", "label", "trades", "win_rate_pct", "imp", "score")
