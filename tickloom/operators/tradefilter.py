"""The trade filter: labels, scores, thresholds and what is left of a strategy under each."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import windows as W
from tickloom.operators import boosting
from tickloom.operators.asof import asof, with_positions
from tickloom.operators.indicators import bollinger_bands, recursive
from tickloom.operators.metrics import trade_metrics
from tickloom.sources.bars import numeric_features

DEFAULT_THRESHOLD = 0.55
UNALIGNED = 0.5


def label() -> Column:
    """1 for a trade that gained points (or, without points, money)."""
    return F.when(F.coalesce(F.col("points"), F.col("pnl")) > 0, 1).otherwise(0)


def split_at(n: Column) -> Column:
    """How many of n trades in time order train: half of fewer than 10, else 80 %, 60 % at least, all but 5 at most."""
    return F.when(n < 10, F.floor(n / 2)).otherwise(F.least(F.greatest(F.bround(n * 0.8).cast("long"), F.floor(n * 0.6).cast("long")), n - 5)).cast("long")


def with_split(trades: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return trades.withColumn("n", F.count("*").over(w)).withColumn("train", (F.row_number().over(w.orderBy("entry_time", "trade_id")) - 1) < split_at(F.col("n")))


def structure_score() -> Column:
    """The score where no model can be trained, from structure columns."""
    c = F.col
    trend = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.coalesce(c("trend_strength"), F.lit(0)) / 12.0))
    act = F.greatest(F.lit(0.0), F.least(F.lit(0.12), (F.coalesce(c("smc_activity_score_5"), F.lit(0)) + F.coalesce(c("smc_activity_score_10"), F.lit(0))) * 0.015))
    broke = F.least(F.lit(1), F.coalesce(c("is_bos_bullish"), F.lit(0)) + F.coalesce(c("is_bos_bearish"), F.lit(0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + trend + act + 0.05 * broke))


def fallback_scores(trades: DataFrame, structure: DataFrame) -> DataFrame:
    cols = ["trend_strength", "smc_activity_score_5", "smc_activity_score_10", "is_bos_bullish", "is_bos_bearish"]
    got = asof(trades, structure, "entry_time", "ts", ["symbol", "tf"], ["bar_seq", *cols])
    return got.withColumn("score", F.when(F.col("bar_seq") >= 1, structure_score()).otherwise(UNALIGNED)).drop("bar_seq", *cols)


def context_features(bars: DataFrame) -> DataFrame:
    """The nine-feature context of the older filter, by bar (the side comes with the trade)."""
    df = recursive(bars, {"rsi_14": ("rsi", {}), "a": ("adx", {}), "atr_14": ("atr", {}), "e9": ("ema", {"period": 9}), "e50": ("ema", {"period": 50})})
    bb, c = bollinger_bands(), F.col("close")
    return df.select("symbol", "tf", "ts", "bar_seq", "rsi_14", F.col("a_adx").alias("adx_14"), F.try_divide(F.col("atr_14"), c).alias("atr_pct"), F.try_divide(c - bb["bb_lower"], bb["bb_upper"] - bb["bb_lower"]).alias("bb_pos"), W.change("close", 5).alias("ret_5"), W.change("close", 20).alias("ret_20"), F.try_divide(F.col("e9") - F.col("e50"), c).alias("ema_diff_pct"), F.try_divide(F.col("volume"), W.rmean("volume", 20)).alias("vol_ratio"))


CONTEXT = ["rsi_14", "adx_14", "atr_pct", "bb_pos", "ret_5", "ret_20", "ema_diff_pct", "vol_ratio"]


def trade_context(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades with CONTEXT and side_long; unknown values become the series' median, then 0."""
    got = asof(trades, context_features(bars), "entry_time", "ts", ["symbol", "tf"], ["bar_seq", *CONTEXT]).where(F.col("bar_seq").isNotNull())
    med = got.groupBy("symbol", "tf").agg(*[F.percentile(x, F.lit(0.5)).alias(f"__{x}") for x in CONTEXT])
    return got.join(med, ["symbol", "tf"]).withColumns({x: F.coalesce(x, f"__{x}", F.lit(0.0)) for x in CONTEXT} | {"side_long": (F.col("side") == "long").cast("double")}).drop("bar_seq", *[f"__{x}" for x in CONTEXT])


def context_score() -> Column:
    """The older filter's score: 0.5, moved by trend, agreement, RSI, band position and volatility, within 0..1."""
    c = F.col
    agree = ((c("side_long") == 1) & (c("ema_diff_pct") > 0)) | ((c("side_long") == 0) & (c("ema_diff_pct") < 0))
    moves = [
        F.when(c("adx_14") >= 25, 0.1).when(c("adx_14") < 15, -0.1).otherwise(0.0), F.when(agree, 0.1).otherwise(-0.1),
        F.when(c("rsi_14").between(40, 60), 0.05).when((c("rsi_14") >= 80) | (c("rsi_14") <= 20), -0.1).otherwise(0.0),
        F.when(c("bb_pos").between(0.3, 0.7), 0.05).when((c("bb_pos") >= 1) | (c("bb_pos") <= 0), -0.05).otherwise(0.0), F.when(c("atr_pct") > 0.03, -0.05).otherwise(0.0),
    ]
    total = F.lit(0.5)
    for m in moves:
        total = total + m
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def structure_rows(trades: DataFrame, structure: DataFrame) -> tuple[DataFrame, list[str]]:
    """Trades with every numeric structure column of the bar they enter on, and those columns' names. Trades without a
    bar, or on a series' first, are left out: no model scores them, they count as UNALIGNED."""
    names = numeric_features(structure)
    return with_positions(trades, structure, names).drop("bar_seq"), names


def train_boosted(rows: DataFrame, features: list[str], **settings) -> boosting.Model | None:
    """A boosted model of ``label`` on rows with ``train``: 250 rounds of step 0.03, 15 leaves, depth 6, L1 and L2 of 0.1,
    stopped where the other rows' loss hasn't fallen for 40 rounds; None where one class or under 30 rows."""
    return boosting.train(rows, features, boosting.Settings(**settings))


def boosted_scores(model: boosting.Model | None, rows: DataFrame) -> DataFrame:
    """Rows with the model's score; without a model (too few rows) with structure_score."""
    return rows.withColumn("score", structure_score()) if model is None else boosting.scored(model, rows)


def importances(model: boosting.Model | None, features: list[str]) -> list[tuple[str, float]]:
    """By share of the gain, largest first; without a model equal shares of the first twenty."""
    return boosting.heuristic_importances(features) if model is None else model.importances()


def stored_scores(spark: SparkSession, path: str, trades: DataFrame, bars: DataFrame, fill_missing: bool = False) -> DataFrame:
    """The older filter with a stored model: the context of each trade's bar, scored by the model where one can be read and
    applied (mode model), else by context_score (mode heuristic)."""
    rows = trade_context(trades, bars)
    try:
        model = boosting.load(spark, path)
        return boosting.scored(model, rows, fill_missing).withColumn("mode", F.lit("model"))
    except (AnalysisException, ValueError):
        return rows.withColumn("score", context_score()).withColumn("mode", F.lit("heuristic"))


def evaluate(scored: DataFrame) -> DataFrame:
    """Accuracy and the area under the curve, for training rows and the rest: by ranks, ties averaged."""
    right = (F.col("score") >= 0.5).cast("int").eqNullSafe(F.col("label"))
    # Equal scores are one row before they are ranked.
    by = scored.groupBy("train", "score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.count_if(right).alias("right"))
    below = F.sum("n").over(Window.partitionBy("train").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    r = by.withColumn("__r", below + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    return r.groupBy("train").agg((F.sum("right") / n).alias("accuracy"), F.try_divide(F.sum(F.col("pos") * F.col("__r")) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def best_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of 0.02, 0.025 ... 0.985 the threshold under which the kept test trades have most points, the lowest of equals;
    DEFAULT_THRESHOLD without test trades."""
    grid = scored.where(~F.col("train")).withColumn("t", F.explode(F.transform(F.sequence(F.lit(4), F.lit(197)), lambda k: F.round(k / 200.0, 3))))
    sums = grid.groupBy(*keys, "t").agg(F.coalesce(F.sum(F.when(F.col("score") >= F.col("t"), F.coalesce("points", "pnl"))), F.lit(0.0)).alias("points"))
    best = sums.groupBy(*keys).agg(F.max(F.struct("points", (-F.col("t")).alias("t"))).alias("b")).select(*keys, (-F.col("b.t")).alias("threshold"))
    return scored.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def apply_threshold(scored: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    return scored.join(thresholds, keys).withColumn("kept", F.coalesce("score", F.lit(UNALIGNED)) >= F.col("threshold"))


def exit_metrics(exits: DataFrame, curve: DataFrame, keys: list[str], group: list[str], initial_capital: float) -> DataFrame:
    """total_return_pct, sharpe_ratio and max_drawdown_pct as curve_metrics has them of whole curves, from the bars alone on
    which something is gained or lost (group: the keys and what else tells curves apart; bar_seq, pnl, a row a bar).
    Bars between have the return 0: they are counted, not made."""
    bars = curve.groupBy(*keys).agg(F.count("*").alias("__bars"))
    w = Window.partitionBy(*group).orderBy("bar_seq")
    e = exits.join(bars, keys).withColumn("__e", F.lit(initial_capital) + F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("__e", 1, initial_capital).over(w)
    first = F.row_number().over(w) == 1
    # A curve that changes on its first bar begins there; else with the initial capital.
    start = F.when(F.min("bar_seq").over(Window.partitionBy(*group)) > 0, F.lit(initial_capital))
    peak = F.greatest(start, F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    still = F.coalesce(F.lead("bar_seq").over(w), F.col("__bars")) - F.col("bar_seq") - 1
    e = e.withColumns({
        "__r": F.when(F.col("bar_seq") > 0, F.try_divide(F.col("__e") - before, before)), "__dd": F.try_divide(F.col("__e") - peak, peak),
        "__zeros": F.when(F.col("__e") != 0, still).otherwise(0) + F.when(first, F.greatest(F.col("bar_seq") - 1, F.lit(0))).otherwise(0),
    })
    a = e.groupBy(*group).agg(F.max_by("__e", "bar_seq").alias("__final"), F.min("__dd").alias("__dd"), F.sum("__zeros").alias("__zeros"), F.count("__r").alias("__k"), F.coalesce(F.sum("__r"), F.lit(0.0)).alias("__s1"), F.coalesce(F.sum(F.col("__r") * F.col("__r")), F.lit(0.0)).alias("__s2"))
    n = F.col("__zeros") + F.col("__k")
    mean = F.try_divide(F.col("__s1"), n)
    deviation = F.sqrt(F.greatest(F.try_divide(F.col("__s2"), n) - mean * mean, F.lit(0.0)))
    return a.select(
        *group, ((F.col("__final") / initial_capital - 1) * 100).alias("total_return_pct"), (F.least(F.coalesce("__dd", F.lit(0.0)), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        F.when((n > 1) & (deviation > 0), F.sqrt(F.lit(252.0)) * mean / deviation).otherwise(0.0).alias("sharpe_ratio"),
    )


def threshold_sweep(scored: DataFrame, curve: DataFrame, keys: list[str], initial_capital: float = 100_000.0) -> DataFrame:
    """keys, threshold (0.02 to 0.98 by 0.02), kept, dropped, kept_pct and the metrics of what is kept: one grouped pass
    for all thresholds. Exits find their bars once; each threshold then has the bars that something happens on."""
    c = curve.select(*keys, "ts", "bar_seq")
    placed = asof(scored.drop("bar_seq", "ts"), c, "exit_time", "ts", keys, ["bar_seq"]).withColumn("bar_seq", F.coalesce("bar_seq", F.lit(0)))
    t = placed.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(1), F.lit(49)), lambda k: F.round(k / 50.0, 2)))).withColumn("__keep", F.coalesce("score", F.lit(UNALIGNED)) >= F.col("threshold"))
    sizes = t.groupBy(*keys, "threshold").agg(F.count_if("__keep").alias("kept"), F.count_if(~F.col("__keep")).alias("dropped"))
    k2 = [*keys, "threshold"]
    kept = t.where("__keep")
    exits = kept.groupBy(*k2, "bar_seq").agg(F.sum("pnl").alias("pnl"))
    m = exit_metrics(exits, c, keys, k2, initial_capital).join(trade_metrics(kept, k2), k2, "full")
    cols = ["total_return_pct", "sharpe_ratio", "win_rate_pct", "max_drawdown_pct", "profit_factor", "expectancy", "avg_trade", "total_points", "avg_points"]
    return sizes.join(m, k2, "left").select(*k2, "kept", "dropped", (100.0 * F.col("kept") / F.greatest(F.lit(1), F.col("kept") + F.col("dropped"))).alias("kept_pct"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


def choose_threshold(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Of thresholds that keep a tenth of the trades (one at least) that with most points, then the best Sharpe ratio."""
    ok = sweep.where(F.col("kept") >= F.greatest(F.lit(1), F.floor(0.1 * (F.col("kept") + F.col("dropped")))))
    return ok.groupBy(*keys).agg(F.max_by(F.struct("threshold", "kept", "total_points", "sharpe_ratio"), F.struct("total_points", "sharpe_ratio", -F.col("threshold"))).alias("b")).select(*keys, "b.*")


def scored_table(scored: DataFrame, keys: list[str], kept: bool | None = None, limit: int | None = None) -> DataFrame:
    """Trades by falling score, all or only kept or dropped ones, the first of each series."""
    rows = scored if kept is None else scored.where(F.col("kept") == kept)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "trade_id")
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def sweep_highlights(sweep: DataFrame, keys: list[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The thresholds with the best return and the best Sharpe ratio, and the one nearest to a given one."""
    return sweep.groupBy(*keys).agg(F.max_by("threshold", F.struct("total_return_pct", -F.col("threshold"))).alias("best_return"), F.max_by("threshold", F.struct("sharpe_ratio", -F.col("threshold"))).alias("best_sharpe"), F.min_by("threshold", F.struct(F.abs(F.col("threshold") - threshold), "threshold")).alias("nearest"))


