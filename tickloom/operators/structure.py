"""Market structure: swings, breaks, sweeps, order blocks, gaps. Window expressions throughout.

The trend is a machine of two states. A bar that closes over the last swing high
sets it up, one under the last swing low sets it down, one that does both turns
it; so the state is the last setting, turned as often as bars since then did
both, and needs no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import windows as W

BACK = {5: "last_5", 10: "last_10", 20: "last_20"}
EVENTS = {"pivot_high": "is_pivot_high", "pivot_low": "is_pivot_low", "hh": "is_hh", "ll": "is_ll", "choch": "is_choch", "bos": "is_bos"}


def _confirmed(side: str, n: int) -> Column:
    """True n bars behind a bar strictly beyond the n bars before it and not passed by the n bars after it."""
    x = F.col(side)
    top = F.max if side == "high" else F.min
    before = top(x).over(W.frame(n, n + 1))
    after = top(x).over(W.frame(n, 0))
    mid = W.lag(side, n)
    beyond = (mid > before) & (mid >= after) if side == "high" else (mid < before) & (mid <= after)
    return (F.col("bar_seq") >= 2 * n) & beyond


def market_structure(bars: DataFrame, choch_period: int = 50, idm_period: int = 3, swing_length: int = 8) -> DataFrame:
    """Bars with the swing, break, inducement, order block and sweep columns, the counts of recent events and the candle,
    volume and trend columns beside them. Order blocks are flagged at an earlier bar, so they know what came after."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    seq = W.series()
    df = bars.withColumns({
        "is_pivot_high": W.flag(_confirmed("high", swing_length)),
        "is_pivot_low": W.flag(_confirmed("low", swing_length)),
        "__sh": W.flag(_confirmed("high", idm_period)),
        "__sl": W.flag(_confirmed("low", idm_period)),
        "is_fvg_bullish": W.flag(W.lag("high", 3) < W.lag("low", 1)),
        "__gap_down": W.flag(W.lag("low", 3) > W.lag("high", 1)),
        "__shl": W.lag("high", idm_period),
        "__sll": W.lag("low", idm_period),
    })
    df = df.withColumns({"is_fvg_bearish": W.flag((F.col("is_fvg_bullish") == 0) & (F.col("__gap_down") == 1))})
    ph, pl = F.col("is_pivot_high") == 1, F.col("is_pivot_low") == 1
    # The level counts once it has been seen by a bar from choch_period on, and then stays.
    near_h, near_l = (W.last_event(p, x, choch_period - 1) for p, x in ((ph, h), (pl, l)))
    df = df.withColumns({
        "is_fvg": F.greatest("is_fvg_bullish", "is_fvg_bearish"),
        "__prev_h": W.last_event(ph, h), "__prev_l": W.last_event(pl, l),
        "__near_h": F.when(F.col("bar_seq") >= choch_period, near_h), "__near_l": F.when(F.col("bar_seq") >= choch_period, near_l),
        "__levels_h": F.collect_list(F.when(ph, h)).over(seq.rowsBetween(-(3 * swing_length - 1), -1)),
        "__levels_l": F.collect_list(F.when(pl, l)).over(seq.rowsBetween(-(3 * swing_length - 1), -1)),
        "__idm_h": W.last_event(F.col("__sh") == 1, F.col("__shl"), 2 * swing_length - idm_period, inclusive=True),
        "__idm_l": W.last_event(F.col("__sl") == 1, F.col("__sll"), 2 * swing_length - idm_period, inclusive=True),
    })
    df = df.withColumns({
        "is_hh": W.flag(ph & (h > F.col("__prev_h"))), "is_lh": W.flag(ph & (h <= F.col("__prev_h"))),
        "is_hl": W.flag(pl & (l > F.col("__prev_l"))), "is_ll": W.flag(pl & (l <= F.col("__prev_l"))),
        "__high": W.forward_fill("__near_h"), "__low": W.forward_fill("__near_l"),
        "is_sweep_bearish": W.flag(F.exists("__levels_h", lambda v: (h > v) & (c < v))),
        "is_sweep_bullish": W.flag(F.exists("__levels_l", lambda v: (l < v) & (c > v))),
    })
    live = F.col("bar_seq") >= choch_period
    df = df.withColumns({"is_sweep": F.greatest("is_sweep_bearish", "is_sweep_bullish"), "__up": W.flag(live & (c > F.col("__high"))), "__dn": W.flag(live & (c < F.col("__low")))})
    up, dn = F.col("__up") == 1, F.col("__dn") == 1
    df = df.withColumns({"__turns": F.sum(W.flag(up & dn)).over(W.running())})
    one = (up & ~dn) | (dn & ~up)
    df = df.withColumns({"__set": F.last(F.when(one, F.struct(F.col("__up").alias("v"), F.col("__turns").alias("t"))), ignorenulls=True).over(W.running())})
    # Before any setting the state is down.
    turned = (F.col("__turns") - F.coalesce(F.col("__set.t"), F.lit(0))) % 2
    df = df.withColumns({"market_structure": ((F.coalesce(F.col("__set.v"), F.lit(0)) + turned) % 2).cast("int")})
    df = df.withColumns({"__was": F.coalesce(W.lag("market_structure"), F.lit(0))})
    bull = F.col("market_structure") == 1
    df = df.withColumns({
        "is_choch_bullish": W.flag((F.col("__was") == 0) & bull), "is_choch_bearish": W.flag((F.col("__was") == 1) & ~bull),
        "is_bos_bullish": W.flag(live & bull & (c > F.col("__high") * 1.001)), "is_bos_bearish": W.flag(live & ~bull & (c < F.col("__low") * 0.999)),
        "is_idm_bearish": W.flag(bull & (l < F.col("__idm_l")) & (c > F.col("__idm_l"))), "is_idm_bullish": W.flag(~bull & (h > F.col("__idm_h")) & (c < F.col("__idm_h"))),
    })
    df = df.withColumns({k: F.greatest(f"{k}_bullish", f"{k}_bearish") for k in ("is_choch", "is_bos", "is_idm")})
    broke = (F.col("is_choch") == 1) | (F.col("is_bos") == 1)
    rising = (F.col("is_choch_bullish") == 1) | (F.col("is_bos_bullish") == 1)
    ahead = seq.rowsBetween(1, 2 * swing_length)

    def first(cond):
        return F.first(F.when(cond, F.col("bar_seq")), ignorenulls=True).over(ahead)

    df = df.withColumns({"__b_up": first(broke & rising), "__b_dn": first(broke & ~rising), "__red": first(c < o), "__green": first(c > o)})
    df = df.withColumns({
        "is_ob_bullish": W.flag((c < o) & F.col("__b_up").isNotNull() & (F.col("__red").isNull() | (F.col("__b_up") <= F.col("__red")))),
        "is_ob_bearish": W.flag((c > o) & F.col("__b_dn").isNotNull() & (F.col("__green").isNull() | (F.col("__b_dn") <= F.col("__green")))),
        "is_bullish_candle": W.flag(c > o), "is_bearish_candle": W.flag(c < o), "is_doji": W.flag(F.abs(c - o) < (h - l) * 0.1),
        "range_pct": F.try_divide(h - l, c) * 100, "body_pct": F.try_divide(F.abs(c - o), c) * 100,
        "volume_sma_20": W.rmean("volume", 20), **{f"sma_{n}": W.rmean("close", n) for n in (8, 21, 50)},
        **{f"{k}_{v}": F.sum(x).over(W.frame(n)).cast("int") for k, x in EVENTS.items() for n, v in BACK.items()},
    })
    df = df.withColumns({
        "is_ob": F.greatest("is_ob_bullish", "is_ob_bearish"), "is_high_volume": W.flag(F.col("volume") > F.col("volume_sma_20") * 1.5),
        **{f"above_sma_{n}": W.flag(c > F.col(f"sma_{n}")) for n in (8, 21, 50)},
        "trend_strength": 2 * F.col("is_hh") + F.col("is_hl") - 2 * F.col("is_lh") - F.col("is_ll"),
        **{f"any_{k}_{v}": W.flag(F.col(f"{k}_{v}") > 0) for k in EVENTS for v in BACK.values()},
    })
    return df.withColumns({f"smc_activity_score_{n}": sum((F.col(f"any_{k}_last_{n}") for k in ("pivot_high", "pivot_low", "choch", "bos")), F.lit(0)) for n in (5, 10)}).select([x for x in df.columns if not x.startswith("__")] + ["smc_activity_score_5", "smc_activity_score_10"])


def feature_summary(features: DataFrame, flags: list[str]) -> DataFrame:
    """How often each flag is set: feature, n, percent. One pass over the table."""
    sums = features.agg(F.count("*").alias("__n"), *[F.coalesce(F.sum(F.col(f) == 1 if t == "boolean" else F.col(f)), F.lit(0)).cast("long").alias(f) if t != "boolean" else F.count_if(f).alias(f) for f, t in features.select(*flags).dtypes])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("n")) for f in flags]))
    return sums.select("__n", rows.alias("x")).select("x.feature", "x.n", F.coalesce(F.try_divide(F.col("x.n") * 100.0, F.col("__n")), F.lit(0.0)).alias("percent"))


def feature_groups(names: list[str]) -> dict[str, list[str]]:
    """Names by what their spelling says they are about."""
    rules = {"Pivots": ("pivot",), "Structure": ("choch", "bos", "market_structure", "_hh", "_ll", "_hl", "_lh"), "Zones": ("fvg", "_ob", "idm", "sweep"), "Volume": ("volume",), "Trend": ("sma", "ema", "trend"), "Candles": ("candle", "doji", "body", "range")}
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(next((g for g, keys in rules.items() if any(k in n for k in keys)), "Other"), []).append(n)
    return out
