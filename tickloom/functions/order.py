"""Order statistics: exact quantiles of groups without gathering a group, and ranks and quantiles of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import windows as W

#: Rank error of the bracket, as a share of a group; so much of it is gathered.
CLOSE = 2e-4


def exact_quantile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """keys (none: one group), the p-quantile of the values that aren't null, interpolated between neighbours.

    An approximate quantile's rank is off by a known share at most, so two of them
    bracket the place. Values below are counted, only those inside are gathered (some
    4 / 10,000 of a group), with the nearest one on either side.
    """
    rows = df.where(F.col(value).isNotNull())
    bracket = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx(value, [max(0.0, p - CLOSE), min(1.0, p + CLOSE)], round(2 / CLOSE)).alias("__q"))
    x, lo, hi = F.col(value), F.col("__q")[0], F.col("__q")[1]
    # One bracket for all is broadcast: as a product of partitions it would take a task for each pair of them.
    got = (rows.join(bracket, keys) if keys else rows.crossJoin(F.broadcast(bracket))).groupBy(*keys).agg(
        F.first("__n").alias("__n"), F.count(F.when(x < lo, 1)).alias("__below"), F.max(F.when(x < lo, x)).alias("__left"),
        F.sort_array(F.collect_list(F.when((x >= lo) & (x <= hi), x))).alias("__in"), F.min(F.when(x > hi, x)).alias("__right"),
    )
    rank = F.lit(p) * (F.col("__n") - 1)
    k = F.floor(rank)

    def at(i):
        place = i - F.col("__below")
        return F.when(place < 0, F.col("__left")).when(place >= F.size("__in"), F.col("__right")).otherwise(F.get("__in", F.greatest(place, F.lit(0)).cast("int")))

    low = at(k)
    return got.select(*keys, (low + (rank - k) * (F.coalesce(at(k + 1), low) - low)).alias(name))


def rolling_order(bars: DataFrame, source: str, wanted: dict[str, tuple], block: int = 1_000_000) -> DataFrame:
    """Bars with rolling ranks and quantiles: name -> ("rank", n) or ("quantile", n, p).

    Blocks of bars, each with the bars before it that its frames need; within a block a
    sorted skip list slides along, so a bar costs log n and no frame is copied. Null until
    a frame holds n values; a null has no rank.
    """
    schema = T.StructType([*bars.schema, *[T.StructField(c, T.DoubleType()) for c in wanted]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable").reset_index(drop=True)
        x = pd.Series(pdf[source].to_numpy(dtype=float, na_value=np.nan))
        for name, (kind, n, *p) in wanted.items():
            frames = x.rolling(n)
            pdf[name] = frames.rank(pct=True).where(x.notna()) if kind == "rank" else frames.quantile(p[0])
        return pdf[schema.names]

    back = max(n for _, n, *_ in wanted.values())
    return W.in_blocks(bars, lambda df: df.groupBy(*W.KEYS).applyInPandas(run, schema), back, block=block)
