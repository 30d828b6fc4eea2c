"""Exponential averages of series too long for one task, by a scan over blocks.

An average is an affine map of the state before a block. Each block gives its map
(one row), a series' maps are composed in order (as many rows as blocks), and
each block runs once more from the state that it begins with. Three short
shuffles instead of one task that holds the series. Gaps count as in the plain
kernel: the weight of the past at a block's end goes along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["symbol", "tf"]
BLOCK = 100_000


def run_from(x: np.ndarray, alpha: float, y: float, keep: float) -> tuple[np.ndarray, float]:
    """The kernel from a state (value or NaN, weight of the past): values, weight at the end."""
    out = np.empty(len(x))
    for i, v in enumerate(x):
        if np.isnan(v):
            keep *= 1 - alpha
        elif np.isnan(y):
            y, keep = v, 1.0
        else:
            old = keep * (1 - alpha)
            y, keep = (old * y + alpha * v) / (old + alpha), 1.0
        out[i] = y
    return out, keep


def block_map(x: np.ndarray, alpha: float) -> tuple[int, float, float, float, int]:
    """What a block does to any state: nulls before its first value, that value, the affine map of the rest (times,
    plus), nulls behind its last value. The first value is NaN if there is none."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return len(x), np.nan, 1.0, 0.0, 0
    times, plus = 1.0, 0.0
    for gap, v in zip(np.diff(at) - 1, x[at[1:]], strict=True):
        old = (1 - alpha) ** (gap + 1)
        times, plus = times * old / (old + alpha), (plus * old + alpha * v) / (old + alpha)
    return int(at[0]), float(x[at[0]]), times, plus, int(len(x) - 1 - at[-1])


def ewma_blocks(bars: DataFrame, source: str, alpha: float, name: str, block: int = BLOCK) -> DataFrame:
    """Bars with the average; the same numbers as the grouped map's, to rounding."""
    rows = bars.withColumn("__block", F.floor(F.col("bar_seq") / block).cast("long"))
    maps = "symbol string, tf string, __block long, lead long, head double, times double, plus double, trail long"

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable")
        lead, head, times, plus, trail = block_map(pdf[source].to_numpy(float, na_value=np.nan), alpha)
        k = pdf.iloc[0]
        return pd.DataFrame([(k["symbol"], k["tf"], k["__block"], lead, head, times, plus, trail)], columns=[c.split()[0] for c in maps.split(", ")])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block", kind="stable")
        y, keep, out = np.nan, 1.0, []
        for r in pdf.itertuples(index=False):
            out.append((r.symbol, r.tf, r[2], y, keep))
            if np.isnan(r.head):
                keep *= (1 - alpha) ** r.lead
                continue
            if np.isnan(y):
                first = r.head
            else:
                old = keep * (1 - alpha) ** (r.lead + 1)
                first = (old * y + alpha * r.head) / (old + alpha)
            y, keep = r.times * first + r.plus, (1 - alpha) ** r.trail
        return pd.DataFrame(out, columns=["symbol", "tf", "__block", "__y", "__keep"])

    states = rows.select(*KEYS, "__block", "bar_seq", source).groupBy(*KEYS, "__block").applyInPandas(summarise, maps).groupBy(*KEYS).applyInPandas(compose, "symbol string, tf string, __block long, __y double, __keep double")
    schema = T.StructType([*bars.schema, T.StructField(name, T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_seq", kind="stable").reset_index(drop=True)
        y, keep = pdf["__y"].iloc[0], pdf["__keep"].iloc[0]
        out, _ = run_from(pdf[source].to_numpy(float, na_value=np.nan), alpha, np.nan if y is None else float(y), float(keep))
        return pdf.assign(**{name: out})[schema.names]

    return rows.join(states, [*KEYS, "__block"]).groupBy(*KEYS, "__block").applyInPandas(finish, schema)
