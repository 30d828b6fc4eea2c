"""As-of lookups in blocks against the plain ones and against a search."""

import re
from bisect import bisect_right
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.asof import asof, block_bounds, block_of

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(2)
    right, left = [], []
    for key, n in (("hot", 900), ("cold", 20), ("late", 5)):
        for t in sorted(rng.integers(0, 4000, n)):
            right.append((key, START + timedelta(seconds=int(t) + 3000 * (key == "late")), float(rng.integers(0, 50))))
    for key in ("hot", "cold", "late", "none"):
        left += [(i, key, START + timedelta(seconds=int(t)), "x" if i % 2 else None) for i, t in enumerate(rng.integers(-100, 8000, 300))]
    left += [(999, "hot", None, "y"), (998, None, START, "y")]
    right.append(("cold", None, 7.0))
    return spark.createDataFrame(left, "i int, k string, at timestamp_ntz, note string"), spark.createDataFrame(right, "k string, ts timestamp_ntz, price double")


def test_any_block_size_gives_the_same(sides):
    left, right = sides
    groups = {}
    for r in right.collect():
        if r["ts"] is not None:
            groups.setdefault(r["k"], []).append((r["ts"], r["price"]))
    want = set()
    for r in left.collect():
        g = sorted(groups.get(r["k"], []))
        at = bisect_right(g, (r["at"], float("inf"))) if r["at"] is not None else 0
        want.add((r["i"], r["k"], r["at"], r["note"], g[at - 1][1] if at else None))
    for rows in (None, 10**6, 300, 50, 7):
        got = asof(left, right, "at", "ts", ["k"], ["price"], rows)
        assert got.count() == left.count()
        assert {tuple(r) for r in got.collect()} == want, rows


def test_blocks_are_even_whatever_the_key(sides):
    left, right = sides
    times = left.select(F.unix_micros(F.col("at").cast("timestamp")).alias("t")).unionByName(right.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")))
    bounds = block_bounds(times, 100)
    sizes = [r["count"] for r in times.dropna().groupBy(block_of(F.col("t"), bounds).alias("b")).count().collect()]
    assert len(sizes) > 15
    assert max(sizes) < 250
    flat = sorted(r["t"] for r in times.dropna().collect())
    assert {r["t"]: r["b"] for r in times.dropna().select("t", block_of(F.col("t"), bounds).alias("b")).collect()} == {t: bisect_right(bounds, t) for t in flat}


def test_no_window_holds_a_whole_series(sides):
    left, right = sides
    plan = asof(left, right, "at", "ts", ["k"], ["price"], 100)._jdf.queryExecution().optimizedPlan().toString()
    specs = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"windowspecdefinition\((.*?) ASC", plan)]
    # Over blocks, a row each; and over the rows of one block.
    assert set(specs) == {"k, __block", "k, __block, __us"}
