"""Boosted trees against a plain program that grows one leaf at a time on all rows, and stored models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting as B
from tickloom.operators import tradefilter
from tickloom.plans.queries import event_trades, hourly


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * (x[:, 2] > 0))))
    y = (rng.random(n) < p).astype(int)
    rows = [(*map(float, r), int(k), i < n * 0.8) for i, (r, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, label int, train boolean").coalesce(1)


def plain(bins, y, train, number, base, d, s, rounds):
    """Trees as nested tuples (column, bin, left, right) or leaf values; one leaf split at a time, sums made anew."""
    raw = np.full(len(y), base)
    least = s.least if s.least is not None else max(20, int(train.sum()) // 50)
    trees, losses = [], []
    for k in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        use = train & B.bagged(number, k, s)
        allowed = B.columns_of(d, k, s)

        def sums(rows):
            return g[rows].sum(), h[rows].sum()

        def split(rows):
            best = (0.0, -1, 0)
            total = B.shrunk(sums(rows)[0], s.l1) ** 2 / (sums(rows)[1] + s.l2)
            for j in np.flatnonzero(allowed):
                for b in range(B.BINS):
                    left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                    if min(len(left), len(right)) < least or min(sums(left)[1], sums(right)[1]) < s.least_hessian:
                        continue
                    gain = sum(B.shrunk(sums(x)[0], s.l1) ** 2 / (sums(x)[1] + s.l2) for x in (left, right)) - total
                    if gain > best[0] + 1e-9 * max(1.0, abs(gain)):
                        best = (gain, int(j), b)
            return best

        root = np.flatnonzero(use)
        leaves = [(root, 0, split(root), [])]
        chosen = {}
        while len(leaves) < s.leaves:
            able = [x for x in leaves if x[2][0] > 1e-9 and x[1] < s.depth]
            if not able:
                break
            rows, depth, (_, j, b), path = max(able, key=lambda x: x[2][0])
            chosen[tuple(path)] = (j, b)
            leaves = [x for x in leaves if x[3] != path]
            for side, part in ((0, rows[bins[rows, j] <= b]), (1, rows[bins[rows, j] > b])):
                leaves.append((part, depth + 1, split(part), [*path, side]))
        values = {tuple(path): -s.rate * B.shrunk(sums(rows)[0], s.l1) / (sums(rows)[1] + s.l2) for rows, _, _, path in leaves}

        def nested(path=()):
            return (*chosen[path], nested((*path, 0)), nested((*path, 1))) if path in chosen else values[path]

        tree = nested()
        trees.append(tree)
        for i in range(len(y)):
            t = tree
            while isinstance(t, tuple):
                t = t[2] if bins[i, t[0]] <= t[1] else t[3]
            raw[i] += t
        out = ~train
        losses.append(float(np.logaddexp(0, np.where(y[out] == 1, -raw[out], raw[out])).mean()))
    return trees, losses


def as_nested(t, n=0):
    return (t.column[n], t.bin[n], as_nested(t, t.left[n]), as_nested(t, t.right[n])) if t.column[n] >= 0 else t.value[n]


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("settings", [B.Settings(rounds=4, least=15), B.Settings(rounds=3, leaves=4, depth=2, columns=1.0, bag=1.0, l1=0.5, l2=2.0), B.Settings(rounds=30, leaves=3, rate=0.3)])
def test_same_trees_as_the_plain_program(spark, settings):
    rows = table(spark, 300 if settings.rounds == 30 else 600)
    model = B.train(rows, list("abcd"), settings)
    data, fresh = B.prepared(rows, list("abcd"))
    got = data.orderBy("number").collect()
    bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in got), np.uint8).reshape(-1, 4)
    y, train, number = (np.array([r[c] for r in got]) for c in ("y", "train", "number"))
    want, losses = plain(bins, y, train, number, fresh.base, 4, settings, len(model.trees))
    assert len(want) == len(model.trees) > 1
    for a, t in zip(want, model.trees, strict=True):
        assert same(a, as_nested(t)), (a, as_nested(t))
    np.testing.assert_allclose(model.losses, losses, rtol=1e-9)


def test_partitions_make_no_difference(spark):
    rows = table(spark, 400)
    data, model = B.prepared(rows, list("abcd"))
    one = B.Tree()
    one.add()
    a = B._histograms(data.coalesce(1), model, 0, one, [0], 0, B.Settings())
    b = B._histograms(data.repartition(5), model, 0, one, [0], 0, B.Settings())
    np.testing.assert_allclose(a[0][0], b[0][0], rtol=1e-12, atol=1e-12)
    assert math.isclose(a[1], b[1])
    assert a[2] == b[2] == 80


def test_it_learns_and_stops(spark):
    rows = table(spark, 1000)
    model = B.train(rows, list("abcd"), B.Settings(rounds=80, rate=0.2, patience=5))
    assert len(model.trees) == int(np.argmin(model.losses)) + 1 < 80
    assert all(sum(c < 0 for c in t.column) <= 15 for t in model.trees)
    assert model.importances()[0][0] == "a"
    assert math.isclose(sum(v for _, v in model.importances()), 1.0)
    got = tradefilter.evaluate(B.scored(model, rows)).collect()
    assert all(r["auc"] > 0.8 for r in got)
    assert B.train(rows.limit(20), list("abcd")) is None
    assert B.train(rows.withColumn("label", F.lit(0)), list("abcd")) is None


def test_a_stored_model_scores_as_before(spark, tmp_path):
    rows = table(spark, 300).withColumn("a", F.when(F.col("b") > 0.5, None).otherwise(F.col("a")))
    model = B.train(rows, list("abcd"), B.Settings(rounds=5))
    path = str(tmp_path / "model")
    B.save(model, spark, path)
    again = B.load(spark, path)
    assert again == model
    key = lambda df: sorted((r["b"], r["c"], r["d"], r["score"]) for r in df.collect())
    assert key(B.scored(again, rows)) == key(B.scored(model, rows))
    with pytest.raises(ValueError, match=r"missing columns: \['d'\]"):
        B.scored(again, rows.drop("d"))
    filled = B.scored(again, rows.drop("d"), fill_missing=True).withColumn("d", F.lit(0.0))
    median = B.scored(again, rows.withColumn("d", F.lit(again.medians[3]))).withColumn("d", F.lit(0.0))
    assert key(filled) == key(median)
    with pytest.raises(ValueError, match="version 99"):
        B.Model.loads(model.dumps().replace('"version": 1', '"version": 99'))


def test_the_older_filter_takes_a_stored_model(spark, data, tmp_path):
    trades, bars = event_trades(spark, data), hourly(spark, data)
    rows = tradefilter.trade_context(trades, bars).withColumn("label", (F.col("pnl") > 0).cast("int")).withColumn("train", F.col("trade_id") % 5 != 0)
    model = B.train(rows, [*tradefilter.CONTEXT, "side_long"], B.Settings(rounds=3))
    path = str(tmp_path / "m")
    plain_ = tradefilter.stored_scores(spark, path, trades, bars)  # nothing stored yet
    assert {r["mode"] for r in plain_.collect()} == {"heuristic"}
    B.save(model, spark, path)
    got = tradefilter.stored_scores(spark, path, trades, bars)
    key = lambda df: sorted((r["symbol"], r["trade_id"], round(r["score"], 12)) for r in df.collect())
    assert key(got) == key(B.scored(model, rows))
    assert {r["mode"] for r in got.collect()} == {"model"}
    other = B.train(rows.withColumn("odd", F.lit(1.0)), ["odd", "rsi_14"], B.Settings(rounds=1))
    B.save(other, spark, path)
    assert {r["mode"] for r in tradefilter.stored_scores(spark, path, trades, bars).collect()} == {"heuristic"}
    assert {r["mode"] for r in tradefilter.stored_scores(spark, path, trades, bars, fill_missing=True).collect()} == {"model"}


def test_importances_without_a_model():
    got = tradefilter.importances(None, [f"f{i}" for i in range(30)])
    assert len(got) == 20
    assert {v for _, v in got} == {1 / 30}
