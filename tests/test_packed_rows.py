"""Equal rows are kept as one and count as often; a tree takes no more jobs than it is deep."""

import numpy as np
from test_boosting import as_nested, plain, same, table

from tickloom.operators import boosting as B


def test_equal_rows_are_one_and_a_tree_has_few_jobs(spark, monkeypatch):
    rows = table(spark, 600).selectExpr(*[f"round({c} * 0.7) AS {c}" for c in "abcd"], "label", "train")
    s, calls, packs = B.Settings(rounds=4, least=5), [], []
    histograms, packed = B._histograms, B.packed
    monkeypatch.setattr(B, "_histograms", lambda *a: calls.append(a[5]) or histograms(*a))
    monkeypatch.setattr(B, "packed", lambda *a: packs.append(packed(*a)) or packs[-1])
    monkeypatch.setattr(B, "ROWS", 150)
    model = B.train(rows, list("abcd"), s)
    assert max(map(calls.count, range(4))) <= s.depth
    held = packs[0].collect()
    assert len(held) < 450
    numbers = np.concatenate([np.frombuffer(bytes(r["numbers"]), np.int64) for r in held])
    data, fresh = B.prepared(rows, list("abcd"))
    got = data.orderBy("number").collect()
    assert sorted(numbers) == [r["number"] for r in got]
    bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in got), np.uint8).reshape(-1, 4)
    y, train, number = (np.array([r[c] for r in got]) for c in ("y", "train", "number"))
    want, losses = plain(bins, y, train, number, fresh.base, 4, s, len(model.trees))
    assert all(same(a, as_nested(t)) for a, t in zip(want, model.trees, strict=True))
    np.testing.assert_allclose(model.losses, losses, rtol=1e-9)


def test_quantiles_are_exact_without_nulls(spark):
    x = np.random.default_rng(3).integers(0, 90, 1000) / 4
    df = spark.createDataFrame([(float(v), None, float(v) if v > 5 else None) for v in x], "a double, b double, c double").repartition(5)
    for (edges, middle), v in zip(B.quantiles(df, ["a", "b", "c"], 10), (np.sort(x), np.array([0.0]), np.sort(x[x > 5])), strict=True):
        at = lambda k, m, v=v: float(v[-(-k * len(v) // m) - 1])
        assert edges == sorted({at(k, 10) for k in range(1, 10)})
        assert middle == at(1, 2)
