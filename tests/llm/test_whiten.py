"""Whitening against numpy's own eigenvectors and plain sums, and each case that the docstring defines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """vec_id, component -> n, deviation, |whitened| sign free, explained; in order of the rows."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in r[1]] for r in kept], object)
    distinct = sorted(set(map(tuple, x.tolist())))
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array(distinct, float) - np.array([t / n for t in s])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    y = (x.astype(float) - np.array([t / n for t in s])) @ vectors[:, :4] / np.sqrt(values[:4])
    dev = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x.tolist()]
    return kept, n, dev, y, values[:4] / np.trace(v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    out = [(k, (rng.normal(size=12) * np.linspace(2, 0.1, 12) + 0.7).tolist(), 0) for k in range(400)]
    out += [(k + 1000, out[3][1], 1) for k in range(200)]  # copies count once
    return out + [(1, None, 0), (2, [float("nan")] * 12, 0), (3, [None] * 12, 0), (4, [1.0, 2.0], 0), (5, [], 0), (None, [0.5] * 12, None)]


def test_against_plain_eigenvectors(spark, rows):
    kept, n, dev, y, share = plain([r for r in rows if r[1] is None or len(r[1]) == 12])
    got = {}
    for r in whiten.op13(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert sum(map(len, got.values())) == 4 * len(kept)
    w = np.zeros_like(y)
    seen = {}
    for i, r in enumerate(kept):
        for k in range(4):
            at = (r[0], k + 1)
            x = got[at][seen.setdefault(at, 0)]
            seen[at] += 1
            assert (x["n"], x["deviation"]) == (n, dev[i])
            assert abs(x["explained"] / share[k] - 1) < 1e-9
            assert x["identity_error"] < 1e-9
            w[i, k] = x["whitened"]
    sign = np.sign((w * y).sum(0))
    assert np.abs(w - y * sign).max() < 1e-8


def test_identity_error_is_of_the_distinct_vectors(spark, rows):
    made = whiten.op13(spark.createDataFrame(rows, SCHEMA)).collect()
    one = {}
    for r in made:
        one.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    distinct = np.array(sorted({tuple(v[k] for k in (1, 2, 3, 4)) for v in one.values()}))
    assert len(distinct) == made[0]["n"]
    c = (distinct - distinct.mean(0)).T @ (distinct - distinct.mean(0)) / len(distinct)
    assert np.abs(c - np.eye(4)).max() < 1e-9


def _spectra():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = rng.normal(size=(500, 20))
    return [a.T @ a, q @ np.diag([3.0] * 15 + [1.0] * 10 + [0.0] * 5) @ q.T, np.eye(4), np.zeros((3, 3)), np.diag([1e8, 1.0, 1e-8]), np.outer(np.ones(6), np.ones(6)), np.array([[2.0]]), np.array([[0.0, 1.0], [1.0, 0.0]])]


@pytest.mark.parametrize("v", _spectra())
def test_division_gives_eigenvectors(v):
    e, w = whiten.components(v)
    size = max(np.abs(e).max(), 1.0)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-12 * size
    assert np.abs(w.T @ w - np.eye(len(v))).max() < 1e-12
    assert np.abs(v @ w - w * e).max() < 1e-12 * size


def test_polar_factor():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(25, 25))
    a = a + a.T
    u = whiten.polar(a)
    e, q = np.linalg.eigh(a)
    assert np.abs(u - (q * np.sign(e)) @ q.T).max() < 1e-10


def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert whiten.op13(df.where("false")).count() == 0
    assert whiten.op13(df.where("embedding IS NULL")).count() == 0
    one = whiten.op13(df.where("vec_id = 1000 OR vec_id = 1001")).collect()
    assert len(one) == 8
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, 0.0, None)}
    thin = whiten.op13(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)], SCHEMA)).collect()
    assert {(r["vec_id"], r["component"]): r["whitened"] for r in thin} == {(1, 1): -1.0, (1, 2): None, (2, 1): 1.0, (2, 2): None}
    clash = df.withColumns({c: F.lit(f"own {c}") for c in ("x", "n", "d", "component", "whitened", "line", "v", "j", "total")})
    assert whiten.op13(clash).count() == whiten.op13(df).count()
    huge = whiten.op13(spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0)], SCHEMA)).collect()
    assert {r["deviation"] for r in huge} == {None}
