"""Near-duplicate embeddings against all pairs, and each case that the docstring defines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """vec_id -> sorted (n_links, component_id, kept) by comparing every pair."""
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    v = [np.array([np.float32(x) for x in r[1]], float) if o else None for r, o in zip(rows, ok, strict=True)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    count = [0] * len(rows)
    for i, a in enumerate(v):
        for j in range(i):
            b = v[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                count[i] += 1
                count[j] += 1
                root[top(i)] = top(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[top(i)] = min(names.get(top(i), r[0]), r[0])
    return sorted(str((r[0], count[i], names.get(top(i)), r[0] is not None and r[0] == names.get(top(i)))) for i, r in enumerate(rows))


def result(spark, rows, schema=SCHEMA):
    got = hnsw.op12(spark.createDataFrame(rows, schema)).select("vec_id", "n_links", "component_id", "kept").collect()
    return sorted(str(tuple(r)) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    out = []
    for label in range(3):
        base = rng.normal(size=(120, 16))
        for k in range(90):
            out.append((len(out), base[k].tolist(), label))
        for k in range(60):  # near copies, some just below the bound, some scaled
            near = base[k] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35, 0.4])
            out.append((len(out), (near * rng.choice([1.0, 7.5])).tolist(), label))
    for k in range(80):  # one hot group of near copies
        out.append((len(out), (np.ones(16) + rng.normal(size=16) * 0.1).tolist(), 1))
    chain = [np.cos(t) * np.eye(16)[0] + np.sin(t) * np.eye(16)[1] for t in np.arange(0, 3, 0.3)]
    out += [(len(out) + k, x.tolist(), 2) for k, x in enumerate(chain)]
    return out


def test_links_and_components(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_many_shards_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 300)
    monkeypatch.setattr(hnsw, "ENTRIES", 1)
    more = rows + [(r[0] + 10_000, r[1], 0) for r in rows]  # label 0: over 256 nodes, so several shards
    assert result(spark, more) == plain(more)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (5, one, 1), (3, one, 1), (3, one, 1), (9, [2.0, 4.0, 6.0], 1), (1, one, 2), (2, one, None), (4, None, 1), (6, [0.0, 0.0, 0.0], 1),
        (7, [1.0, float("nan"), 3.0], 1), (8, [float("inf"), 2.0, 3.0], 1), (10, [1.0, None, 3.0], 1), (11, [], 1), (None, one, 1), (None, [3.0, -1.0, 0.0], 3), (12, [1.0, 2.0], 1),
        (13, [-0.0, 1.0], 4), (14, [0.0, 1.0], 4), (15, [1e30, 2e30, 3e30], 1), (16, [1e-30, 2e-30, 3e-30], 1),
    ]
    assert result(spark, rows) == plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit(f"own {c}") for c in ("key", "v", "node", "low", "copies", "shard", "shards", "dim", "links", "other", "n", "name", "missing", "root")})
    assert sorted(str(tuple(r)) for r in hnsw.op12(clash).collect()) == plain(rows)
    assert hnsw.op12(df.where("false")).count() == 0
    assert hnsw.op12(df.where("label = 99 OR vec_id = 4")).collect()[0]["n_links"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1500])
def test_a_graph_finds_near_copies(n):
    rng = np.random.default_rng(n)
    x = hnsw.units(np.concatenate([v := rng.normal(size=(n, 32)), v + rng.normal(size=v.shape) * 0.1]))
    layer = hnsw.layer_of(np.arange(len(x)))
    order = np.argsort(-layer, kind="stable")
    s = hnsw.Shard(np.arange(len(x))[order], np.ones(len(x), np.int64), x[order], hnsw.Graph.build(x[order].astype(np.float32), layer[order]))
    want = (s.exact @ s.exact.T >= 0.93).sum() - len(x)
    got = hnsw.linked(s, s, True).to_pandas()["links"].sum()
    assert got >= 0.99 * want
    assert got <= want


def test_links_of_a_graph_are_sound():
    rng = np.random.default_rng(0)
    x = hnsw.units(rng.normal(size=(800, 8))).astype(np.float32)
    layer = np.sort(hnsw.layer_of(np.arange(800)))[::-1]
    g = hnsw.Graph.build(x, layer)
    for k, links in enumerate(g.layers):
        assert len(links) == (layer >= k).sum()
        for i, r in enumerate(links):
            r = r[r >= 0]
            assert len(set(r.tolist())) == len(r)
            assert i not in r
            assert (r < len(links)).all()
    ids, like = hnsw.search(x, g.layers[0], x[:50], np.zeros((50, 1), np.int64), 64)
    best = np.argsort(-(x[:50] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist(), strict=True)]) > 0.95
    assert (np.diff(like, axis=1) <= 0).all()
