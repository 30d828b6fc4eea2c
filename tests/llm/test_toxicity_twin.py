"""The toxicity fit and its scores against a plain program: counts in dicts, segments by their definition."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import toxicity as X
from tickloom.llm.common import small_batches


def plain_segments(scores):
    """The best segment, then those of what is left of and right of it; none where nothing is over 0. Of equal sums the
    shortest, earliest."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (top is None or total > top[0] + 1e-12 or abs(total - top[0]) <= 1e-12 and j - i < top[2] - top[1]):
                    top = (total, i, j)
        return [] if top is None else best(lo, top[1]) + [top] + best(top[2] + 1, hi)

    return best(0, len(scores))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(10)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [f"word{k}" for k in rng.integers(0, 60, int(rng.integers(5, 40)))]
        if toxic:
            for at in rng.integers(0, len(words), 3):
                words[at] = ["grumblex", "snarlox", "snarloxen", "zzfoul"][int(rng.integers(4))]
        elif i % 50 == 1:
            words[0] = "grumblex"
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(toxic)))
    docs += [(2000, None), (2001, "")]
    small_batches(spark)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def twin(spark, table):
    """weights, lambda, K, curve and a scoring function from the same rows."""
    docs, labels = table
    part = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(X.PARTS))
    rows = [r for r in docs.join(labels, "doc_id").withColumn("part", part).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    rows = list({r["text"]: r for r in rows}.values())
    words = lambda t: X._WORD.findall((t or "").lower())
    held = {1: {}, 0: {}}
    n = {1: 0, 0: 0}
    for r in rows:
        if r["part"]:
            n[r["toxic"]] += 1
            for f in {f for w in set(words(r["text"])) for f in [w + "$", *[w[:k] for k in (3, 4, 5, 6, 7) if k <= len(w)]]}:
                held[r["toxic"]][f] = held[r["toxic"]].get(f, 0) + 1
    weights = {}
    for f, t in held[1].items():
        c = held[0].get(f, 0)
        rate = (t + c) / (n[1] + n[0])
        a, b = t + rate * X.PRIOR * n[1], c + rate * X.PRIOR * n[0]
        odds = math.log(a / max(n[1] * (1 + X.PRIOR) - a, 0.5)) - math.log(b / max(n[0] * (1 + X.PRIOR) - b, 0.5))
        z = odds / math.sqrt(1 / a + 1 / b)
        far = (t - n[1] * rate) / math.sqrt(n[1] * rate * (1 - min(rate, 0.999)) * n[0] / (n[1] + n[0]))
        if t >= X.MIN_DOCS and min(odds, X.TOP_SCORE) > X.MIN_ODDS and max(z, far) > X.MIN_Z:
            weights[f] = (max(z, far), min(odds, X.TOP_SCORE))

    def scores(t):
        out = []
        for w in words(t):
            got = [weights[f] for f in X.features(w) if f in weights]
            out.append(max(got)[1] if got and max(got)[1] > 0 else -X.DRIFT)
        return out

    return {"rows": rows, "weights": weights, "scores": scores}


def test_weights(table, twin):
    docs, labels = table
    model = X.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert model.weights.keys() == twin["weights"].keys()
    assert len(model.weights) > 5
    for f, (z, o) in twin["weights"].items():
        assert math.isclose(model.weights[f][0], z, rel_tol=1e-9)
        assert math.isclose(model.weights[f][1], o, rel_tol=1e-9)


def test_law_curve_and_scores(spark, table, twin):
    docs, labels = table
    model = X.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    cal = [(r["toxic"], twin["scores"](r["text"])) for r in twin["rows"] if r["part"] == 0]
    clean = [s for t, s in cal if not t]
    flat = [x for s in clean for x in s]
    values = [round(10 * x) / 10 for x in flat if x > 0]
    # Lambda: the mean of exp(lambda x) over clean words, half a word of the top score among them, is 1.
    total = sum(math.exp(model.lam * v) for v in values) + 0.5 * math.exp(model.lam * X.TOP_SCORE) + (len(flat) - len(values) - 0.5) * math.exp(-model.lam * X.DRIFT)
    assert math.isclose(total / len(flat), 1.0, rel_tol=1e-6)
    best = [(len(s), max((x[0] for x in plain_segments(s)), default=0.0)) for s in clean]
    e = [n * math.exp(-model.lam * b) for n, b in best if b]
    k = min(1.0, max(1e-4, (len(e) / sum(n > 0 for n, _ in best)) / (sum(e) / len(e)))) if e else 0.1
    assert math.isclose(model.k, k, rel_tol=1e-9)

    def evidence(s):
        x = sorted((model.lam * v[0] - math.log(k * len(s)) for v in plain_segments(s)), reverse=True)
        out = []
        for r in range(1, len(x) + 1):
            v = sum(x[:r])
            if r > 1 and x[r - 1] <= 0:
                break
            out.append(math.log(-math.expm1(-math.exp(min(50.0, -v)))) if r == 1 else -v + (r - 1) * math.log(max(v, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2))
        return -min([0.0, *out]) / math.log(10)

    # The curve: no small step lowers the loss that it is the least of.
    ev, y = np.array([math.log1p(evidence(s)) for _, s in cal]), np.array([float(t) for t, _ in cal])
    all_ = [r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    shift = math.log(sum(all_) / (len(all_) - sum(all_))) - math.log(y.sum() / (len(y) - y.sum()))
    a, b = model.curve[0] - shift, model.curve[1]
    loss = lambda a, b: float((np.logaddexp(0, a + b * ev) - y * (a + b * ev)).sum()) + 0.005 * (a * a + b * b)
    assert all(loss(a, b) <= loss(a + d, b + g) + 1e-9 for d in (-1e-3, 0, 1e-3) for g in (-1e-3, 0, 1e-3))
    got = {r["doc_id"]: r for r in X.op10(docs, labels).collect()}
    for r in docs.collect():
        z = model.curve[0] + model.curve[1] * math.log1p(evidence(twin["scores"](r["text"])))
        assert math.isclose(got[r["doc_id"]]["score"], 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), rel_tol=1e-6), r
    right = [got[i]["predicted"] == t for i, t in ((r["doc_id"], r["toxic"]) for r in labels.collect()) if got[i]["held_out"]]
    assert np.mean(right) > 0.97


def test_ties_one_class_and_boolean_labels(spark, table):
    docs, labels = table
    flags = labels.withColumn("toxic", F.col("toxic") == 1)
    a, b = (sorted((r["doc_id"], r["score"]) for r in X.op10(docs, x).collect()) for x in (labels, flags))
    assert a == b
    one = X.op10(docs, labels.where("toxic = 0")).collect()
    assert {(r["score"], r["predicted"], r["n_passages"]) for r in one} == {(0.0, 0, 0)}
    # Equal scores in a row, and segments that touch: as the definition has them.
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.choice([-0.5, -0.5, 1.0, 2.0], 12)
        found = X.segments([(i, float(x)) for i, x in enumerate(s) if x > 0], 0.5)
        assert math.isclose(sum(x[0] for x in found), sum(x[0] for x in plain_segments(list(s))))
