"""Toxic passages as maximum-scoring segments of token log-odds.

Fit. Labelled documents give, for each word and each word beginning of 3 to 7
letters, the number of toxic and of clean documents that hold it. Its score is
the log-odds ratio under an informative Dirichlet prior (the pooled counts),
kept where the z-score (or, for what is rare on both sides, the distance of its
count from the pooled rate) is clear and the odds are over MIN_ODDS; a word's score
is that of its clearest feature.
All other words score ``-DRIFT``.

Search. Ruzzo and Tompa's linear scan finds every maximal scoring segment of a
text. Under the clean documents' score distribution, Karlin and Altschul's
extreme-value law says how likely a text of n words has a segment scoring S or
more: 1 - exp(-K n exp(-lambda S)). Segments under P_MAX are passages; a text's
segments are combined by the law for sums of normalised scores, and a logistic
curve, fitted on labelled documents kept out of the counts, maps that to 0..1.

Bound of the fit: MAX_ROWS labelled documents of each class (a seeded sample
where there are more). Scoring reads whole texts and sums over all segments.

Defined results: null and empty texts have no words and get the curve's score
for no passage; without labels of both classes all scores are 0. Several labels
of one doc_id count as their maximum; a null label is none; labels and documents
without an id teach nothing. Repeated rows and other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, text_key

MAX_ROWS = 12_000
PREFIXES = (3, 4, 5, 6, 7)
#: The prior's weight, as a share of the labelled documents.
PRIOR = 0.03
MIN_Z = 5.0
#: A feature is held by so many toxic documents at least.
MIN_DOCS = 4
#: The least odds of a feature.
MIN_ODDS = 2.5
#: Parts of the sample; part 0 calibrates, the others teach.
PARTS = 4
TOP_SCORE = 8.0
DRIFT = 0.5
P_MAX = 0.05
#: Words whose scores a worker remembers.
MEMO = 200_000
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("p", T.DoubleType())])))])

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if n <= len(word))]


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) of a text whose tokens at these places have these
    positive scores and all others -drift. Linear in the number of places."""
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest with a lower sum before
    total, done = 0.0, 0
    for at, s in scores:
        total -= drift * (at - done)
        left, first = total, at
        total += s
        done = at + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= total:
                held.append((left, total, first, at, j))
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
    return [(b - a, i, k) for a, b, i, k, _ in held]


class Model:
    """Feature scores, the extreme-value law and the curve. Small; goes to the workers with the task."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        self.weights = weights
        self.lam, self.k, self.curve = 1.0, 0.1, (0.0, 0.0)
        self.memo: dict[str, float] = {}

    def fresh(self, w: str) -> float:
        return max((x for f in features(w) if (x := self.weights.get(f))), default=(0.0, 0.0))[1]

    def word(self, w: str) -> float:
        s = self.memo.get(w)
        if s is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            s = self.memo[w] = self.fresh(w)
        return s

    def places(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """Where a text's scoring words are, with their scores, and how many words it has."""
        word = self.word
        words = _WORD.findall((text or "").lower())
        return [(i, s) for i, w in enumerate(words) if (s := word(w)) > 0], len(words)

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> float:
        """-log10 of the chance that clean words give such segments: the best r of them together, r chosen."""
        if not found or not n:
            return 0.0
        x = sorted((self.lam * s - math.log(self.k * n) for s, _, _ in found), reverse=True)
        best, total = 0.0, 0.0
        for r, v in enumerate(x, 1):
            total += v
            if v <= 0 and r > 1:
                break
            if r == 1:
                ln = math.log(max(-math.expm1(-math.exp(min(50.0, -v))), 1e-300)) if v < 600 else -v
            else:
                ln = -total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
            best = min(best, ln)
        return -best / math.log(10)

    def score(self, evidence: float) -> float:
        a, b = self.curve
        z = a + b * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _karlin(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with sum of weights * exp(lambda * values) = 1."""
    f = lambda lam: float((weights * np.exp(lam * values)).sum()) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two parameters by Newton's method, with a weak pull to 0."""
    w = np.zeros(2)
    m = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -40, 40)))
        g = m.T @ (p - y) + 1e-2 * w
        h = (m * (p * (1 - p) + 1e-9)[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), max(float(w[1]), 1e-3)


def _learn(counts: DataFrame) -> list[tuple[str, float, float]] | None:
    """(feature, t, c: toxic and clean documents that hold it) -> (feature, z, odds) of those that tell, clearest first;
    None without documents of both classes."""
    total = counts.where(F.col("feature") == "").first()
    if not total or not total["t"] or not total["c"]:
        return None
    nt, nc = float(total["t"]), float(total["c"])
    # Log-odds with the pooled rate as the prior; z by the variance of the two counts.
    rate = (F.col("t") + F.col("c")) / (nt + nc)
    a_t, a_c = (F.col(k) + rate * PRIOR * m for k, m in (("t", nt), ("c", nc)))
    odds = F.log(a_t / F.greatest(F.lit(nt * (1 + PRIOR)) - a_t, F.lit(0.5))) - F.log(a_c / F.greatest(F.lit(nc * (1 + PRIOR)) - a_c, F.lit(0.5)))
    z = odds / F.sqrt(1 / a_t + 1 / a_c)
    # Rare on both sides, the prior holds the odds near 0; add how far the counts are from the pooled rate.
    far = (F.col("t") - nt * rate) / F.sqrt(nt * rate * (1 - F.least(rate, F.lit(0.999))) * nc / (nt + nc))
    kept = counts.where((F.col("feature") != "") & (F.col("t") >= MIN_DOCS)).select("feature", F.least(odds, F.lit(TOP_SCORE)).alias("odds"), F.greatest(z, far).alias("z"))
    kept = kept.where((F.col("odds") > MIN_ODDS) & (F.col("z") > MIN_Z)).orderBy(F.desc("z"), "feature").collect()
    return [(r["feature"], r["z"], r["odds"]) for r in kept]


def _law(model: Model, hist: dict[float, float], words: int, best: list[tuple[int, float]]) -> None:
    """Set lambda and K by clean documents: how often each score is among so many words, and each document's words and best
    segment (0: none)."""
    pos = np.array([*hist, TOP_SCORE], float)
    num = np.array([*hist.values(), 0.5], float)
    rest = max(words - num.sum(), 1.0)
    values, freq = np.append(pos, -DRIFT), np.append(num, rest)
    freq = freq / freq.sum()
    if float((values * freq).sum()) < 0:
        model.lam = _karlin(values, freq)
    # The mean of n exp(-lambda S) over their best segments is 1 / K where the law holds.
    e = [n * math.exp(-model.lam * s) for n, s in best if s]
    n_clean = sum(n > 0 for n, _ in best)
    model.k = min(1.0, max(1e-4, (len(e) / max(n_clean, 1)) / (sum(e) / len(e)))) if e else 0.1


def _calibrate(sample: DataFrame, model: Model, n: dict[int, int]) -> None:
    """Set the law by these documents' clean ones, then the curve by all: one pass gives each document's words, how often
    each tenth of a score is, and its segments' scores. Rows of about MAX_ROWS / 2 documents come to the driver."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, words = model.places(text)
                bins = Counter(round(10 * s) for _, s in at) if not toxic else {}
                out.append((toxic, words, list(bins), list(bins.values()), [s for s, _, _ in segments(at, DRIFT)]))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["toxic", "words", "bins", "ns", "segs"])

    rows = sample.where("part = 0").select("text", "toxic").mapInArrow(look, "toxic int, words long, bins array<int>, ns array<int>, segs array<double>").collect()
    clean = [r for r in rows if not r["toxic"]]
    hist: Counter = Counter()
    for r in clean:
        for b, k in zip(r["bins"], r["ns"], strict=True):
            hist[b / 10] += k
    _law(model, hist, sum(r["words"] for r in clean), [(r["words"], max(r["segs"], default=0.0)) for r in clean])
    ev = np.array([math.log1p(model.evidence([(s, 0, 0) for s in r["segs"]], r["words"])) for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    if len(y) and 0 < y.sum() < len(y):
        a, b = _logistic(ev, y)
        # The sample may hold the classes in other shares than the labels do.
        model.curve = (a + math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum())), b)
    else:
        model.curve = (-2.0, 3.0)
    model.memo.clear()


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic; learn: which doc_ids may teach."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, MAX_ROWS / n[1]))).otherwise(F.lit(min(1.0, MAX_ROWS / n[0])))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / float(1 << 53)
    chosen = marked.where(h < share).withColumn("part", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(PARTS)))
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "part")  # at most about 2 * MAX_ROWS ids
    # Copies of one text would pass for evidence.
    sample = cut(sample.groupBy(text_key(F.col("text")).alias("k")).agg(F.max(F.struct("toxic", "part", "text")).alias("x")).select("x.text", "x.toxic", "x.part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[int, Counter] = {}
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                got.setdefault(toxic, Counter()).update({f for w in words for f in features(w)} | {""})
            for toxic, c in got.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["feature", "toxic", "n"])

    by = sample.where("part <> 0").select("text", "toxic").mapInArrow(count, "feature string, toxic int, n long")
    counts = by.groupBy("feature").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "t"), (0, "c"))])
    learned = _learn(cut(counts.where(F.col("t") >= MIN_DOCS)))
    if learned is None:
        return None
    model = Model({f: (z, o) for f, z, o in learned})
    _calibrate(sample, model, n)
    return model


def detect(text: Column, model: Model | None) -> Column:
    """A struct of score, evidence and passages (character spans) for each text."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                if model is None:
                    rows.append((0.0, 0.0, []))
                    continue
                at, n = model.places(t)
                segs = segments(at, DRIFT)
                ev = model.evidence(segs, n)
                clear = []
                for s, i, k in segs:
                    p = -math.expm1(-model.k * n * math.exp(-model.lam * s))
                    if p < P_MAX:
                        clear.append((s, i, k, p))
                if clear:
                    spans = [m.span() for m in _WORD.finditer(t.lower())]
                    clear = [{"start": spans[i][0], "end": spans[k][1], "score": s, "p": p} for s, i, k, p in clear]
                rows.append((model.score(ev), ev, clear))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))))], ["score", "evidence", "passages"])

    return run(text)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~out)
    got = docs.select("doc_id", out.alias("held_out"), detect(F.col("text"), model).alias("x"))
    return got.select("doc_id", "held_out", "x.score", (F.col("x.score") >= 0.5).cast("int").alias("predicted"), F.size("x.passages").cast("long").alias("n_passages"), "x.passages")
