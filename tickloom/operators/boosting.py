"""Boosted trees of a binary label, grown leaf by leaf on histograms that Spark adds up.

Columns are cut into at most ``BINS`` bins once, by quantiles of the training rows,
and each row is kept as a string of bytes; rows of equal bytes and label (trades that
enter on one bar) are then kept as one with their numbers, and count as often. A round of leaves is one job: every
partition routes its rows down the tree so far and adds up gradients, Hessians and
counts by leaf, column and bin; partitions' histograms are added a leaf a group, and
the driver, which gets a histogram a leaf (columns x bins x 3 numbers), chooses
splits. The leaf with the largest gain is split first, up to ``leaves`` of them. A
job works on all nodes that may yet be split at once, left children only (right
ones are what is left of the parent), so a tree takes as many jobs as it is deep,
at most.

Gains and leaf values are regularised by L1 and L2. Rows are bagged by a hash of
their number, anew every ``bag_every`` rounds, columns by tree. The loss on the rows
held out comes with the next round's first job; where it has not fallen for
``patience`` rounds the model ends at its best round, without refitting.

A model is plain data: its columns with their bin edges and the medians that nulls
become, its trees and a version. It can be saved, loaded and applied to any table
that has the columns; one that lacks some is an error, or has their medians if the
caller says so.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.store import cut

BINS, VERSION = 255, 1
#: Rounds after which the rows' scores are written down, so that no job applies more trees than that.
WRITE_EVERY = 10
#: Rows that are packed at once, and packed ones that a task works on.
ROWS, PATTERNS = 100_000, 20_000


@dataclass
class Settings:
    rounds: int = 250
    rate: float = 0.03
    leaves: int = 15
    depth: int = 6
    least: int | None = None  # rows of a leaf; None: a fiftieth of the training rows, 20 at least
    least_hessian: float = 1e-3
    l1: float = 0.1
    l2: float = 0.1
    columns: float = 0.7
    bag: float = 0.7
    bag_every: int = 5
    patience: int = 40
    seed: int = 7


@dataclass
class Tree:
    """Nodes in lists: column (-1 for a leaf), the last bin that goes left, children, and the value of a leaf."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for x, v in ((self.column, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            x.append(v)
        return len(self.column) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        column, cut_, left, right = (np.array(x) for x in (self.column, self.bin, self.left, self.right))
        while True:
            inner = np.flatnonzero(column[at] >= 0)
            if not len(inner):
                return at
            k = at[inner]
            at[inner] = np.where(bins[inner, column[k]] <= cut_[k], left[k], right[k])


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    medians: list[float]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    version: int = VERSION

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Values (null as NaN) as bins: how many edges are below."""
        out = np.zeros(values.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(np.array(e), np.where(np.isnan(values[:, j]), self.medians[j], values[:, j]), "left")
        return out

    def raw(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        out = np.full(len(bins), self.base if start == 0 else 0.0)
        for t in self.trees[start:]:
            out += np.array(t.value)[t.leaf_of(bins)]
        return out

    def importances(self) -> list[tuple[str, float]]:
        """By share of the gain, largest first."""
        gain = np.zeros(len(self.features))
        for t in self.trees:
            for c, g in zip(t.column, t.gain, strict=True):
                if c >= 0:
                    gain[c] += g
        total = float(gain.sum()) or 1.0
        return sorted(((f, float(g) / total) for f, g in zip(self.features, gain, strict=True)), key=lambda x: (-x[1], x[0]))

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Model:
        d = json.loads(text)
        if d.get("version") != VERSION:
            raise ValueError(f"a model of version {d.get('version')}, not {VERSION}")
        return Model(**{**d, "trees": [Tree(**t) for t in d["trees"]]})


def save(model: Model, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.version, model.dumps())], "version int, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.loads(spark.read.parquet(path).first()["model"])


# --- splits -----------------------------------------------------------------------------------------------------------


def shrunk(g: np.ndarray | float, l1: float) -> np.ndarray | float:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(h: np.ndarray, allowed: np.ndarray, s: Settings, least: int) -> tuple[float, int, int]:
    """Of a histogram (columns, bins, 3) the gain, column and last left bin of the best split; gain 0 where none is worth
    it. Of equal gains the first column and bin count."""
    left = np.cumsum(h, axis=1)
    total = left[:1, -1:, :]
    right = total - left
    score = lambda x: shrunk(x[..., 0], s.l1) ** 2 / (x[..., 1] + s.l2)
    ok = (left[..., 2] >= least) & (right[..., 2] >= least) & (left[..., 1] >= s.least_hessian) & (right[..., 1] >= s.least_hessian) & allowed[:, None]
    gain = np.where(ok, score(left) + score(right) - score(total), -np.inf)
    # Gains that differ by rounding alone are equal, so sums' order doesn't choose.
    top = gain.max(initial=-np.inf)
    if not top > 1e-9:
        return 0.0, -1, 0
    j, b = np.unravel_index(int(np.argmax(gain >= top - 1e-9 * max(1.0, abs(top)))), gain.shape)
    return float(gain[j, b]), int(j), int(b)


def bagged(number: np.ndarray, round_: int, s: Settings) -> np.ndarray:
    """Which rows a round learns from."""
    x = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((round_ // s.bag_every + 1) * 0x632BE59BD9B4E019 + s.seed & (1 << 64) - 1)
    for k in (30, 27, 31):
        x = (x ^ (x >> np.uint64(k))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < s.bag


def columns_of(n: int, round_: int, s: Settings) -> np.ndarray:
    out = np.zeros(n, bool)
    out[np.random.default_rng([s.seed, round_]).permutation(n)[: max(1, math.ceil(n * s.columns))]] = True
    return out


def gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


# --- jobs -------------------------------------------------------------------------------------------------------------


def quantiles(typed: DataFrame, columns: list[str], bins: int) -> list[tuple[list[float], float]]:
    """Of each column the distinct values at ranks k / bins and the median, exact, nulls left out; [0.0] and 0.0 where it has
    none. Equal values are counted first; runs of a column's values are then summed apart and offset by those before."""
    rows = typed.select(F.posexplode(F.array(*columns)).alias("j", "x")).where("x IS NOT NULL").groupBy("j", "x").agg(F.count("*").alias("n"))
    rows = cut(rows.repartitionByRange("j", "x").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("j")
    sums = rows.groupBy("j", "part").agg(F.sum("n").alias("s"))
    sums = sums.select("j", "part", (F.sum("s").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(w).alias("t"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("j", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(sums), ["j", "part"]).withColumn("c", upto)
    # The value at rank k / bins is the first one up to which that share of the values is.
    edge = F.expr(f"c * {bins} div t > (c - n) * {bins} div t AND (c - n) * {bins} div t < {bins} - 1").alias("edge")
    found: list[tuple[list[float], list[float]]] = [([], []) for _ in columns]
    for r in rows.select("j", "x", edge, F.expr("2 * c >= t AND 2 * (c - n) < t").alias("middle")).where("edge OR middle").collect():
        for on, held in zip((r["edge"], r["middle"]), found[r["j"]], strict=True):
            if on:
                held.append(r["x"])
    return [(sorted(e) or [0.0], m[0] if m else 0.0) for e, m in found]


def prepared(rows: DataFrame, features: list[str]) -> tuple[DataFrame, Model]:
    """Edges and medians from the training rows; rows as bytes of bins, label, train, number, raw score."""
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"x{j}") for j, c in enumerate(features)]
    typed = rows.select(*x, F.col("label").cast("double").alias("y"), F.col("train").cast("boolean").alias("train"))
    p = min(max(float(typed.where("train").agg(F.avg("y")).first()[0]), 1e-6), 1 - 1e-6)
    found = quantiles(typed.where("train"), [f"x{j}" for j in range(len(features))], BINS)
    model = Model(list(features), [e for e, _ in found], [m for _, m in found], math.log(p / (1 - p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))], 1)
            bins = model.binned(values)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column("y"), b.column("train"), pa.array(np.full(len(bins), model.base))], ["bins", "y", "train", "raw"])

    kept = typed.mapInArrow(run, "bins binary, y double, train boolean, raw double").withColumn("number", F.monotonically_increasing_id())
    return cut(kept), model


def packed(data: DataFrame, n: int) -> DataFrame:
    """Rows of equal bins, label and part as one, with their numbers, found in blocks of about ROWS of the n rows that are
    split by number too, so that no block holds more of rows that are all equal."""
    d = data.repartitionByRange(max(1, -(-n // ROWS)), "bins", "y", "train", "number").sortWithinPartitions("bins", "y", "train", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, train = b.column("y").to_numpy(), b.column("train").to_numpy(zero_copy_only=False)
            bins, number = np.array(b.column("bins").to_pylist(), object), b.column("number").to_numpy()
            new = np.flatnonzero(np.append(True, (bins[1:] != bins[:-1]) | (y[1:] != y[:-1]) | (train[1:] != train[:-1])))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(new)) for c in ("bins", "y", "train", "raw")], pa.array([x.tobytes() for x in np.split(number, new[1:])], pa.binary())], ["bins", "y", "train", "raw", "numbers"])

    out = cut(d.select("bins", "y", "train", "raw", "number").mapInArrow(run, f"{_PACKED}, numbers binary"))
    return out.coalesce(max(1, -(-out.count() // PATTERNS), -(-n // (10 * ROWS))))


def _block(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, label, part, raw score and how many rows each stands for; the numbers of those, in order."""
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, d)
    if "number" in b.schema.names:
        number, times = b.column("number").to_numpy(), np.ones(len(bins), np.int64)
    else:
        held = b.column("numbers").to_pylist()
        number, times = np.frombuffer(b"".join(held), np.int64), np.array([len(x) // 8 for x in held], np.int64)
    return bins, b.column("y").to_numpy(), b.column("train").to_numpy(zero_copy_only=False), b.column("raw").to_numpy(), times, number


_PACKED = "bins binary, y double, train boolean, raw double"
_HIST = "node long, h binary, loss double, held long"


def _histograms(data: DataFrame, model: Model, written: int, tree: Tree, wanted: list[int], round_: int, s: Settings) -> tuple[dict[int, np.ndarray], float, int]:
    """Histograms of these nodes of the tree so far, over the round's bag; the loss and number of the rows held out."""
    d = len(model.features)
    place = {n: i for i, n in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.zeros((len(wanted), d, BINS + 1, 3))
        loss = held = 0.0
        slot = np.full(max(place) + 1, -1)
        slot[list(place)] = list(place.values())
        for b in batches:
            bins, y, train, raw, times, number = _block(b, d)
            if not len(bins):
                continue
            raw = raw + (model.raw(bins, written) if written else model.raw(bins) - model.base)
            out = ~train
            loss += float((times[out] * np.logaddexp(0, np.where(y[out] == 1, -raw[out], raw[out]))).sum())
            held += int(times[out].sum())
            times = np.add.reduceat(bagged(number, round_, s).astype(float), np.cumsum(times) - times)
            use = train & (times > 0)
            bins, times, g, hess = bins[use], times[use], *gradients(raw[use], y[use])
            g, hess = g * times, hess * times
            leaf = tree.leaf_of(bins)
            k = np.where(leaf < len(slot), slot[np.minimum(leaf, len(slot) - 1)], -1)
            on = k >= 0
            bins, g, hess, times, k = bins[on], g[on], hess[on], times[on], k[on]
            for j in range(d):
                at = k * (BINS + 1) + bins[:, j]
                for c, w in enumerate((g, hess, times)):
                    h[:, j, :, c] += np.bincount(at, w, len(wanted) * (BINS + 1)).reshape(len(wanted), BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *wanted], pa.int64()), pa.array([None, *[x.tobytes() for x in h]], pa.binary()), pa.array([loss, *[0.0] * len(wanted)]), pa.array([int(held), *[0] * len(wanted)], pa.int64())], ["node", "h", "loss", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for n, h, loss, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = got.setdefault(n, [0.0, 0.0, 0])
                x[0], x[1], x[2] = (x[0] + np.frombuffer(h)) if h is not None else x[0], x[1] + loss, x[2] + held
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([x[0].tobytes() if isinstance(x[0], np.ndarray) else None for x in got.values()], pa.binary()), pa.array([x[1] for x in got.values()]), pa.array([x[2] for x in got.values()], pa.int64())], ["node", "h", "loss", "held"])

    parts = data.mapInArrow(run, _HIST)
    if data.rdd.getNumPartitions() > 1:
        parts = parts.repartition(min(len(wanted) + 1, 32), "node").mapInArrow(add, _HIST)
    rows = {r["node"]: r for r in parts.collect()}
    return {n: np.frombuffer(rows[n]["h"]).reshape(d, BINS + 1, 3) for n in wanted if n in rows}, rows[-1]["loss"], rows[-1]["held"]


def grow(root: np.ndarray, more, allowed: np.ndarray, s: Settings, least: int) -> Tree:
    """A tree from the histogram of all rows; ``more(tree, nodes)`` gives those of further nodes of a tree."""
    wide = Tree()  # with all splits that may be wanted; the final tree is part of it
    wide.add()
    hists, depth, splits, sums = {0: root}, {0: 0}, {0: best_split(root, allowed, s, least)}, {0: root[0].sum(0)}
    kept: set[int] = set()  # nodes that are split
    leaves = {0}
    while len(leaves) < s.leaves:
        able = [n for n in leaves if splits[n][0] > 0]
        if not able:
            break
        best = min(able, key=lambda n: (-splits[n][0], n))
        if wide.column[best] < 0:
            # All nodes that may be split get children, whether they are leaves yet or not, and the left ones that may be
            # split again their histograms, in one job.
            new = [n for n in range(len(wide.column)) if wide.column[n] < 0 and splits[n][0] > 0]
            for n in new:
                gain, j, b = splits[n]
                left, right = wide.add(), wide.add()
                wide.column[n], wide.bin[n], wide.gain[n], wide.left[n], wide.right[n] = j, b, gain, left, right
                depth[left] = depth[right] = depth[n] + 1
                sums[left] = hists[n][j, : b + 1].sum(0)
                sums[right] = sums[n] - sums[left]
            inner = [n for n in new if depth[n] + 1 < s.depth]
            found = more(wide, [wide.left[n] for n in inner]) if inner else {}
            for n in new:
                left, right = wide.left[n], wide.right[n]
                splits[left] = splits[right] = (0.0, -1, 0)
                if left in found:
                    hists[left] = found[left]
                    hists[right] = hists[n] - found[left]
                    hists[right][..., 2] = np.round(hists[right][..., 2])
                    for k in (left, right):
                        splits[k] = best_split(hists[k], allowed, s, least)
                del hists[n]
        kept.add(best)
        leaves = leaves - {best} | {wide.left[best], wide.right[best]}
    out, todo = Tree(), [(0, -1, False)]
    while todo:
        n, parent, right = todo.pop(0)
        k = out.add()
        if parent >= 0:
            (out.right if right else out.left)[parent] = k
        if n in kept:
            out.column[k], out.bin[k], out.gain[k] = wide.column[n], wide.bin[n], wide.gain[n]
            todo += [(wide.left[n], k, False), (wide.right[n], k, True)]
        else:
            g, h = sums[n][:2]
            out.value[k] = float(-s.rate * shrunk(g, s.l1) / (h + s.l2))
    return out


def train(rows: DataFrame, features: list[str], settings: Settings | None = None) -> Model | None:
    """A model of ``label`` on rows with ``train``, stopped by the loss on the others; None where one class or under 30
    rows."""
    s = settings or Settings()
    n, kinds, learn = rows.agg(F.count("*"), F.countDistinct("label"), F.count_if("train")).first()
    if n < 30 or kinds < 2 or learn == 0:
        return None
    data, model = prepared(rows, features)
    data = packed(data, n)
    least = s.least if s.least is not None else max(20, learn // 50)
    written, best = 0, 0
    for k in range(s.rounds + 1):
        one = Tree()
        one.add()
        found, loss, held = _histograms(data, model, written, one, [0], k, s)
        if k:
            model.losses.append(loss / max(1, held))
            if model.losses[-1] < model.losses[best]:
                best = k - 1
            if held and k - 1 - best >= s.patience:
                break
        if k == s.rounds:
            break
        more = lambda tree, nodes, k=k: _histograms(data, model, written, tree, nodes, k, s)[0]  # noqa: E731, B023
        model.trees.append(grow(found[0], more, columns_of(len(features), k, s), s, least))
        if len(model.trees) - written >= WRITE_EVERY:
            data, written = _written(data, model, written), len(model.trees)
    if held:
        model.trees, model.losses = model.trees[: best + 1], model.losses[: best + 1]
    return model


def _written(data: DataFrame, model: Model, written: int) -> DataFrame:
    d = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, _, _, raw, *_ = _block(b, d)
            new = raw + (model.raw(bins, written) if written else model.raw(bins) - model.base)
            yield b.set_column(b.schema.get_field_index("raw"), "raw", pa.array(new))

    return cut(data.mapInArrow(run, f"{_PACKED}, numbers binary"))


def scored(model: Model, rows: DataFrame, fill_missing: bool = False, name: str = "score") -> DataFrame:
    """Rows with the model's probability. A column that isn't there is an error, or its median if ``fill_missing``."""
    missing = [c for c in model.features if c not in rows.columns]
    if missing and not fill_missing:
        raise ValueError(f"missing columns: {missing}")

    @F.arrow_udf(T.DoubleType())
    def run(values: pa.Array) -> pa.Array:
        x = np.array(values.flatten().to_numpy(zero_copy_only=False), float).reshape(len(values), len(model.features))
        return pa.array(1 / (1 + np.exp(-model.raw(model.binned(x)))))

    held = F.array(*[F.col(c).cast("double") if c not in missing else F.lit(None).cast("double") for c in model.features])
    return rows.withColumn(name, run(held))


def heuristic_importances(features: list[str]) -> list[tuple[str, float]]:
    """Without a model: equal shares of the first twenty columns."""
    return [(f, 1.0 / max(1, len(features))) for f in features[:20]]
