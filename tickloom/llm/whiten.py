"""Whitening of embeddings: components by spectral divide and conquer on polar decompositions.

Spark works out three small things over all rows: the distinct vectors' number
and sums (exact), their centred second moments, and, at the end, those of the
whitened vectors. Each partition adds up its own rows; matrices are then added
line by line, a line a group, so the driver gets one d x d matrix whatever the
rows. There the matrix is split: with a shift inside its spectrum, QDWH iterations
give the orthogonal polar factor U of V - shift, (U + 1) / 2 projects on the
eigenvectors above the shift, and orthonormal bases of both sides leave two smaller
matrices, down to single components. The projection matrix is then broadcast
(d x 4 doubles) and every row is whitened where it lies.

Defined results: rows with a null vector, a null or non-finite entry are dropped,
and so are vectors of another length than most (ties: the longest), and empty
ones. Repeated rows are in the result as often as in the table, in the fit once.
Null vec_id is kept. A component without variance (under d * 1e-15 of the trace;
all of them if there is but one distinct vector) has null whitened and explained 0,
and identity_error leaves it out (null if no component has variance). Equal
eigenvalues give some orthonormal basis of their space. Each component's largest
entry (ties: the first) is positive. x beyond 64 bits is
the nearest long; a deviation beyond 64 bits is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.sources.store import cut

SCALE, TOP = 256, 4
EPS = float(np.finfo(float).eps)
#: A component with less than this share of the trace, times the dimension, has no variance.
NO_VARIANCE = 1e-15


# --- polar decomposition and the division of the spectrum -------------------------------------------------------------


def polar(a: np.ndarray, steps: int = 12) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps: singular values
    move to 1 by the best rational map for a spectrum in [low, 1]."""
    n = len(a)
    size = np.linalg.norm(a)
    if size == 0:
        return np.eye(n)
    x, low = a / size, 1e-16
    for _ in range(steps):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * basis[:n] @ basis[n:].T
        low = min(1.0, low * (p + q * l2) / (1 + r * l2))
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        if low >= 1 - 10 * EPS and moved <= 1e-8 * np.sqrt(n):
            break
    return x


def _sides(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces above and below the shift; None where it doesn't part them cleanly."""
    n = len(a)
    c = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(c)))
    if not 0 < k < n or np.linalg.norm(c @ c - c) > 1e-10 * n:
        return None
    # The columns of a projector span its range; the k longest after deflation (a pivoted QR) do so stably.
    rest, above = c.copy(), []
    for _ in range(k):
        v = rest[:, int(np.argmax((rest * rest).sum(0)))]
        for _ in range(2):  # once more, for what rounding leaves
            for u in above:
                v = v - u * (u @ v)
            v = v / np.linalg.norm(v)
        above.append(v)
        rest = rest - np.outer(v, v @ rest)
    up = np.array(above).T
    down = np.linalg.qr(up, mode="complete")[0][:, k:]
    return up, down


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by recursive division."""
    whole = max(np.linalg.norm(v), np.finfo(float).tiny)
    values, vectors = [], []
    todo = [np.eye(len(v))]
    while todo:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        n, mid = len(a), float(np.trace(a)) / len(a)
        off = np.linalg.norm(a - mid * np.eye(n))
        if n == 1 or off <= 4 * EPS * n * whole:
            values += [mid] * n
            vectors += list(basis.T)
            continue
        spread = np.linalg.norm(a - mid * np.eye(n), 2)
        # The middle of the diagonal first, then the mean and points about it: one of them lies in a gap.
        shifts = [float(np.median(np.diag(a))), mid, *(mid + spread * f for f in (0.05, -0.05, 0.15, -0.15, 0.31, -0.31, 0.53, -0.53, 0.79, -0.79))]
        for s in shifts:
            parts = _sides(a, s)
            if parts:
                todo += [basis @ p for p in parts]
                break
        else:
            values += [float(x) for x in np.diag(a)]
            vectors += list(basis.T)
    order = np.argsort(-np.array(values), kind="stable")
    w = np.array(vectors)[order].T
    big = w[np.abs(w).argmax(0), np.arange(w.shape[1])]
    return np.array(values)[order], w * np.where(big < 0, -1.0, 1.0)


# --- sums over all rows -----------------------------------------------------------------------------------------------


def whole_numbers(vector: Column) -> Column:
    """floor(256 * c) of each entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is there, finite in every entry, and as long as most are."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _stack(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), d)


def moments(distinct: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number, exact sums and covariance (divisor n, centred before multiplying) of the distinct vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = _stack(b, d)
            n += len(x)
            # Halves keep the sums of a batch exact for any 64-bit entries.
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = [t + (int(h) << 32) + int(k) for t, h, k in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int64()), pa.array([str(n), *map(str, total)])], ["j", "total"])

    parts = distinct.mapInArrow(sums, "j long, total string").groupBy("j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by = {r["j"]: int(r["total"]) for r in parts.collect()}
    n, total = by.get(-1, 0), [by.get(j, 0) for j in range(d)]
    if not n:
        return 0, total, np.zeros((d, d))
    mean = np.array([t / n for t in total])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((d, d))
        for b in batches:
            x = _stack(b, d) - mean
            m += x.T @ x
        yield from _lines(m)

    return n, total, _added(distinct, products, d) / n


def _lines(m: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], ["line", "v"])


def _added(rows: DataFrame, products, d: int) -> np.ndarray:
    """The sum of the partitions' matrices, a group a line; d lines of d doubles come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[k] = got.get(k, 0.0) + np.frombuffer(v)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["line", "v"])

    out = np.zeros((d, d))
    for r in rows.mapInArrow(products, "line int, v binary").repartition("line").mapInArrow(add, "line int, v binary").collect():
        out[r["line"]] = np.frombuffer(r["v"])
    return out


class Whitening:
    """What a fit gives: number and sums of the distinct vectors, eigenvalues, and the projection on the first components."""

    def __init__(self, n: int, total: list[int], covariance: np.ndarray, top: int = TOP):
        self.n, self.total, self.d = n, total, len(total)
        self.mean = np.array([t / n for t in total]) if n else np.zeros(self.d)
        self.values, vectors = components(covariance)
        self.trace = float(np.trace(covariance))
        self.top = min(top, self.d)
        self.live = [bool(self.values[k] > NO_VARIANCE * self.d * self.trace) and self.trace > 0 for k in range(self.top)]
        scale = [1 / np.sqrt(self.values[k]) if self.live[k] else 0.0 for k in range(self.top)]
        self.matrix = vectors[:, : self.top] * scale
        self.identity_error: float | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        """Entry by entry, so that equal rows have equal results wherever they stand."""
        y = np.zeros((len(x), self.top))
        for j in range(self.d):
            y += (x[:, j : j + 1] - self.mean[j]) * self.matrix[j]
        return y

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact; in 64 bits where they suffice."""
        reach = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.total), default=0)
        if self.d * reach * reach < 1 << 63:
            e = self.n * x - np.array(self.total, np.int64)
            return (e * e).sum(1).tolist()
        got = [sum((self.n * c - t) ** 2 for c, t in zip(r, self.total, strict=True)) for r in x.tolist()]
        return [g if g < 1 << 63 else None for g in got]


def fit(rows: DataFrame, top: int = TOP) -> Whitening | None:
    """vec_id, x -> the whitening of its distinct vectors; None of no rows. Vectors are shuffled once, each distinct one of
    a partition once."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    distinct = cut(rows.select("x").distinct())
    w = Whitening(*moments(distinct, d), top)
    if any(w.live):
        held = distinct.sparkSession.sparkContext.broadcast(w)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros((top, top))
            for b in batches:
                y = held.value.of(_stack(b, d))  # centred, as x is before the projection
                m += y.T @ y
            yield from _lines(m)

        top = w.top
        second = _added(distinct, products, w.top) / w.n
        on = np.flatnonzero(w.live)
        w.identity_error = float(np.abs(second[np.ix_(on, on)] - np.eye(len(on))).max())
    return w


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """A row for each of the rows and components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    held = rows.sparkSession.sparkContext.broadcast(w)
    id_type = rows.schema["vec_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            x = _stack(b, w.d)
            y, each, k = w.of(x), len(x), w.top
            at = np.repeat(np.arange(each), k)
            dead = np.tile(~np.array(w.live), each)
            share = [v / w.trace if on else 0.0 for v, on in zip(w.values[:k].tolist(), w.live, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").cast(arrow_id).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), each), pa.int32()), pa.array(np.full(each * k, w.n)),
                    pa.array(w.deviation(x), pa.int64()).take(pa.array(at)), pa.array(y.reshape(-1), mask=dead), pa.array(np.tile(share, each)), pa.array([w.identity_error] * (each * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"vec_id {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13(embeddings: DataFrame) -> DataFrame:
    """The whitening query: every usable row on the first four components."""
    rows = usable(embeddings)
    w = fit(rows)
    if w is None:
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(rows, w)
