"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.store import cut

#: Words of the mixing, dedup and fingerprint operators: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Arrow batch may hold before it goes to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, for texts may be of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a whole text; equal texts share them. Null for null."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads nearby values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_P = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse; grows as needed. With them the sum over a run of a
    running polynomial sum, brought to the run's begin, is the run's hash."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self.up, self.down


_POWERS = Powers(_P)


def polynomial_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end], from the values alone."""
    up, down = _POWERS(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words (runs without ASCII white space)."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    return polynomial_runs(raw + np.uint64(1), edge[::2], edge[1::2])


def word_numbers(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words that are already apart."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return polynomial_runs(raw + np.uint64(1), end - size, end).view(np.int64)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; none if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mix64(h ^ hashes[k : k + m]) + np.uint64(k + 1)
    return h


# --- joins ------------------------------------------------------------------------------------------------------------


def salted_join(rows: DataFrame, found: DataFrame, on: list[str], salts: int = 8) -> DataFrame:
    """Left join with a hot side: a key's rows are dealt over so many parts, and ``found`` (a row a key, or a few) goes to
    each part. Rows that agree in all but the text stay together."""
    rest = [c for c, t in rows.dtypes if c not in on and c != "text" and "map<" not in t] or on
    dealt = rows.withColumn("__salt", F.pmod(F.hash(*rest), F.lit(salts)))
    return dealt.join(found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "__salt"], "left").drop("__salt")


#: Bits of a key filter for each key, and in all: 32 MB at most reach the driver and the executors, whatever the input.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 28
_BLOCK_BITS = 1 << 16


def key_filter(keys: DataFrame) -> np.ndarray:
    """One long column -> a bitmap of hashes that says which values may be among them: all that are, and few others (the
    more the fuller it gets; what it lets pass must still be joined)."""
    bits = min(MAX_FILTER_BITS, max(_BLOCK_BITS, 1 << (FILTER_BITS * keys.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(mix64(np.asarray(b.column(0)).view(np.uint64)) & np.uint64(bits - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _BLOCK_BITS), pa.array(at % _BLOCK_BITS)], ["block", "bit"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}  # at most as many as the filter has in all
        for b in batches:
            block, bit = np.asarray(b.column(0)), np.asarray(b.column(1))
            for k in np.unique(block).tolist():
                on = np.zeros(_BLOCK_BITS, bool)
                on[bit[block == k]] = True
                got[k] = np.packbits(on, bitorder="little") | got.get(k, np.uint8(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    rows = keys.mapInArrow(places, "block long, bit long").repartition("block").mapInArrow(blocks, "block long, bits binary")
    for r in rows.collect():
        at = r["block"] * (_BLOCK_BITS // 8)
        out[at : at + _BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of these 64-bit keys may be among the filter's."""
    at = mix64(keys.view(np.uint64)) & np.uint64(8 * len(bitmap) - 1)
    return bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def passes(key: Column, bitmap: np.ndarray, spark: SparkSession) -> Column:
    """may_hold for a long column; nulls count as 0."""
    held = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf(T.BooleanType())
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(may_hold(held.value, np.asarray(keys.fill_null(0), np.int64)))

    return run(key)


#: Parts that a node's edges are dealt over.
HUB_SALTS = 8


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> node, root: the least node of each connected component. Alternating large and small stars, until
    nothing changes; each round is two joins and sums on edges, no neighbour list is ever gathered, and a node's edges are
    dealt over HUB_SALTS parts."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")) if large else both.where("b < a").groupBy("a").agg(F.min("b").alias("low"))
        pick = both.where("b > a") if large else both.where("b < a")
        moved = pick.withColumn("s", F.pmod(F.hash("b"), F.lit(HUB_SALTS))).join(low.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1)))), ["a", "s"]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            moved = moved.unionByName(low.select("a", F.col("low").alias("b")))
        return moved.where("a <> b").distinct()

    e, before = cut(edges.where("a <> b").select("a", "b").distinct()), None
    while True:
        e = cut(star(star(e, True), False))
        state = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)).alias("s"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    stars = e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
