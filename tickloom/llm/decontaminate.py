"""Benchmark decontamination by a prefix-filtered join with exact verification.

An item's windows are its runs of WINDOW words (the whole item if it has fewer).
A document holds a window only if it holds all the window's shingles (runs of
SHINGLE words), so one necessary shingle, the rarest among the documents, is the
window's prefix. A document joins a window through that shingle; the shingle's
place fixes where the window must start, and length and place bounds drop what
can't fit. What is left is compared word by word.

The rare end of the order comes from document frequencies of the benchmark's
shingles over all documents. The prefix index is broadcast while it has at most
MAX_BROADCAST windows. A larger benchmark is joined by shuffle on the prefix: a
bitmap of fixed size drops nearly all shingles that no window has, each other
one takes the words around it along, so windows are compared where they meet and
no text moves. Both ways compare the words themselves.

Defined results: null and empty texts have no words; items without words have no
windows; equal windows of several items count for each; repeated items (same id)
are one item with the windows of all its rows; a null item id is the empty
string. Repeated documents and other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, key_filter, may_hold, mix64, salted_join, text_key, word_numbers

WINDOW = 13
SHINGLE = 4
#: Windows of the benchmark that may be broadcast, at about 440 bytes each with their index, in every worker.
MAX_BROADCAST = 400_000
#: Share of a document's words, as 1 in so many, from which it is contaminated.
SHARE = 20
#: Parts that the windows of one prefix are joined in.
SALTS = 8

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII: lower case and digits stay, upper case is lowered, all else parts words; other bytes belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _numbers(ws: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """The words' numbers; 0 for words that no item has."""
    get = known.get
    return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))


def _shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n numbers."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mix64(h ^ (ids[k : k + m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return h


class Windows:
    """Distinct windows, their items, and the shingles (of ``size`` words) in them."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.known: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = {}
        for item, text in items:
            ids = [self.known.setdefault(w, len(self.known) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.windows = list(found)
        self.items = [sorted(x) for x in found.values()]

    def all_shingles(self) -> dict[int, np.ndarray]:
        """By shingle length (SHINGLE, or a shorter window's own): the distinct hashes."""
        got: dict[int, list[np.ndarray]] = {}
        for w in self.windows:
            n = min(SHINGLE, len(w))
            got.setdefault(n, []).append(_shingles(np.array(w, np.int64), n))
        return {n: np.unique(np.concatenate(x)) for n, x in got.items()}

    def index(self, counts: dict[int, int]) -> dict[int, tuple]:
        """By shingle length: the sorted prefix hashes, and for each the windows and places it stands for."""
        got: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, w in enumerate(self.windows):
            n = min(SHINGLE, len(w))
            hs = _shingles(np.array(w, np.int64), n).tolist()
            at = min(range(len(hs)), key=lambda i: (counts.get(hs[i], 0), hs[i], i))
            got.setdefault(n, {}).setdefault(hs[at], []).append((k, at))
        return {n: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for n, x in got.items()}


def count_shingles(docs: DataFrame, win: Windows) -> dict[int, int]:
    """In how many documents each of the benchmark's shingles is: one number for each comes to the driver."""
    known, wanted = win.known, win.all_shingles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                ids = _numbers(words(text), known)
                for n, sought in wanted.items():
                    h = _likely(ids, n, sought)[1]
                    for x in set(h.tolist()):
                        total[x] = total.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["h", "n"])

    rows = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["h"]).view(np.uint64)): r["n"] for r in rows}


def _likely(ids: np.ndarray, n: int, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose n words are all known and whose shingle is sought: places, hashes, their ranks among the sought."""
    m = len(ids) - n + 1
    if m <= 0 or not len(sought):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    full = np.cumsum(np.concatenate(([0], ids > 0)))
    at = np.flatnonzero(full[n:] - full[:-n] == n)
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix64(h ^ (ids[at + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    rank = np.minimum(np.searchsorted(sought, h), len(sought) - 1)
    ok = sought[rank] == h
    return at[ok], h[ok], rank[ok]


class Matcher:
    """Finds the windows in one text."""

    def __init__(self, win: Windows, counts: dict[int, int]):
        self.win, self.prefix = win, win.index(counts)

    def one(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, the places of hit words, the ids of items with a window here."""
        ids = _numbers(words(text), self.win.known)
        hit = np.zeros(len(ids) + 1, np.int64)
        items: set[str] = set()
        whole: list[int] | None = None
        for n, (sought, refs) in self.prefix.items():
            at, _, rank = _likely(ids, n, sought)
            for i, r in zip(at.tolist(), rank.tolist(), strict=True):
                for k, off in refs[r]:
                    w = self.win.windows[k]
                    start = i - off
                    if start < 0 or start + len(w) > len(ids):  # place and length bounds
                        continue
                    whole = ids.tolist() if whole is None else whole
                    if tuple(whole[start : start + len(w)]) == w:
                        hit[start] += 1
                        hit[start + len(w)] -= 1
                        items.update(self.win.items[k])
        return len(ids), np.flatnonzero(np.cumsum(hit)[:-1] > 0), sorted(items)


def matches(text: Column, win: Windows, counts: dict[int, int]) -> Column:
    """A struct of n_words, n_hit and items for each text; the index is broadcast."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Matcher(win, counts)
        for batch in batches:
            rows = [(n, len(hit), items) for n, hit, items in map(m.one, batch.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))], ["n_words", "n_hit", "items"])

    return run(text)


# --- a benchmark too large to broadcast -------------------------------------------------------------------------------


def _placed(ws: list[bytes], lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """By shingle length: the hashes of a text's shingles, in order. They only say where to look."""
    ids = word_numbers(ws)
    for m in lengths:
        yield m, _shingles(ids, m).view(np.int64)


def _windows(items: DataFrame) -> DataFrame:
    """(item, text) -> w (the words), items, m (the length of its shingles), hs (their hashes): a row a distinct window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                n = min(WINDOW, len(ws))
                m = min(SHINGLE, n)
                hs = next(_placed(ws, (m,)))[1] if n else None
                rows += [(item, [w.decode("utf-8", "surrogatepass") for w in ws[i : i + n]], m, hs[i : i + n - m + 1]) for i in range(len(ws) - n + 1 if n else 0)]
            types = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["item", "w", "m", "hs"])

    rows = items.mapInArrow(run, "item string, w array<string>, m int, hs array<long>")
    return rows.groupBy("w", "m", "hs").agg(F.collect_set("item").alias("items"))


def matches_by_shuffle(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text), (item, text) -> k (text key), items, start, length of every window found: nothing that grows is broadcast or
    collected."""
    spark = docs.sparkSession
    win = cut(_windows(items))
    lengths = tuple(sorted(r["m"] for r in win.select("m").distinct().collect()))  # of 1..SHINGLE
    held = spark.sparkContext.broadcast(key_filter(win.select(F.explode("hs").alias("h"))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(text)
                for m, hs in _placed(ws, lengths):
                    for at in np.flatnonzero(may_hold(bitmap, hs)).tolist():
                        left = max(0, at - WINDOW + m) if m == SHINGLE else at  # shorter shingles are windows
                        rows.append((k, m, int(hs[at]), at, at - left, b" ".join(ws[left : at + (WINDOW if m == SHINGLE else m)]).decode("utf-8", "surrogatepass")))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    around = docs.select(text_key(F.col("text")).alias("k"), "text").where(F.col("text").isNotNull())
    shingles = cut(around.mapInArrow(look, "k binary, m int, h long, at int, lead int, around string").distinct())
    # How many texts hold each shingle orders them; the rarest of a window is its prefix.
    df = shingles.groupBy("h", "m", "k").agg(F.lit(1).alias("one")).groupBy("h", "m").agg(F.count("*").alias("df"))
    pre = win.select("w", "items", "m", F.posexplode("hs").alias("off", "h")).join(df, ["h", "m"], "left")
    pre = pre.groupBy("w", "items", "m").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("p")).select("w", "items", "m", "p.h", "p.off")
    # A shingle that a third of the texts hold, or that many windows have for their prefix, is dealt over SALTS parts.
    pre = pre.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = shingles.withColumn("salt", F.pmod(F.hash("k"), F.lit(SALTS))).join(pre, ["h", "m", "salt"])
    # Place and length bounds, then the words.
    first = F.col("lead") - F.col("off")
    near = F.split("around", " ")
    met = met.where((first >= 0) & (first + F.size("w") <= F.size(near)))
    met = met.where(F.slice(near, first + 1, F.size("w")) == F.col("w"))
    return met.select("k", "items", (F.col("at") - F.col("off")).alias("start"), F.size("w").alias("length"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["k", "m", "h", "at", "lead", "around"])


def decontaminated(docs: DataFrame, items: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Add ``__found`` (n_words, n_hit, items) to a documents table. Helper columns begin with ``__`` too."""
    held = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    # A text of n characters has at most n windows: the bound is known before anything is fetched.
    if (held.agg(F.sum(F.length("text"))).first()[0] or 0) <= 4 * max_broadcast:
        win = Windows([(r["item"], r["text"]) for r in held.collect()])
        if len(win.windows) <= max_broadcast:
            return docs.withColumn("__found", matches(F.col("text"), win, count_shingles(docs, win)))
    m = cut(matches_by_shuffle(docs.select("text"), held))
    covered = m.select("k", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("k").agg(F.count("*").alias("__hit"))
    got = m.select("k", F.explode("items").alias("item")).distinct().groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("__items"))
    both = salted_join(docs.withColumn("__k", text_key(F.col("text"))), got.join(covered, "k").withColumnRenamed("k", "__k"), ["__k"])
    found = F.struct(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
    return both.withColumn("__found", found).select(*docs.columns, "__found")


def contaminated() -> Column:
    return (F.col("__found.n_hit") > 0) & (F.col("__found.n_hit") * SHARE >= F.col("__found.n_words"))


def op5(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = decontaminated(docs.select("doc_id", "text"), items)
    return out.select("doc_id", F.col("__found.n_words").alias("n_words"), F.col("__found.n_hit").alias("n_hit"), F.size("__found.items").cast("long").alias("n_items"), F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~contaminated()).select(docs.columns)


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
