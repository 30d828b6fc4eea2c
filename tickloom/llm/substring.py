"""Repeated passages found with FM-indexes and removed.

A window is WINDOW consecutive words of one text. It is repeated if its words
also start anywhere else, in this text or another. Every word that a repeated
window covers is removed; windows are judged on the input.

So that no text need be held against every shard, texts are cut so that equal
windows meet in one shard. Each window has an anchor: the run of ANCHOR words in
it with the least hash, the leftmost on a tie. Equal windows have equal anchors,
so anchors that occur once have no repeated window and go. Windows in a row with
one anchor are a segment, cut by its content alone; a segment goes to the shard
of its anchor, equal segments once, with their number. Anchors of over HOT
occurrences part further: each of their windows is a segment of its own, dealt by
its first and last words too, so no shard has to hold what they have in common.

A shard indexes its segments: suffix array, Burrows-Wheeler transform, bit-packed
wavelet matrix. The segments then stream through the index: backward search
extends a match to the left while it occurs twice or more, which gives the
matching statistics that decide which windows are repeated.

Defined results: null and empty texts have no words; texts under WINDOW words
lose none; runs of one word overlap themselves and count; repeated rows are
occurrences like any others. Words compare by 64-bit hashes. Other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, mix64, polynomial_runs, text_key, word_hashes

WINDOW = 35
ANCHOR = 8
#: Occurrences of an anchor from which its windows part.
HOT = 10_000
#: Anchors that repeat and may be broadcast (8 bytes each); more are joined by shuffle.
MAX_BROADCAST = 4_000_000
SALTS = 8
#: Words that one index takes; one anchor's segments stay together.
SHARD_WORDS = 400_000


def _roll(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(hashes) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += hashes[k : k + m]
    return mix64(h)


def anchors(hashes: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: the anchor's place, and the runs' hashes by place."""
    g = _roll(hashes, size)
    w = window - size + 1
    # Least of w neighbours by doubling; the place fills the low bits, so the leftmost wins a tie of the high ones.
    bits = max(20, len(g).bit_length())
    low = np.uint64((1 << bits) - 1)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < w:
        key = np.minimum(key[: len(g) - w + 1], key[w - have : w - have + len(g) - w + 1])
    return (key & low).astype(np.int64), g


def segments(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run that has one anchor."""
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    return first, np.diff(np.append(first, len(place)))


# --- the index --------------------------------------------------------------------------------------------------------


class FMIndex:
    """Of texts given as word numbers from 1 on, with weights; each text ends with a separator of its own."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray):
        n = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        x = np.zeros(int(ends[-1]), np.int64)
        self.starts = np.concatenate(([0], ends[:-1]))
        keep = np.ones(len(x), bool)
        keep[ends - 1] = False
        x[keep] = np.concatenate(texts)
        sym = x + n
        sym[ends - 1] = np.arange(n)
        order = self._suffixes(sym, max(len(t) for t in texts) + 1)
        bwt = x[order - 1]
        self.sigma = int(x.max()) + 1
        self.c = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=self.sigma))))
        text_of = np.searchsorted(ends, order, "right")
        self.weight = np.concatenate(([0], np.cumsum(weights[text_of])))
        self.levels: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        for bit in reversed(range(max(1, (self.sigma - 1).bit_length()))):
            on = (bwt >> bit) & 1 == 1
            words = np.zeros(len(on) // 64 + 1, np.uint64)
            packed = np.packbits(on, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
            zeros = int(len(on) - on.sum())
            self.levels.append((words, before, zeros, bit))
            bwt = np.concatenate((bwt[~on], bwt[on]))
        symbols = np.arange(self.sigma)
        self.base = self._descend(symbols, np.zeros(self.sigma, np.int64))

    @staticmethod
    def _suffixes(sym: np.ndarray, depth: int) -> np.ndarray:
        """The suffix array, by doubling; texts end within depth, where separators tell all suffixes apart."""
        rank = np.unique(sym, return_inverse=True)[1].astype(np.int64)
        top = int(rank.max()) + 2
        have = 1
        if top < 1 << 20:  # three at once
            pad = np.concatenate((rank + 1, [0, 0]))
            rank = (pad[:-2] * top + pad[1:-1]) * top + pad[2:]
            have = 3
        while True:
            order = np.argsort(rank, kind="stable")
            r = rank[order]
            new = np.empty(len(rank), np.int64)
            new[order] = np.cumsum(np.concatenate(([0], r[1:] != r[:-1])))
            if have >= depth or new[order[-1]] == len(rank) - 1:
                return order
            rank = (new + 1) * (len(rank) + 1) + np.concatenate((new[have:] + 1, np.zeros(min(have, len(new)), np.int64)))[: len(new)]
            have *= 2

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for words, before, zeros, bit in self.levels:
            w = at >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the rows of the suffixes that begin with the symbol and go on as the given rows do."""
        both = self._descend(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        at = self.c[symbol] - self.base[symbol]
        return at + both[: len(lo)], at + both[len(lo) :]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]


def repeated(texts: list[np.ndarray], weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which windows of each text occur twice or more in all, by weight: a row of booleans for each text."""
    ids = np.unique(np.concatenate(texts), return_inverse=True)[1] + 1
    sizes = np.array([len(t) for t in texts])
    texts = np.split(ids, np.cumsum(sizes)[:-1])
    index = FMIndex(texts, weights)
    flat = np.concatenate([np.append(t, 0) for t in texts])
    count = sizes - window + 1
    most = int(count.max())
    places = np.arange(most)
    open_ = places[None, :] < count[:, None]
    found = np.zeros_like(open_)
    whole = np.ones(len(texts), bool)
    while True:
        # The first run of undecided windows of each text: all of it at first, then halves.
        live = np.flatnonzero(open_.any(1))
        if not len(live):
            return found
        o = open_[live]
        first = o.argmax(1)
        stop = (~o & (places[None, :] > first[:, None])).argmax(1)
        last = np.where((~o & (places[None, :] > first[:, None])).any(1), stop - 1, most - 1)
        mid = np.where(whole[live], last, (first + last) // 2)
        whole[live] = False
        begin = index.starts[live]
        at, end = mid + window - 1, first  # match from the last word of window mid to the first word of window first
        symbol = flat[begin + at]
        lo, hi = index.c[symbol].copy(), index.c[symbol + 1].copy()
        good = index.count(lo, hi) >= 2
        fail = np.where(good, -1, at)
        run = np.flatnonzero(good & (at > end))
        pos = at.copy()
        while len(run):
            pos[run] -= 1
            lo2, hi2 = index.extend(flat[begin[run] + pos[run]], lo[run], hi[run])
            ok = index.count(lo2, hi2) >= 2
            lo[run], hi[run] = lo2, hi2
            fail[run[~ok]] = pos[run[~ok]]
            run = run[ok]
            run = run[pos[run] > end[run]]
        # Words (fail, end of mid] repeat: so do windows in there. Windows that hold the word fail and the last don't.
        p = places[None, :]
        f, m, a = fail[:, None], mid[:, None], first[:, None]
        hit = (p >= np.maximum(a, f + 1)) & (p <= m)
        miss = (f >= 0) & (p >= np.maximum(a, m)) & (p <= f)
        found[live] |= hit & open_[live]
        open_[live] &= ~(hit | miss)


# --- over a corpus ----------------------------------------------------------------------------------------------------


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = []
        for t in b.column(0).to_pylist():
            h = word_hashes(t)
            if len(h) >= WINDOW:
                place, g = anchors(h)
                got.append(g[place[segments(place)[0]]])
        if got:
            h, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _pieces(h: np.ndarray, known: np.ndarray | None, hot: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, ...] | None:
    """A text's segments whose anchor repeats: route, id, first window and number of windows of each. known: sorted
    anchors, or None with ``at``: the first windows of the segments to take."""
    place, g = anchors(h)
    first, count = segments(place)
    a = g[place[first]]
    if known is None:
        pick = np.flatnonzero(np.isin(first, at))
    else:
        pick = np.flatnonzero(known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a) if len(known) else first[:0]
    if not len(pick):
        return None
    route, start, m = a[pick], first[pick], count[pick]
    spot = place[start]
    if len(hot) and (many := np.isin(route, hot)).any():
        each = np.where(many, m, 1)
        row = np.repeat(np.arange(len(pick)), each)
        step = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        many, spot = many[row], spot[row]
        start, m = start[row] + step, np.where(many, 1, m[row])
        ends = mix64(mix64(mix64(route[row] ^ (spot - start).astype(np.uint64)) ^ g[start]) ^ g[start + WINDOW - ANCHOR])
        route = np.where(many, ends, route[row])
    # A segment's id: its words, and the anchor's place in it.
    sid = polynomial_runs(h, start, start + m + WINDOW - 1) ^ (spot - start).astype(np.uint64)
    return route, sid, start, m


def _emit(rows: Iterator[tuple[bytes, np.ndarray, np.ndarray | None, np.ndarray]], known: np.ndarray | None, with_words: bool) -> Iterator[pa.RecordBatch]:
    """With words: the segments, each once with its number (as far as memory goes; sums later do the rest). Else where
    each text has which."""
    seen: dict[tuple[int, int], list] = {}
    out: list[tuple[bytes, tuple[np.ndarray, ...]]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        if with_words:
            keys = np.array(list(seen), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.binary())], ["route", "sid", "n", "words"])
        rep = pa.array(np.repeat(np.arange(len(out)), [len(x[0]) for _, x in out]) if out else np.zeros(0, np.int64))
        cols = [np.concatenate([x[i] for _, x in out]) if out else np.zeros(0, np.uint64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()).take(rep), pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32))], ["k", "route", "sid", "start"])

    for k, h, at, hot in rows:
        got = _pieces(h, known, hot, at)
        if got is None:
            continue
        if with_words:
            for key, start, m in zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), got[3].tolist(), strict=True):
                one = seen.get(key)
                if one:
                    one[0] += 1
                else:
                    seen[key] = [1, h[start : start + m + WINDOW - 1].tobytes()]
            held = len(seen)
        else:
            out.append((k, got))
            held += len(got[0])
        if held > 60_000:
            yield flush()
            seen.clear()
            out.clear()
            held = 0
    yield flush()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, sid, n, words), sorted by route and sid -> route, sid, mask: bit i says that the segment's window i is repeated."""
    held: list[tuple[int, int, int, np.ndarray]] = []
    total = 0

    def run() -> pa.RecordBatch:
        hits = repeated([x[3] for x in held], np.array([x[2] for x in held], np.int64)) if held else np.zeros((0, 1), bool)
        mask = (hits.astype(np.int64) << np.arange(hits.shape[1])[None, :]).sum(1)
        some = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.int64()), pa.array([held[i][1] for i in some], pa.int64()), pa.array(mask[some])], ["route", "sid", "mask"])

    for b in batches:
        for route, sid, n, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][0] == route and held[-1][1] == sid:  # as other tasks counted it
                held[-1] = (route, sid, held[-1][2] + n, held[-1][3])
                continue
            if total >= SHARD_WORDS and route != held[-1][0]:
                yield run()
                held, total = [], 0
            held.append((route, sid, n, np.frombuffer(words, np.uint64)))
            total += len(words) // 8
    yield run()


def passages(docs: DataFrame, max_broadcast: int = MAX_BROADCAST, hot: int = HOT) -> DataFrame:
    """(text) -> k (text key), spans: the places of the repeated windows' runs in each text that has any, as start (first
    window's first word) and mask (bit i: the window i words on)."""
    texts = docs.select("text").where(F.col("text").isNotNull())
    anchor_n = texts.mapInArrow(_count_anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    anchor_n = cut(anchor_n)
    n = anchor_n.count()
    keyed = texts.select(text_key(F.col("text")).alias("k"), "text")
    if n <= max_broadcast:
        held = anchor_n.select("h", (F.col("n") > hot).alias("hot")).toArrow()
        known = np.array(held.column("h").combine_chunks() if n else [], np.int64).view(np.uint64)
        hots = known[np.array(held.column("hot").combine_chunks() if n else [], bool)]
        shared = docs.sparkSession.sparkContext.broadcast((np.sort(known), np.sort(hots)))

        def pieces(with_words: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known, hots = shared.value
                rows = ((k, h, None, hots) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(h := word_hashes(t)) >= WINDOW)
                yield from _emit(rows, known, with_words)

            return run

        source = keyed
    else:
        # Where anchors that repeat are, by text, and which of them are hot; then the texts that have any, once each.
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ks, hs, fs = [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    h = word_hashes(t)
                    if len(h) >= WINDOW:
                        place, g = anchors(h)
                        first = segments(place)[0]
                        ks += [k] * len(first)
                        hs.append(g[place[first]].view(np.int64))
                        fs.append(first)
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(np.concatenate(fs) if fs else [], pa.int32())], ["k", "h", "at"])

        # An anchor's places are dealt over SALTS parts.
        repeats = anchor_n.withColumns({"hot": F.col("n") > hot, "salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))}).select("h", "salt", "hot")
        where = keyed.mapInArrow(places, "k binary, h long, at int").withColumn("salt", F.pmod(F.hash("k"), F.lit(SALTS))).join(repeats, ["h", "salt"]).groupBy("k").agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
        source = keyed.join(where, "k").select("k", "text", "at", "hot")

        def pieces(with_words: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = ((k, word_hashes(t), np.array(at), np.array(hot, np.int64).view(np.uint64)) for b in batches for k, t, at, hot in zip(*(c.to_pylist() for c in b.columns), strict=True))
                yield from _emit(rows, None, with_words)

            return run

    counted = source.mapInArrow(pieces(True), "route long, sid long, n long, words binary")
    found = counted.repartition("route").sortWithinPartitions("route", "sid").mapInArrow(_search, "route long, sid long, mask long")
    mine = source.mapInArrow(pieces(False), "k binary, route long, sid long, start int").distinct()
    return mine.join(found, ["route", "sid"]).groupBy("k").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


REMOVED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words the repeated windows cover."""
    turn = np.zeros(n + 1, np.int64)
    for start, mask in spans:
        while mask:
            i = (mask & -mask).bit_length() - 1
            run = ((~(mask >> i)) & -(~(mask >> i))).bit_length() - 1
            turn[start + i] += 1
            turn[start + i + run - 1 + WINDOW] -= 1
            mask &= mask - (1 << i) if run == 1 else ~(((1 << run) - 1) << i)
    return np.cumsum(turn)[:-1] > 0


def without(text: Column, spans: Column, digest: bool = False) -> Column:
    """A struct of n_words, n_removed and kept: the words kept, joined by one space (their SHA-256 if digest)."""

    @F.arrow_udf(REMOVED)
    def run(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        ns, rs, ks = [], [], []
        for t, sp in zip(texts.to_pylist(), spans_.to_pylist(), strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            gone = 0
            if sp:
                out = covered(len(words), [(s["start"], s["mask"]) for s in sp])
                gone = int(out.sum())
            kept = b" ".join(words if not gone else [w for w, g in zip(words, out.tolist(), strict=True) if not g])
            ns.append(len(words))
            rs.append(gone)
            ks.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
        return pa.StructArray.from_arrays([pa.array(ns, pa.int64()), pa.array(rs, pa.int64()), pa.array(ks, pa.string())], ["n_words", "n_removed", "kept"])

    return run(text, spans)


def deduplicated(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Add ``__kept`` (see without) to a table with a text column. The texts move once."""
    both = docs.withColumn("__k", text_key(F.col("text"))).join(passages(docs).toDF("__k", "__spans"), "__k", "left")
    return both.withColumn("__kept", without(F.col("text"), F.col("__spans"), digest)).drop("__k", "__spans")


def op2(docs: DataFrame) -> DataFrame:
    got = deduplicated(docs.select("doc_id", "text"), digest=True)
    return got.select("doc_id", "__kept.n_words", "__kept.n_removed", F.col("__kept.kept").alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, hash(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep),
kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS s FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
