"""Token counts by section: a document is encoded once, its tokens are attributed by their offsets.

A byte-level BPE's tokens are pieces of the text's UTF-8 bytes in order, so the
running sum of their lengths maps each token to its span of bytes. Sections (or
the fields that a document is put together from) are spans too, and tokens join
them by interval. A token that crosses a boundary is allocated by one rule:

    start    to the section that holds its first byte
    largest  to the section that holds most of its bytes, the earlier on a tie
    split    to each section by its share of the bytes

Tokens outside all sections (separators) count as ``unassigned``; sections'
counts and unassigned sum to the document's tokens. Where no spans are given,
each line with its line feed is a section.

Defined results: null texts have no tokens and no sections, empty texts no
tokens and no lines (an empty span given counts 0). Spans are in code points,
sorted, and must not overlap; null spans mean lines. Repeated rows and other
columns stay. The vocabulary is read by the driver and broadcast
(MAX_VOCABULARY bytes at most).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64 << 20
#: Fixed value: how the vocabulary's training cut texts into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "largest", "split")
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.DoubleType())), T.StructField("crossing", T.LongType()), T.StructField("unassigned", T.DoubleType())])
SPANS = "array<struct<start:int,end:int>>"


class Counter:
    """Made once in each Python worker."""

    def __init__(self, vocabulary: bytes, rule: str):
        if rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("sections", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, i in ranks.items():
            self.lengths[i] = len(b)
        self.rule = rule

    def offsets(self, text: str) -> np.ndarray:
        """Where each token begins, in bytes, and at last where the text ends."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def one(self, text: str | None, spans: list[tuple[int, int]] | None) -> tuple[int, np.ndarray, int, float]:
        if text is None:
            return 0, np.zeros(0), 0, 0.0
        text = text.encode("utf-8", "replace").decode()
        raw = np.frombuffer(text.encode(), np.uint8)
        if spans is None:
            ends = np.flatnonzero(raw == 10) + 1
            if len(raw) and (not len(ends) or ends[-1] < len(raw)):
                ends = np.append(ends, len(raw))
            begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        else:
            chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            begins, ends = (chars[np.clip([s[k] for s in spans], 0, len(chars) - 1).astype(int)] if spans else np.zeros(0, int) for k in (0, 1))
        at = self.offsets(text)
        return len(at) - 1, *attribute(at[:-1], at[1:], begins, ends, self.rule)


def attribute(starts: np.ndarray, stops: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, float]:
    """Tokens [start, stop) over sections [begin, end): the sections' counts, how many tokens cross, what has no section."""
    n = len(begins)
    if not n or not len(starts):
        return np.zeros(n), 0, float(len(starts))
    # Sections and what lies between them, as one cover without gaps: gap 0, section 0, gap 1, ...
    edges = np.empty(2 * n + 1, np.int64)
    edges[0], edges[1::2], edges[2::2] = 0, begins, ends
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, stops - 1, "right") - 1
    whole = np.zeros(2 * n + 1)
    over = first != last
    np.add.at(whole, first if rule == "start" else first[~over], 1.0)
    crossing = 0
    limits = np.append(edges, max(int(stops[-1]), int(edges[-1])) + 1)
    for t in np.flatnonzero(over):
        a, b = int(first[t]), int(last[t])
        cells = np.arange(a, b + 1)
        share = np.minimum(limits[cells + 1], stops[t]) - np.maximum(limits[cells], starts[t])
        crossing += int((share > 0).sum() > 1)
        if rule == "largest":
            whole[cells[int(np.argmax(share))]] += 1
        elif rule == "split":
            whole[cells] += share / share.sum()
    return whole[1::2], crossing, float(whole[0::2].sum())


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of over {MAX_VOCABULARY} bytes")
    return data


def section_tokens(spark: SparkSession, text: Column, spans: Column | None = None, rule: str = "start", path: str = VOCABULARY) -> Column:
    """A struct of n_tokens, tokens (one count per section), crossing and unassigned for each text."""
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    def made(batches: Iterator, both: bool) -> Iterator[pa.Array]:
        c = Counter(vocabulary.value, rule)
        for batch in batches:
            texts, limits = (batch[0].to_pylist(), batch[1].to_pylist()) if both else (batch.to_pylist(), None)
            rows = [c.one(t, None if limits is None or limits[i] is None else [(s["start"], s["end"]) for s in limits[i]]) for i, t in enumerate(texts)]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.float64()))], ["n_tokens", "tokens", "crossing", "unassigned"])

    @F.arrow_udf(RESULT)
    def lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from made(batches, False)

    @F.arrow_udf(RESULT)
    def given(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from made(batches, True)

    return lines(text) if spans is None else given(text, spans)


def joined_fields(fields: list[str], sep: str = "\n") -> tuple[Column, Column]:
    """A document put together from columns (null: empty), and the spans of its fields in it."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, spans = F.lit(0), []
    for p in parts:
        end = at + F.length(p)
        spans.append(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(sep)
    return F.concat_ws(sep, *parts), F.array(*spans).cast(SPANS)


def op8(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Tokens of every document by line: doc_id, n_tokens, n_sections, largest_section, crossing, section_tokens."""
    got = docs.select("doc_id", section_tokens(docs.sparkSession, F.col("text"), rule="start", path=path).alias("x"))
    return got.select("doc_id", "x.n_tokens", F.size("x.tokens").cast("long").alias("n_sections"), F.coalesce(F.array_max("x.tokens"), F.lit(0.0)).cast("long").alias("largest_section"), "x.crossing", F.transform("x.tokens", lambda t: t.cast("long")).alias("section_tokens"))
