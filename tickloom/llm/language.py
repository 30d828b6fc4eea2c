"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary of its most frequent words, the most
frequent last, as counted over all training texts (of equal counts those of the
least hashes). A text, cut into blocks, is encoded once with each dictionary; the language whose
dictionary gives the fewest bytes is chosen. Texts are first lower-cased and
stripped of ASCII digits and punctuation, which say nothing of the language.

Equal sizes are settled by how many of the text's words the dictionaries hold,
then by the languages' shares. ``margin`` is by how much the second choice is
larger, as a share of the best; a text is rejected where it isn't over
``min_margin``, or, at margin 0, where the words held don't settle it either.
``min_margin`` is calibrated on all training rows, each told by a fit that leaves its
part out: under it lie at most MAX_LOST of the rightly told texts, by their exact
quantile. Under CAL_LEAST such rows it is 0.

Bounds of a model: DICT_BYTES for each language, MODEL_BYTES for all, so many
languages have shorter dictionaries. No bound holds for what is counted: every word
of every training text is; words over PIECE_CHARS characters count in pieces of that.
Over ``max_langs`` values of lang raise an error: a column like that holds no
languages. Prediction encodes whole texts, of any length, block by block.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; with no training rows everything is ``und``. Repeated rows and
other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.order import exact_quantile
from tickloom.llm.common import cut

DICT_BYTES = 262_144
MODEL_BYTES = 64 << 20
PIECE_CHARS = 32
#: Different words that a task counts before it passes the counts on.
HELD_WORDS = 300_000
MAX_LANGS = 2_000
LEVEL = 6
BLOCK = 2_048
#: The share of rightly told texts that calibration may lose, the rows that it needs, and the parts that it leaves out in turn.
MAX_LOST = 0.005
CAL_LEAST = 100
FOLDS = 5
#: Bits of margin that count as much as one bit of evidence; the blocks of a text aren't independent.
TEMPER = 0.25
UND = "und"
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

_KEEP = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_DROP = bytes(c for c in range(128) if not chr(c).isalpha() and c not in b" \t\n\r\x0b\x0c")
_LETTER = re.compile(r"[^\W\d_]")


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_KEEP, _DROP)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, part, text) -> lang, part, word, n; a word may come in several rows."""
    held: dict[tuple[str, int], Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, part), counts in held.items():
            for w in [w for w in counts if len(w) > PIECE_CHARS]:
                n, long = counts.pop(w), w.decode()
                for i in range(0, len(long), PIECE_CHARS):
                    counts[long[i : i + PIECE_CHARS].encode()] += n
            m = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([part] * m, pa.int32()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "part", "word", "n"])
        held.clear()

    for b in batches:
        for lang, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held[lang, part].update(normal(text).split())
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from out()
    yield from out()


def _filled(counts: DataFrame, rooms: list[int]) -> dict[tuple[int, str], bytes]:
    """(lang, word, ns: how often each model counts it) -> (model, lang): its most frequent words, in so many bytes.

    No language's words are sorted as a whole: the bytes of each step of counts say how far down a dictionary reaches,
    and of a last step that is larger than a dictionary enough words by hash are taken.
    """
    some = counts.select("lang", "word", F.shiftrightunsigned(F.xxhash64(F.lit(5), "word"), 11).alias("h"), F.posexplode("ns").alias("model", "n")).where("n > 0")
    # Counts under 64 are steps of their own, then 32 steps make an octave.
    some = some.withColumn("step", F.when(F.col("n") < 64, F.col("n")).otherwise(64 + F.floor(32 * F.log2(F.col("n") / 64))))
    room = F.element_at(F.lit(rooms), F.col("model") + 1)
    above = F.sum("bytes").over(Window.partitionBy("model", "lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    steps = some.groupBy("model", "lang", "step").agg(F.sum(F.octet_length("word") + 1).alias("bytes")).withColumn("need", room - F.coalesce(above, F.lit(0))).where("need > 0")
    share = F.when(F.col("bytes") <= room, F.lit(1.0)).otherwise((2 * F.col("need") + 4096) / F.col("bytes"))
    taken = some.join(F.broadcast(steps.select("model", "lang", "step", share.alias("share"))), ["model", "lang", "step"]).where(F.col("h") < F.col("share") * float(1 << 53))
    words = F.array_sort(F.collect_list(F.struct("n", (-F.col("h")).alias("h"), "word")))
    held = taken.groupBy("model", "lang").agg(F.encode(F.concat(F.array_join(F.transform(words, lambda x: x["word"]), " "), F.lit(" ")), "UTF-8").alias("held"))
    out = {}
    for r in held.select("model", "lang", F.substr("held", -room - 1, room + 1).alias("held")).collect():
        d = bytes(r["held"])
        out[r["model"], r["lang"]] = d[d.index(b" ") + 1 :] if len(d) > rooms[r["model"]] else d
    return out


def fits(docs: DataFrame, text: str, lang: str, part: Column | None = None, parts: int = 0, max_langs: int = MAX_LANGS) -> list[list[tuple[str, bytes]]]:
    """Models: those that leave out part 0, 1, ... in turn, and last that of all rows. A model is (language, dictionary) in
    order of the languages' shares. The words of all are counted in one pass."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), (F.lit(0) if part is None else part).cast("int").alias("part"), F.col(text).alias("text"))

    def each(n: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("part") != k, n)), F.lit(0)) for k in range(parts)], F.sum(n)).alias("ns")

    shares = {r["lang"]: r["ns"] for r in known.groupBy("lang").agg(each(F.lit(1))).limit(max_langs + 1).collect()}
    if len(shares) > max_langs:
        raise ValueError(f"over {max_langs} languages")
    langs = [sorted((k for k, ns in shares.items() if ns[i]), key=lambda k: (-shares[k][i], k)) for i in range(parts + 1)]
    if not shares:
        return [[] for _ in langs]
    counts = cut(known.mapInArrow(_tally, "lang string, part int, word string, n long").groupBy("lang", "word").agg(each(F.col("n"))))
    held = _filled(counts, [min(DICT_BYTES, MODEL_BYTES // max(1, len(x))) for x in langs])
    return [[(k, held.get((i, k), b" ")) for k in x] for i, x in enumerate(langs)]


def fit(docs: DataFrame, text: str, lang: str, key: Column | None = None, max_langs: int = MAX_LANGS) -> list[tuple[str, bytes]]:
    """The model of all rows (see fits). key chose rows when a fit took some of them; it has no effect any more."""
    return fits(docs, text, lang, max_langs=max_langs)[-1]


class Classifier:
    """Made once in each Python worker."""

    def __init__(self, model: list[tuple[str, bytes]], min_margin: float):
        self.langs = [k for k, _ in model]
        self.dicts = [b" " + d for _, d in model]
        self.min_margin = min_margin
        self.coders = []
        for _, d in model:
            held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def one(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return UND, 0.0, 0.0, True
        b = normal(text)
        blocks = [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)] or [b""]
        sizes = [sum(len(c.compress(x)) for x in blocks) for c in self.coders]
        best = min(sizes)
        tied = [i for i, s in enumerate(sizes) if s == best]
        held, words = [0] * len(sizes), set()
        if len(tied) > 1:
            words = set(b.split())
            held = [sum(b" " + w + b" " in d for w in words) if i in tied else 0 for i, d in enumerate(self.dicts)]
        top = max(tied, key=lambda i: (held[i], -i))
        rest = [s for i, s in enumerate(sizes) if i != top]
        margin = (min(rest) - best) / best if rest else 1.0
        clear = margin > self.min_margin if margin else sum(held[i] == held[top] for i in tied) == 1 and (not self.min_margin or 2 * held[top] >= len(words))
        score = 1 / sum(math.exp(-min(60.0, TEMPER * (s - best) + 0.5 * (held[top] - held[i] if s == best else 0))) for i, s in enumerate(sizes))
        return self.langs[top], score, margin, not clear


def identify(text: Column, model: list[tuple[str, bytes]], min_margin: float = 0.0) -> Column:
    """A struct of lang, score, margin and rejected for each text."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = Classifier(model, min_margin)
        for batch in batches:
            rows = [c.one(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))], ["lang", "score", "margin", "rejected"])

    return run(text)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def part() -> Column:
    return F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(FOLDS))


def judged(known: DataFrame, models: list[list[tuple[str, bytes]]] | None = None) -> DataFrame:
    """lang, told and margin of every row with a language and a text, each told by what the other FOLDS - 1 parts teach
    (``models``, see fits)."""
    models = fits(known, "text", "lang", part(), FOLDS) if models is None else models
    some = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A scan a part, so that no task holds more than one model.
    parts = [some.where(part() == k).select("lang", identify(F.col("text"), models[k]).alias("x")) for k in range(FOLDS)]
    return reduce(DataFrame.unionAll, parts).select("lang", F.col("x.lang").alias("told"), F.col("x.margin").alias("margin"))


def margin_bound(known: DataFrame, models: list[list[tuple[str, bytes]]] | None = None) -> float:
    """The margin to be over: of all rows' margins (see judged), where rightly told, the one under which MAX_LOST of them lie."""
    # Written down before it is filtered: a filter that is pushed below has every text encoded twice.
    told = cut(judged(known, models)).where("lang = told AND margin > 0").select("margin")
    n = told.count()
    if n < CAL_LEAST:
        return 0.0
    return 0.999 * exact_quantile(told, [], "margin", int(MAX_LOST * n) / (n - 1), "bound").first()["bound"]


def identified(docs: DataFrame, min_margin: float | None = None) -> DataFrame:
    """Add ``__lang`` (see identify) to a documents table, learned from its rows that aren't held out; without a
    ``min_margin`` it is calibrated on them."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    models = fits(known, "text", "lang", part(), FOLDS if min_margin is None else 0)
    bound = margin_bound(known, models) if min_margin is None else min_margin
    return docs.withColumn("__lang", identify(F.col("text"), models[-1], bound))


def op4(docs: DataFrame) -> DataFrame:
    out = identified(docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"), F.col("__lang.margin").alias("margin"), F.col("__lang.rejected").alias("rejected"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the rejected ones go."""
    return identified(docs).where(~F.col("__lang.rejected")).select(docs.columns)
