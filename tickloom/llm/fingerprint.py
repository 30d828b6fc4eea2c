"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's five-word shingles. Sketches of parts merge into the sketch of the whole
set, and pairs of sketches estimate resemblance, containment and the number of
distinct shingles.

Defined results: words are runs without ASCII white space; a text of one to
four words has one shingle, all its words; null and empty texts have an empty
sketch; two empty sketches have resemblance 1, an empty and another 0. Long
texts are hashed whole. Repeated rows stay. Rows follow in order of doc_id
(nulls first), equal ids by text (nulls first); the last is followed by the
first, a single row by itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
K = 128
#: next_rows cuts the ids into ranges of about this many rows, MAX_RANGES at most (each then holds more, and spills).
RANGE_ROWS = 2_000
MAX_RANGES = 20_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words_: Column, n: int = SHINGLE) -> Column:
    """The 64-bit hash of each run of n words; of all words if there are fewer. Repeats stay."""
    hashed = F.transform(words_, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        last = F.size(h) - n + 1
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(last < 1, F.array(F.xxhash64(h))).otherwise(runs)

    # One element: the hashes are made once, not anew at each place that names them.
    return F.element_at(F.transform(F.array(hashed), of), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom_k(shingle_hashes(words(text)), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, keys: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """Merge the sketches of parts by key. Hashes are de-duplicated and ranked before and after the shuffle, so that no
    group is gathered: parts are first merged in 64 salted groups of a key, then these groups' sketches."""
    salted = parts.select(*keys, F.explode_outer(col).alias("h"), F.pmod(F.xxhash64(F.col(col)), F.lit(64)).alias("salt"))
    some = salted.groupBy(*keys, "salt", "h").agg(F.lit(1).alias("one"))
    w = Window.partitionBy(*keys, "salt").orderBy("h")
    some = some.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) | F.col("h").isNull())
    return some.groupBy(*keys).agg(F.slice(F.sort_array(F.array_distinct(F.collect_list("h"))), 1, k).alias(col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: of the union's k smallest hashes, the share that both sketches have."""
    union = merge(a, b, k)
    both = F.array_intersect(F.array_intersect(union, a), b)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: resemblance times the union's size over a's, 1 at most."""
    size = distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / size))


def as_text(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, F.hex), ",")


def _ranges(docs: DataFrame) -> Column:
    """A number for each row, rising with doc_id, that splits the rows evenly; nulls have 0."""
    n, lo, hi = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    parts = min(MAX_RANGES, n // RANGE_ROWS + 1)
    if parts == 1 or lo == hi:
        return F.lit(0)
    at = [i / parts for i in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 20 * parts).alias("q")).first()["q"]))
    # A look in two short arrays instead of one in a long one.
    side = max(1, int(len(bounds) ** 0.5))
    spans = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    far = F.size(F.filter(F.array(*[F.lit(s[0]) for s in spans]), lambda x: x <= F.col("doc_id")))
    near = F.get(F.array(*[F.array(*[F.lit(x) for x in s]) for s in spans]), F.greatest(far - 1, F.lit(0)))
    return F.when(F.col("doc_id").isNull() | (far == 0), 0).otherwise((far - 1) * side + F.size(F.filter(near, lambda x: x <= F.col("doc_id"))))


def next_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, text, next_text: the next row's text in order of (doc_id, text), the first after the last.

    The ids are cut into ranges, each a window of its own. The first row of each
    range also stands, marked, behind the last row of the range before, so one
    shuffle of the texts does. Only ids, as many as ranges, reach the driver.
    """
    docs = docs.select("doc_id", "text").withColumn("__range", _ranges(docs.select("doc_id")).cast("int")).withColumn("__mark", F.lit(0))
    firsts = [(r["__range"], r["d"]["doc_id"]) for r in docs.groupBy("__range").agg(F.min(F.struct("doc_id")).alias("d")).orderBy("__range").collect()]
    if not firsts:
        return docs.select("doc_id", "text", F.col("text").alias("next_text"))
    before = docs.sparkSession.createDataFrame([(c, firsts[i - 1][0], d) for i, (c, d) in enumerate(firsts)], "__range int, __before int, __first long")
    heads = docs.join(F.broadcast(before), "__range").where(F.col("doc_id").eqNullSafe(F.col("__first"))).groupBy("__before").agg(F.min(F.struct(F.col("text").isNotNull().alias("full"), "text")).alias("t"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("t.text").alias("text"), F.col("__before").alias("__range"), F.lit(1).alias("__mark"))
    w = Window.partitionBy("__range").orderBy("__mark", "doc_id", "text")
    return docs.unionByName(heads).withColumn("next_text", F.lead("text").over(w)).where(F.col("__mark") == 0).select("doc_id", "text", "next_text")


def op9(docs: DataFrame) -> DataFrame:
    """The fingerprint query: every text, its edited text, and their likeness."""
    rows = next_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), sketch(F.col("next_text")).alias("c"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("c")).alias("near_next"), F.round(distinct_count(F.col("a"))).cast("long").alias("n_shingles"), containment(F.col("a"), F.col("b")).alias("kept_share"))
