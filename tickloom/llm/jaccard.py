"""Jaccard join of word shingles by chosen paths.

A text's set is its distinct five-word shingles; texts with equal sets are one
class from the start. Each set is embedded as COORDS min-hash tokens, of which
two sets share about as many as their likeness says. A run starts all sets at
one node; at a node each token is chosen with probability 1 / (likeness *
COORDS), the same choice for all sets there, and a set goes on to the children
of the chosen tokens it has. So near sets stay together in about one child a
level while others part. Nodes of at most LIMIT sets are leaves; leaves (and what
is left at the last level, ``depth_for`` the largest node) are compared by brute
force on the tokens' low bytes. ``runs_for`` says how many runs reach the target
recall.

Leaves yield candidate groups (connected by tokens shared), linear in their rows.
Then each group's sets are compared exactly, once: every link of likeness 0.8 or
more counts, and links make the classes. Groups and leaves over BLOCK sets are
dealt as pairs of blocks, so a task holds two blocks at most and nothing is
capped; no pairs are written out. A group's blocks are cut by set size first, and
only blocks of sizes that can be near meet. What is left of the quadratic cost is
that of n different sets of about one size in one group.

Defined results: null texts and texts without words have no shingles, no links,
and stay single; texts of one to four words have one shingle. Repeated rows are
copies. class_id is the least doc_id of a class (null only if all are). Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import components, cut, mix64, run_hashes, text_key, word_hashes

SHINGLE = 5
LIKE = 0.8
COORDS = 64
#: Levels of the recursion while no node has over DEEPER * LIMIT sets; each tenfold more asks for another.
DEPTH = 4
DEEPER = 1_000
LIMIT = 1500
BLOCK = 500
RECALL = 0.999
#: Sets with candidates whose keys may be broadcast, at about 80 bytes each; more are joined by shuffle.
MAX_BROADCAST = 500_000
#: Share of tokens from which a leaf's pair is a candidate: five standard deviations under LIKE.
TOKENS_LIKE = LIKE - 5 * math.sqrt(LIKE * (1 - LIKE) / COORDS)
_A = (mix64(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(1001, 1001 + COORDS, dtype=np.uint64)).astype(np.uint32)


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair of likeness LIKE is in a common leaf with this probability: it survives a level's branching with
    q' = 1 - exp(-q), the chance of a critical branching process."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def depth_for(largest: int) -> int:
    return DEPTH + max(0, math.ceil(math.log10(max(largest, 1) / (DEEPER * LIMIT))))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text's words, sorted."""
    return np.unique(run_hashes(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The min-hash token of each coordinate."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = _A[:, None] * low[None, i : i + 2048] + _B[:, None]
        part ^= part >> np.uint32(15)
        out = np.minimum(out, part.min(1))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys, texts = (b.column(i) for i in range(3))
        sets, toks, lows, ns = [], [], [], []
        for t in texts.to_pylist():
            s = shingle_set(word_hashes(t))
            # Two different sums of the hashes stand for the set.
            sets.append(np.array([mix64(s).sum(), mix64(s ^ np.uint64(0xABCDEF0123456789)).sum()], np.uint64).tobytes() if len(s) else None)
            tok = tokens(s)
            toks.append(tok.tobytes() if len(s) else None)
            lows.append(tok.astype(np.uint8).tobytes() if len(s) else None)
            ns.append(len(s))
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(sets, pa.binary()), pa.array(toks, pa.binary()), pa.array(lows, pa.binary()), pa.array(ns, pa.int32())], ["doc_id", "k", "set_key", "tokens", "low", "n"])


def _chosen(path: np.ndarray) -> np.ndarray:
    """Which tokens each node chooses: a boolean row for each path, from the path alone."""
    u = mix64(path[:, None] ^ mix64(np.arange(COORDS, dtype=np.uint64) + np.uint64(77))[None, :])
    return u < np.uint64(int(2**64 / (LIKE * COORDS)))


def _descend(batches: Iterator[pa.RecordBatch], first: int, runs: int, depth: int) -> Iterator[pa.RecordBatch]:
    """(rid, tokens) -> the nodes that each set comes to in these runs: rid, path, parent, depth."""
    roots = mix64(np.arange(5000 + first, 5000 + runs, dtype=np.uint64))
    for b in batches:
        for at_ in range(0, b.num_rows, 256):  # a node's choices are COORDS numbers: a few sets at a time
            some = b.slice(at_, 256)
            rid = np.asarray(some.column(0))
            tok = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
            row, path = np.repeat(np.arange(len(rid)), len(roots)), np.tile(roots, len(rid))
            for d in range(1, depth + 1):
                at, c = np.nonzero(_chosen(path))
                parent, row = path[at], row[at]
                path = mix64(parent ^ mix64(tok[row, c].astype(np.uint64) << np.uint64(8) | c.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(path.view(np.int64)), pa.array(parent.view(np.int64)), pa.array(np.full(len(row), d, np.int32))], ["rid", "path", "parent", "depth"])


def _dealt(rows: DataFrame, key: str, size: str, rid: str, block: int) -> DataFrame:
    """Groups over ``block`` rows as pairs of blocks: each row goes to every pair that its block is in. Adds part (unique
    in its group) and side (0: first block, 1: second; 0 where the pair is one block)."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(rid)), blocks.cast("long")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("side")))
    many = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct((F.least(o, F.col("__own")) * blocks + F.greatest(o, F.col("__own"))).alias("part"), F.when(o < F.col("__own"), 1).otherwise(0).alias("side")))
    return rows.withColumn("__own", own).withColumn("__p", F.explode(F.when(blocks <= 1, one).otherwise(many))).withColumns({"part": F.col("__p.part"), "side": F.col("__p.side")}).drop("__p", "__own")


def _block(band: Column, i: Column) -> Column:
    return F.shiftleft(band.cast("long"), 32) + i


def _banded(sets: DataFrame, block: int) -> DataFrame:
    """(g, rid, n, ...): adds size (of the group), mine (the set's block) and blocks (how many each band has). Two sets of
    likeness LIKE differ in size by a factor of 1 / LIKE at most, so they are in one band or in neighbouring ones."""
    rows = sets.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / LIKE + 1e-9)).cast("int"))
    counts = rows.groupBy("g", "band").agg(F.count("*").alias("c")).groupBy("g").agg(F.sum("c").alias("size"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("c") / F.lit(block)).cast("int")))).alias("blocks"))
    return rows.join(counts, "g").withColumn("mine", _block(F.col("band"), F.pmod(F.xxhash64("rid"), F.element_at("blocks", F.col("band")).cast("long"))))


def _paired(rows: DataFrame, block: int) -> DataFrame:
    """Rows that _banded gave -> one for each pair of blocks that can have links: adds lo, hi (the pair) and side (1: of hi)."""
    near = F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("blocks", b))
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.element_at("blocks", b) - 1), lambda i: _block(b, i))))
    pairs = F.transform(others, lambda o: F.struct(F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi"), (o < F.col("mine")).cast("int").alias("side")))
    zero = F.lit(0).cast("long")
    one = F.array(F.struct(zero.alias("lo"), zero.alias("hi"), F.lit(0).alias("side")))
    return rows.withColumn("p", F.explode(F.when(F.col("size") <= block, one).otherwise(pairs))).select("*", "p.lo", "p.hi", "p.side")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first n_keys columns -> the groups' tables, each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(n_keys)])
        starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [b.num_rows]))
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            key = tuple(keys[:, i].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _roots(near: np.ndarray) -> np.ndarray:
    """The least index of each row's component, of a boolean likeness matrix."""
    root = np.arange(len(near))
    open_ = np.ones(len(near), bool)
    for i in range(len(near)):
        if open_[i]:
            seen = near[i].copy()
            seen[i] = True
            edge = seen.copy()
            while edge.any():
                reach = near[edge].any(0) & ~seen
                seen |= reach
                edge = reach
            root[seen] = i
            open_ &= ~seen
    return root


def _leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, part, side, rid, low bytes of the tokens), sorted -> edges from each row to its component's first row."""
    a, b_ = [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    for t in _groups(batches, 2):
        if t.num_rows < 2:
            continue
        rid = t.column(3).to_numpy()
        tok = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(-1, COORDS)
        same = np.zeros((len(rid), len(rid)), np.uint8)
        for c in range(COORDS):
            same += tok[:, c][:, None] == tok[:, c][None, :]
        near = same >= TOKENS_LIKE * COORDS
        root = _roots(near)
        moved = root != np.arange(len(rid))
        side = t.column(2).to_numpy()
        if side.any():  # a pair of blocks: what a block links in itself it links where it meets itself
            own = _roots(near & (side[:, None] == side[None, :]))
            moved &= own == np.arange(len(rid))
        a += rid[moved].tolist()
        b_ += rid[root[moved]].tolist()
        if len(a) > 50_000:
            yield out()
            a.clear()
            b_.clear()
    yield out()


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[sizes[0], both], [both, sizes[1]]])
    ids, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    # Shingles of one set only count for nothing but that set.
    n = np.bincount(col, minlength=len(ids))
    keep = n[col] > 1
    row, col = row[keep], (np.cumsum(n > 1) - 1)[col[keep]]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(1, (8 << 20) // m)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        block = np.zeros((m, width), np.float32)
        block[row[i:j], col[i:j] - lo] = 1
        out += block @ block.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, lo, hi, side, rid, text), sorted -> rid, root (least rid linked here), n_links (each pair once over all parts)."""
    got: list[tuple[int, int, int]] = []
    for t in _groups(batches, 3):
        rid, first = np.unique(t.column(4).to_numpy(), return_index=True)
        side = t.column(3).to_numpy()[first]
        texts = t.column(5).take(pa.array(first)).to_pylist()
        sets = [shingle_set(word_hashes(x)) for x in texts]
        if len(rid) < 2:
            got += [(int(r), int(r), 0) for r in rid]
            continue
        both = shared(sets)
        sizes = np.diag(both)
        near = both >= LIKE * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(near, False)
        if side.any():  # a pair of blocks: pairs within a block count where the block meets itself
            near &= side[:, None] != side[None, :]
        root = rid[_roots(near)]
        got += list(zip(rid.tolist(), root.tolist(), near.sum(1).tolist(), strict=True))
        if len(got) > 50_000:
            yield _links(got)
            got = []
    yield _links(got)


def _links(got: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(3)], ["rid", "root", "n_links"])


def _candidates(sets: DataFrame, recall: float) -> DataFrame:
    """(rid, tokens, low) -> edges between sets that share a leaf and enough tokens.

    Pairs that a leaf of the first level can show need few runs. Only sets that come to a larger node there go on, with
    all runs that its levels ask for: a pair whose common nodes are all large has both of its sets among them. What is
    shuffled by node is the node and the set's number.
    """
    nodes = "rid long, path long, parent long, depth int"
    few = runs_for(recall, 1)
    level = sets.select("rid", "tokens").mapInArrow(lambda b: _descend(b, 0, few, 1), nodes).select("rid", "path")
    counts = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    level = cut(level.join(counts, "path"))
    leaves = level.where(F.col("n") <= LIMIT)
    large = level.where(F.col("n") > LIMIT).select("rid").distinct()
    largest = counts.agg(F.max("n")).first()[0] or 0
    if largest > LIMIT:
        some, levels = sets.join(large, "rid").select("rid", "tokens"), depth_for(largest)
        tree = cut(some.mapInArrow(lambda b: _descend(b, 0, runs_for(recall, levels), levels), nodes))
        for depth in range(1, levels + 1):
            level = tree.where(F.col("depth") == depth)
            if depth > 1:
                level = cut(level.join(counts.where(F.col("n") > LIMIT).select(F.col("path").alias("parent")), "parent").select("rid", "path"))
            counts = cut(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
            wanted = counts if depth == levels else counts.where(F.col("n") <= LIMIT)
            leaves = leaves.unionByName(level.join(wanted, "path").select("rid", "path", "n"))
    rows = leaves.select("path", "rid", "n").join(sets.select("rid", "low"), "rid")
    rows = _dealt(rows, "path", "n", "rid", BLOCK).select("path", "part", "side", "rid", "low")
    return rows.repartition("path", "part").sortWithinPartitions("path", "part").mapInArrow(_leaf_links, "a long, b long").distinct()


def joined(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, text) -> a row per document: doc_id, k (text key), class_id, set_id, n_links, n_copies, first (the row that
    stands for its class; fully repeated rows share it)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k"), "text")
    feats = cut(rows.mapInArrow(_features, "doc_id long, k binary, set_key binary, tokens binary, low binary, n int"))
    full = feats.where(F.col("n") > 0)
    sets = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "k")).alias("r"), F.min("tokens").alias("tokens"), F.min("low").alias("low"), F.min("n").alias("n"), F.count("*").alias("n_copies"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("rid"), "set_key", F.col("r.doc_id").alias("set_id"), F.col("r.k").alias("rk"), "tokens", "low", "n", "n_copies"))
    groups = components(_candidates(sets, recall))
    groups = cut(groups.select(F.col("node").alias("rid"), F.col("root").alias("g")))
    wanted = cut(_banded(groups.join(sets.select("rid", "set_id", "rk", "n"), "rid"), BLOCK))
    # Only the texts that stand for a set with candidates move (of fully repeated rows one; hot groups once for each pair of blocks).
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["set_id"]) & (rows["k"] == wanted["rk"])).select("g", "rid", "band", "mine", "blocks", "size", "text")
    parts = _paired(texts.dropDuplicates(["rid"]), BLOCK).select("g", "lo", "hi", "side", "rid", "text")
    links = cut(parts.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(_exact_links, "rid long, root long, n_links long"))
    counted = links.groupBy("rid").agg(F.sum("n_links").alias("n_links"))
    classes = components(links.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    member = sets.join(classes.withColumnRenamed("node", "rid"), "rid", "left").join(counted, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    heads = member.groupBy("root").agg(F.min(F.struct("set_id", "rk")).alias("head"))
    member = member.join(heads, "root").select("set_key", "set_id", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = feats.select("doc_id", "k", "set_key").join(member, "set_key", "left")
    first = F.col("head").isNull() | (F.col("doc_id").eqNullSafe(F.col("head.set_id")) & F.col("k").eqNullSafe(F.col("head.rk")))
    return out.select("doc_id", "k", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.set_id")).alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), first.alias("first"))


def op7(docs: DataFrame) -> DataFrame:
    return joined(docs.select("doc_id", "text")).select("doc_id", "class_id", "set_id", "n_links", "n_copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; texts without words stay."""
    first = joined(docs).where("first").groupBy(F.col("doc_id").alias("__d"), F.col("k").alias("__k")).agg(F.count("*").alias("__n"))
    left = docs.withColumn("__key", text_key(F.col("text"))).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & F.col("__key").eqNullSafe(F.col("__k")))
    # Fully repeated rows are copies too; only these need to meet.
    once = left.where("__n = 1").select(docs.columns)
    return once.unionByName(left.where("__n > 1").dropDuplicates(["__d", "__k"]).select(docs.columns))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), keyed AS (
  SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY r
), sets AS MATERIALIZED (
  SELECT k, min(doc_id) AS set_id, min(r) AS r, any_value(n) AS n, count(*) AS copies FROM keyed JOIN d USING (r) GROUP BY k
), rs AS MATERIALIZED (SELECT sets.k, s FROM sh JOIN sets USING (r)),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.k AS a, y.k AS b, count(*) AS c FROM rs x JOIN rs y ON x.s = y.s AND x.k <> y.k GROUP BY 1, 2) p
  JOIN sets u ON u.k = p.a JOIN sets v ON v.k = p.b WHERE p.c >= 0.8 * (u.n + v.n - p.c)
), reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT s.k, least(s.set_id, min(t.set_id)) AS class_id FROM sets s LEFT JOIN reach ON reach.a = s.k LEFT JOIN sets t ON t.k = reach.b GROUP BY s.k, s.set_id),
cnt AS (SELECT a AS k, count(*) AS n_links FROM link GROUP BY 1)
SELECT d.doc_id, coalesce(root.class_id, d.doc_id) AS class_id, coalesce(sets.set_id, d.doc_id) AS set_id, CAST(coalesce(cnt.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(sets.copies, 1) AS BIGINT) AS n_copies
FROM d LEFT JOIN keyed USING (r) LEFT JOIN sets ON sets.k = keyed.k LEFT JOIN root ON root.k = keyed.k LEFT JOIN cnt ON cnt.k = keyed.k
"""
