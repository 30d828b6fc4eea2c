"""Near-duplicates among embeddings: navigable small-world graphs by shard, audited searches, components of links.

Only vectors of one label (and one length) are compared. Equal vectors of a label
are one node that counts as often as it stands in the table. A label's nodes are
dealt over shards of about ``SHARD`` nodes; each shard gets a hierarchical
navigable small-world graph, and each pair of shards of a label is one task: the
nodes of one search the graph of the other, so every shard is asked, and every
pair of nodes has one task that can link it. Within its own shard a search also
starts at the node itself.

A beam that comes back full of links is widened for that query. Then each task
compares an audit sample with the whole shard; where the beams found fewer than
``RECALL`` of the links that the audit has, all of the task's beams are widened
and its searches run again. A beam as wide as ``WIDEST`` gives way to a comparison
with the whole shard, in blocks, so nothing is capped. What the beams hold is
verified in double precision.

A task gives a number of links for each node and, in place of its links, a forest
with the same components, at most a row a node. Forests are joined to components
by alternating stars, links are added up.

Defined results: rows whose label is null, or whose vector is null, empty, all
zero, or has a null or non-finite entry link with nothing. Vectors of different
length don't link. Repeated rows are vectors of their own, with cosine 1. A null
vec_id is counted as any other, but no component takes its name from it as long as
it has another; a row without vec_id is not kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, mix64, salted_join, text_key
from tickloom.sources.store import cut

LIKE = 0.93
#: Nodes of a shard, links of a node above the lowest layer (twice as many on it), beams of building and of searching.
SHARD, LINKS, BUILD_BEAM, BEAM = 16_384, 12, 48, 32
#: Entries of a shard's vectors; longer vectors have smaller shards.
ENTRIES = 1 << 21
#: Beams of this width give way to a full comparison; share of the audit's links that beams must find, and audited queries.
WIDEST, RECALL, AUDIT = 512, 0.99, 1024
#: Queries that a search moves at once, and what single precision may be off by.
BLOCK, SLACK = 256, 1e-4


# --- one shard's graph ------------------------------------------------------------------------------------------------


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; first scaled, so that no square overflows."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _likeness(x: np.ndarray, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", queries[row], x[node])


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries in step: the best ``beam`` nodes of each, nearest first, and their likeness (-1 and
    -inf where there are fewer). A query moves on as long as its beam holds a node whose links it hasn't seen."""
    m, n, step = len(queries), len(links), max(2, beam // 16)
    rows = np.arange(m)
    seen = np.zeros((m, n), bool)
    ids, like, open_ = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
    fresh = starts
    while True:
        row, node = [], []
        for j in range(fresh.shape[1]):  # nodes of one column are of different queries, so none is marked twice
            at = fresh[:, j]
            new = np.flatnonzero(at >= 0)
            new = new[~seen[rows[new], at[new]]]
            seen[rows[new], at[new]] = True
            row.append(new)
            node.append(at[new])
        r, v = np.concatenate(row), np.concatenate(node)
        if len(r):
            s = _likeness(x, queries, rows[r], v)
            order = np.argsort(r, kind="stable")
            r, v, s = r[order], v[order], s[order]
            count = np.bincount(r, minlength=len(rows))
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            wide = beam + int(count.max())
            i2, l2, o2 = np.full((len(rows), wide), -1), np.full((len(rows), wide), -np.inf, np.float32), np.zeros((len(rows), wide), bool)
            i2[:, :beam], l2[:, :beam], o2[:, :beam] = ids[rows], like[rows], open_[rows]
            i2[r, beam + place], l2[r, beam + place], o2[r, beam + place] = v, s, True
            best = np.argpartition(-l2, beam - 1, axis=1)[:, :beam]
            ids[rows], like[rows], open_[rows] = (np.take_along_axis(a, best, 1) for a in (i2, l2, o2))
        on = open_[rows].any(1)
        rows = rows[on]
        if not len(rows):
            break
        waiting = np.where(open_[rows], like[rows], -np.inf)
        k = min(step, beam)
        pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k] if k < beam else np.tile(np.arange(beam), (len(rows), 1))
        real = np.take_along_axis(waiting, pick, 1) > -np.inf
        chosen = np.where(real, np.take_along_axis(ids[rows], pick, 1), -1)
        still = open_[rows]
        np.put_along_axis(still, pick, False, 1)
        open_[rows] = still
        fresh = np.where(chosen[:, :, None] >= 0, links[np.maximum(chosen, 0)], -1).reshape(len(rows), -1)
    order = np.argsort(-like, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(like, order, 1)


def spread_out(x: np.ndarray, ids: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those that are nearer to the row's node than to one chosen before, then
    the nearest of the rest, ``most`` in all."""
    m, c = ids.shape
    v = x[np.maximum(ids, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    live = ids >= 0
    taken = np.zeros((m, c), bool)
    for j in range(c):
        nearest = np.where(taken, among[:, j, :], -np.inf).max(1)
        taken[:, j] = live[:, j] & (nearest < like[:, j]) & (taken.sum(1) < most)
    order = np.argsort(np.where(taken, 0, np.where(live, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(live, ids, -1), order, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - c))), constant_values=-1)


class Graph:
    """Nodes in order of falling layer, so that a layer is a run of nodes from the first; links by layer, -1 where none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, layer: np.ndarray) -> Graph:
        """x by falling ``layer``. Nodes come in growing batches that search the graph of those before and each other."""
        n = len(x)
        sizes = [int((layer >= k).sum()) for k in range(int(layer[0]) + 1)]
        g = cls(x, [np.full((size, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, size in enumerate(sizes)])
        done = 1
        while done < n:
            end = min(n, done + min(BLOCK, done))
            g._insert(done, end)
            done = end
        return g

    def _descend(self, queries: np.ndarray, down_to: int, known: int) -> np.ndarray:
        at = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.layers) - 1, down_to, -1):
            if min(len(self.layers[k]), known) > 1:
                at = search(self.x, self.layers[k], queries, at, 1)[0]
        return at

    def _insert(self, a: int, b: int) -> None:
        q = self.x[a:b]
        at = np.zeros((b - a, 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            links = self.layers[k]
            own = min(len(links), b) - a  # so many of the batch are on this layer
            if own < b - a and min(len(links), a) > 1:
                at[max(own, 0) :, :1] = search(self.x, links, q[max(own, 0) :], at[max(own, 0) :, :1], 1)[0]
            if own <= 0:
                continue
            ids, like = search(self.x, links, q[:own], at[:own], BUILD_BEAM)
            at = np.concatenate([ids[:, :1], at[own:, :1]])  # of the nodes before; the batch isn't linked below yet
            mates = q[:own] @ q[:own].T
            np.fill_diagonal(mates, -np.inf)
            near = np.argsort(-mates, axis=1, kind="stable")[:, :LINKS]
            ids = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(mates, near, 1)), near + a, -1)], 1)
            like = np.concatenate([like, np.take_along_axis(mates, near, 1)], 1)
            order = np.argsort(-like, axis=1, kind="stable")
            ids, like = np.take_along_axis(ids, order, 1), np.take_along_axis(like, order, 1)
            chosen = spread_out(self.x, ids, like, LINKS)
            links[a : a + own, :LINKS] = chosen
            self._link_back(links, a + np.repeat(np.arange(own), LINKS), chosen.reshape(-1))

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Links the other way; a full list keeps a spread-out choice."""
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        most = links.shape[1]
        while len(target):
            first = np.r_[True, target[1:] != target[:-1]]
            rank = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
            now = rank < most
            nodes, back = np.unique(target[now], return_inverse=True)
            cand = np.full((len(nodes), 2 * most), -1, np.int64)
            cand[:, :most] = links[nodes]
            cand[back, most + rank[now]] = source[now]
            again = (cand[:, most:, None] == cand[:, None, :most]).any(2)  # mates may have chosen each other
            cand[:, most:][again] = -1
            like = np.where(cand >= 0, np.einsum("ij,ikj->ik", self.x[nodes], self.x[np.maximum(cand, 0)]), -np.inf)
            order = np.argsort(-like, axis=1, kind="stable")
            cand, like = np.take_along_axis(cand, order, 1), np.take_along_axis(like, order, 1)
            full = (cand >= 0).sum(1) > most
            links[nodes] = cand[:, :most]
            if full.any():
                links[nodes[full]] = spread_out(self.x, cand[full], like[full], most)
            source, target = source[~now], target[~now]

    def near(self, queries: np.ndarray, own: np.ndarray | None, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """search() on the lowest layer from where the upper layers lead, and from the query's own node."""
        at = self._descend(queries, 0, len(self.x))
        if own is not None:
            at = np.concatenate([at, own[:, None]], 1)
        return search(self.x, self.layers[0], queries, at, min(beam, len(self.x)))


def layer_of(number: np.ndarray) -> np.ndarray:
    """The highest layer of nodes (5 at most), from their numbers alone: each layer has one in LINKS of those below."""
    u = (mix64(number.view(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
    return np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)), 5).astype(np.int64)


# --- the links of two shards ------------------------------------------------------------------------------------------


class Shard:
    def __init__(self, nodes: np.ndarray, counts: np.ndarray, exact: np.ndarray, graph: Graph | None):
        self.nodes, self.counts, self.exact, self.graph = nodes, counts, exact, graph


def _compared(a: Shard, b: Shard, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links of some of a's nodes with b's, by comparing them."""
    for i in range(0, len(which), BLOCK):
        w = which[i : i + BLOCK]
        row, node = np.nonzero(a.exact[w] @ b.exact.T >= LIKE)
        yield w[row], node


def _beams(a: Shard, b: Shard, w: np.ndarray, own: bool, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that beams of these queries find (row among them, node), and which beams came back full of links."""
    ids, like = b.graph.near(a.exact[w].astype(np.float32), w if own else None, beam)
    hit = (like >= LIKE - SLACK) & (ids >= 0)
    full = hit.all(1)
    row, k = np.nonzero(hit & ~full[:, None])
    node = ids[row, k]
    close = np.einsum("ij,ij->i", a.exact[w[row]], b.exact[node]) >= LIKE
    return row[close], node[close], full


def audited_beam(a: Shard, b: Shard, own: bool) -> int:
    """The least beam, by doubling, that finds its share of the audit's links. Full beams are left out: they are widened."""
    audit = np.sort(np.argsort(mix64(np.arange(len(a.nodes), dtype=np.uint64)), kind="stable")[:AUDIT])
    beam = BEAM
    while beam < WIDEST:
        found = there = 0
        for i in range(0, len(audit), 64):
            w = audit[i : i + 64]
            row, _, full = _beams(a, b, w, own, beam)
            found += len(row)
            there += int((a.exact[w[~full]] @ b.exact.T >= LIKE).sum())
        if found >= RECALL * there:
            break
        beam *= 2
    return beam


def links(a: Shard, b: Shard, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (place in a, place in b) that are linked, and whether they are all links of these places in a."""
    beam, which = audited_beam(a, b, own), np.arange(len(a.nodes))
    while len(which) and beam < min(WIDEST, len(b.nodes)):
        more = []
        for i in range(0, len(which), BLOCK):
            w = which[i : i + BLOCK]
            row, node, full = _beams(a, b, w, own, beam)
            yield w[row], node, False
            more.append(w[full])
        which, beam = np.concatenate(more), 4 * beam
    for row, node in _compared(a, b, which):
        yield row, node, True


class _Forest:
    """Components of places: the edges that joined something."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 20_000):
            x, y = self.root[a[i : i + 20_000]], self.root[b[i : i + 20_000]]
            new = np.flatnonzero(x != y)
            if not len(new):
                continue
            up: dict[int, int] = {}

            def top(k: int, up: dict[int, int] = up) -> int:
                while k in up:
                    k = up[k]
                return k

            for j, r, s in zip((i + new).tolist(), x[new].tolist(), y[new].tolist(), strict=True):
                r, s = top(r), top(s)
                if r != s:
                    up[max(r, s)] = min(r, s)
                    self.edges.append((int(a[j]), int(b[j])))
            for k in list(up):
                up[k] = top(k)
            moved = np.arange(len(self.root))
            moved[list(up)] = list(up.values())
            self.root = moved[self.root]


def linked(a: Shard, b: Shard, own: bool) -> pa.RecordBatch:
    """Numbers of links by node, and a forest: rows (node, links, other), links null for the forest's, other for the rest."""
    n, m = len(a.nodes), len(b.nodes)
    counts_a, counts_b, sure = np.zeros(n, np.int64), np.zeros(m, np.int64), np.zeros(n, bool)
    forest = _Forest(n if own else n + m)
    beamed: list[np.ndarray] = []
    for row, node, whole in links(a, b, own):
        if own:
            row, node = row[row != node], node[row != node]
            if whole:  # its own links, all of them, and as many for those on the other side
                sure[row] = True
                np.add.at(counts_a, row, b.counts[node])
                np.add.at(counts_b, node, a.counts[row])
            else:  # a pair may be found from either side, and counts once
                beamed.append(np.unique(np.minimum(row, node) * m + np.maximum(row, node)))
        else:
            np.add.at(counts_a, row, b.counts[node])
            np.add.at(counts_b, node, a.counts[row])
        forest.join(row, node if own else n + node)
    if own:
        counts_a = np.where(sure, counts_a, counts_b)
        pairs = np.unique(np.concatenate(beamed)) if beamed else np.zeros(0, np.int64)
        low, high = pairs // m, pairs % m
        open_ = ~sure[low] & ~sure[high]
        np.add.at(counts_a, low[open_], b.counts[high[open_]])
        np.add.at(counts_a, high[open_], b.counts[low[open_]])
    nodes = a.nodes if own else np.concatenate([a.nodes, b.nodes])
    counts = counts_a if own else np.concatenate([counts_a, counts_b])
    some, edges = np.flatnonzero(counts), np.array(forest.edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([nodes[some], nodes[edges[:, 0]]])),
            pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)]), mask=np.r_[np.zeros(len(some), bool), np.ones(len(edges), bool)]),
            pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[edges[:, 1]]]), mask=np.r_[np.ones(len(some), bool), np.zeros(len(edges), bool)]),
        ],
        ["node", "links", "other"],
    )


# --- all shards -------------------------------------------------------------------------------------------------------

_SHARD = "label string, dim int, shard int, nodes binary, counts binary, vectors binary, graph array<binary>"


def _nodes(embeddings: DataFrame) -> DataFrame:
    """rows with the key of their node (null where they link with nothing): vec_id, label, embedding, key."""
    c = F.col("embedding")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(c, lambda x: x != 0)
    vector = F.transform(c, lambda x: x.cast("double") + 0.0)
    ok = F.col("label").isNotNull() & c.isNotNull() & F.coalesce(fine, F.lit(False))
    name = F.concat_ws(":", F.col("label").cast("string"), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","))
    return embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.when(ok, vector).alias("v"), F.when(ok, text_key(name)).alias("key"))


def _sharded(nodes: DataFrame) -> DataFrame:
    """Nodes (node, label, dim, v, copies) -> a row a shard with its graph."""
    dealt = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.greatest(F.lit(256), F.least(F.lit(SHARD), F.floor(ENTRIES / F.col("dim"))))).cast("int").alias("shards"))
    rows = salted_join(nodes, dealt, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        number = table.column("node").to_numpy()
        layer = layer_of(number)
        order = np.lexsort((number, -layer))
        exact = units(table.column("v").combine_chunks().flatten().to_numpy().reshape(len(number), -1))[order]
        g = Graph.build(exact.astype(np.float32), layer[order])
        one = lambda c: table.column(c)[0].as_py()
        cells = [[one("label")], [one("dim")], [one("shard")], [number[order].tobytes()], [table.column("copies").to_numpy()[order].tobytes()], [exact.tobytes()], [[x.tobytes() for x in g.layers]]]
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])

    return rows.select("label", "dim", "shard", "node", "copies", "v").groupBy("label", "dim", "shard").applyInArrow(build, _SHARD)


def _read(row: dict, dim: int, graph: bool) -> Shard:
    exact = np.frombuffer(row["vectors"]).reshape(-1, dim)
    layers = [np.frombuffer(x, np.int32).reshape(-1, LINKS * (2 if k == 0 else 1)) for k, x in enumerate(row["graph"])] if graph else []
    return Shard(np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["counts"], np.int64), exact, Graph(exact.astype(np.float32), layers) if graph else None)


def _links(shards: DataFrame) -> DataFrame:
    """A row a shard -> node, links, other of all pairs of shards of a label."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = _read(row, row["dim"], True)
                yield linked(s, s, True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield linked(_read(row["a"], row["dim"], False), _read(row["b"], row["dim"], True), False)

    schema = "node long, links long, other long"
    key = ["label", "dim"]
    body = F.struct("nodes", "counts", "vectors")
    ids = shards.select(*key, F.col("shard").alias("x"))
    pairs = ids.join(ids.withColumnRenamed("x", "y"), key).where("x < y")
    a = shards.select(*key, F.col("shard").alias("x"), body.alias("a"))
    b = shards.select(*key, F.col("shard").alias("y"), F.struct("nodes", "counts", "vectors", "graph").alias("b"))
    met = pairs.join(a, [*key, "x"]).join(b, [*key, "y"])
    return shards.mapInArrow(within, schema).unionByName(met.select("dim", "a", "b").mapInArrow(across, schema))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = _nodes(embeddings)
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Nodes are numbered in order of their least vec_id, so the least node of a component has its least vec_id.
    order = ["missing", "low", "key"]
    nodes = cut(groups.withColumn("missing", F.col("low").isNull()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    found = cut(_links(cut(_sharded(nodes.select("node", "label", F.size("v").alias("dim"), "copies", "v")))))
    links_ = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = salted_join(roots, nodes.select(F.col("node").alias("root"), F.col("low").alias("name")), ["root"]).select("node", "name")
    node = nodes.select("node", "key", "low", "copies").join(links_, "node", "left").join(named, "node", "left")
    node = node.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("name", "low").alias("name"))
    out = salted_join(rows.where("key IS NOT NULL").select("vec_id", "key"), node, ["key"]).select("vec_id", F.col("n").alias("n_links"), F.col("name").alias("component_id"))
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12(embeddings: DataFrame) -> DataFrame:
    """The near-duplicate query over all embeddings."""
    return near_duplicates(embeddings)


#: Exact links by comparing all pairs of a label, components by least reachable id.
OP12_SQL = """
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), unit AS MATERIALIZED (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS r FROM rows WHERE ok),
near AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM unit a JOIN unit b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.r * b.r) >= 0.93
), reach AS (
  SELECT k, k AS to_k FROM rows UNION SELECT r.k, n.b FROM reach r JOIN near n ON n.a = r.to_k
)
SELECT w.vec_id, (SELECT count(*) FROM near n WHERE n.a = w.k) AS n_links, min(x.vec_id) AS component_id, coalesce(w.vec_id = min(x.vec_id), false) AS kept
FROM rows w JOIN reach USING (k) JOIN rows x ON x.k = reach.to_k GROUP BY w.k, w.vec_id
"""
