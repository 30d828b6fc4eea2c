"""Mix overlapping sources to target sizes by a min-cost flow.

Documents are summed by membership pattern (the set of sources a document
belongs to), the patterns' token capacity is routed to the sources' quotas by a
min-cost flow in which every further repetition of a pattern costs more than the
one before, and seeded thresholds then choose the documents of each pattern.

Only pattern totals and one threshold per pattern reach the driver. A pattern's
documents are never gathered: its threshold is found by a radix select over the
seeded hash, in rounds of 4096 cells.

Defined results: null sizes count 0; a null or empty source list is the pattern
of the null source; sources in a list count once; rows that agree in id and salt
(repeated rows) are taken together; an empty table gives an empty result; other
columns pass through untouched. Where the table has a column of a name that the
mix adds, the mix's own begins with ``mix_``.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, cut

#: Names of helper columns; callers' columns don't start like this.
P, H, S, N, T = "__mix_pattern", "__mix_hash", "__mix_size", "__mix_copies", "__mix_taken"
#: What a mixed table has besides its own columns.
ADDED = ("size", "source_size", "target", "copies", "taken")
CELL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sizes: dict, weights: dict, total: float, most: float = 3.0) -> dict[object, float]:
    """Share total by weight; no key gets over ``most`` times its size, what is over goes to the rest by weight."""
    out, open_, left = {}, [k for k in sizes], float(total)
    while open_:
        w = sum(weights[k] for k in open_)
        full = [k for k in open_ if w and left * weights[k] / w > most * sizes[k]]
        if not full:
            out |= {k: (left * weights[k] / w if w else 0.0) for k in open_}
            break
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return {k: float(v) for k, v in out.items()}


def min_cost_flow(capacity: dict[str, int], members: dict[str, list], quota: dict[object, int], repeats: int) -> dict[str, dict]:
    """Tokens that each pattern gives each source: as much of the quotas as can be met, at the least cost.

    The k-th repetition of a pattern offers its capacity at 2k - 1 a token, so
    the cost of a pattern is convex and repetitions spread before they pile up.
    Shortest augmenting paths with potentials; integers throughout.
    """
    pats, srcs = sorted(capacity), list(quota)
    start, end = 0, 1 + len(pats) + len(srcs)
    at = {("p", p): 1 + i for i, p in enumerate(pats)} | {("s", s): 1 + len(pats) + i for i, s in enumerate(srcs)}
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
        return len(to) - 2

    routes = {}
    for p in pats:
        for k in range(1, repeats + 1):
            edge(start, at["p", p], capacity[p], 2 * k - 1)
        for s in members[p]:
            if s in quota:
                routes[p, s] = edge(at["p", p], at["s", s], capacity[p] * repeats, 0)
    for s in srcs:
        edge(at["s", s], end, quota[s], 0)
    height = [0] * (end + 1)
    while True:
        dist, via, heap = [None] * (end + 1), [-1] * (end + 1), [(0, start)]
        dist[start] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                if cap[e] > 0:
                    n = d + cost[e] + height[a] - height[to[e]]
                    if dist[to[e]] is None or n < dist[to[e]]:
                        dist[to[e]], via[to[e]] = n, e
                        heapq.heappush(heap, (n, to[e]))
        if dist[end] is None:
            break
        far = max(d for d in dist if d is not None)
        height = [h + (far if d is None else d) for h, d in zip(height, dist, strict=True)]
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = to[via[b] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow: dict[str, dict] = {p: {} for p in pats}
    for (p, s), e in routes.items():
        if cap[e ^ 1]:
            flow[p][s] = cap[e ^ 1]
    return flow


def with_keys(docs: DataFrame, size: Column, sources: Column, keys: list[Column], seed: int) -> DataFrame:
    """Add the pattern, the size and the seeded 63-bit hash that decide about a row."""
    srcs = F.sort_array(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    srcs = F.when(F.size(srcs) == 0, F.array(F.lit(None).cast("string"))).otherwise(srcs)
    return docs.withColumns({P: F.to_json(srcs), S: F.coalesce(size, F.lit(0)).cast("long"), H: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 1)})


@dataclass
class MixPlan:
    """What each pattern gives: ``base`` whole copies, one more of rows with hash <= ``cut``, one for each place in ``tops``."""

    patterns: dict[str, tuple[int, int, list[int]]]
    flow: dict[str, dict]

    def frame(self, spark) -> DataFrame:
        rows = [(p, *x) for p, x in self.patterns.items()]
        return spark.createDataFrame(rows, f"{P} string, __mix_base long, __mix_cut long, __mix_tops array<long>")


def _boundaries(cells: DataFrame, cell: str, rest: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each pattern, the cell in which the running size passes what is left, and the size before it."""
    spark = cells.sparkSession
    lim = spark.createDataFrame(list(rest.items()), f"{P} string, __rest long")
    run = F.sum("__n").over(Window.partitionBy(P).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    found = cells.join(F.broadcast(lim), P).withColumn("__run", run).where((F.col("__run") > F.col("__rest")) & (F.col("__run") - F.col("__n") <= F.col("__rest")))
    return {r[P]: (r[cell], r["b"]) for r in found.select(P, cell, (F.col("__run") - F.col("__n")).alias("b")).collect()}


def _copies() -> Column:
    """How often a row is taken, by its hash and its pattern's thresholds."""
    return (F.col("__mix_base") + (F.col(H) <= F.col("__mix_cut")).cast("long") + F.size(F.filter("__mix_tops", lambda t: t == F.col(H)))).cast("long")


def _top_up(keyed: DataFrame, gaps: dict[str, tuple[int, float]], thresholds: dict[str, list], repeats: int, rounds: int = 6) -> None:
    """Fill what long documents at the boundary leave open: at most ``rounds`` more hashes for each pattern.

    gaps: pattern -> (open tokens, tolerance). Each round takes the largest row
    that fits, or one that overshoots within tolerance; the last round takes the
    nearest. A row that is taken already is taken again only if it is nearer by
    more than the tolerance.
    """
    spark = keyed.sparkSession
    for k in range(rounds):
        gaps = {p: x for p, x in gaps.items() if x[0] > x[1]}
        if not gaps:
            return
        lim = spark.createDataFrame([(p, g, float(tol), *thresholds[p]) for p, (g, tol) in gaps.items()], f"{P} string, __gap long, __tol double, __mix_base long, __mix_cut long, __mix_tops array<long>")
        off = F.abs(F.col(S) - F.col("__gap"))
        again = F.when(_copies() > F.col("__mix_base"), F.col("__tol")).otherwise(0.0)
        near = F.struct((off + again).alias("rank"), off.alias("off"), F.col(H).alias("h"), F.col(S).alias("s"))
        free = keyed.join(F.broadcast(lim), P).where((F.col(S) > 0) & (off < F.col("__gap")) & (_copies() < repeats))
        got = {r[P]: r for r in free.groupBy(P).agg(F.min(F.when(F.col(S) <= F.col("__gap"), near)).alias("fit"), F.min(F.when(F.col(S) > F.col("__gap"), near)).alias("over")).collect()}
        left = {}
        for p, (gap, tol) in gaps.items():
            fit, over = (got[p]["fit"], got[p]["over"]) if p in got else (None, None)
            take = over if over and (not fit or over["off"] <= tol or k == rounds - 1 and over["off"] < fit["off"]) else fit
            if take:
                thresholds[p][2].append(take["h"])
                left[p] = (gap - take["s"], tol)
        gaps = left


def plan_mix(keyed: DataFrame, quota: dict[object, int], repeats: int = 3, max_patterns: int = 20_000) -> MixPlan:
    """Route capacity and find each pattern's thresholds. ``keyed``: rows with_keys gave, cheap to read again.

    ``max_patterns`` bounds what comes to the driver and is broadcast: one row
    for each set of sources in use. More sets raise an error, none are dropped.
    """
    spark = keyed.sparkSession
    sums = keyed.groupBy(P).agg(F.sum(S).alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns; raise max_patterns if the driver can hold them")
    capacity = {r[P]: int(r["n"]) for r in sums}
    flow = min_cost_flow(capacity, {p: json.loads(p) for p in capacity}, quota, repeats)
    give = {p: sum(x.values()) for p, x in flow.items()}
    base = {p: (give[p] // c if c else 0) for p, c in capacity.items()}
    rest = {p: give[p] - base[p] * c for p, c in capacity.items()}
    thresholds = {p: [base[p], -1, []] for p in capacity}
    live = {p: r for p, r in rest.items() if r > 0}
    if live:
        part, before, bits = keyed.where(F.col(S) > 0), dict.fromkeys(live, 0), 63
        prefix: dict[str, int] = {}
        for last in (False, False, True):
            if prefix:
                lim = spark.createDataFrame(list(prefix.items()), f"{P} string, __prefix long")
                part = keyed.where(F.col(S) > 0).join(F.broadcast(lim), P).where(F.shiftright(F.col(H), bits) == F.col("__prefix")).drop("__prefix")
            else:
                part = part.join(F.broadcast(spark.createDataFrame([(p,) for p in live], f"{P} string")), P)
            if not last:
                bits -= CELL_BITS
            cells = part.groupBy(P, (F.col(H) if last else F.shiftright(F.col(H), bits)).alias("__cell")).agg(F.sum(S).alias("__n"))
            found = _boundaries(cells, "__cell", {p: live[p] - before[p] for p in live})
            before = {p: before[p] + found[p][1] for p in live}
            prefix = {p: found[p][0] for p in live}
        for p in live:
            thresholds[p][1] = prefix[p] - 1  # rows of the boundary hash itself don't fit whole
        _top_up(keyed, {p: (live[p] - before[p], give[p] / 1000) for p in live}, thresholds, repeats)
    return MixPlan({p: tuple(x) for p, x in thresholds.items()}, flow)


def apply_mix(keyed: DataFrame, plan: MixPlan) -> DataFrame:
    """Add N (copies) and T (tokens taken: copies times size); no shuffle, the plan is bounded by max_patterns."""
    copies = F.when(F.col(S) > 0, _copies()).otherwise(0)
    out = keyed.join(F.broadcast(plan.frame(keyed.sparkSession)), P, "left")
    return out.withColumn(N, F.coalesce(copies, F.lit(0).cast("long"))).withColumn(T, F.col(N) * F.col(S)).drop("__mix_base", "__mix_cut", "__mix_tops")


def mix_documents(docs: DataFrame, seed: int = 17, repeats: int = 3, max_patterns: int = 20_000) -> DataFrame:
    """Mix a documents table by single sources, weighing 5, 2, 1 in order, to as many words as there are.

    Adds size, source_size, target, copies and taken to the table's columns. More
    than ``max_patterns`` sources raise an error (see plan_mix).
    """
    keyed = with_keys(docs, word_count(F.col("text")), F.array("source"), [F.col("doc_id"), F.col("text")], seed)
    light = cut(keyed.select(P, S, H))
    sums = light.groupBy(P).agg(F.sum(S).alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"over {max_patterns} sources; raise max_patterns if the driver can hold them")
    sizes = {json.loads(r[P])[0]: int(r["n"]) for r in sums}
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets = capped_shares(sizes, weights, sum(sizes.values()), repeats)
    plan = plan_mix(light, {s: int(round(t)) for s, t in targets.items()}, repeats, max_patterns)
    names = {r[P]: json.loads(r[P])[0] for r in sums}
    info = docs.sparkSession.createDataFrame([(p, sizes[s], targets[s]) for p, s in names.items()], f"{P} string, __mix_source long, __mix_target double")
    out = apply_mix(keyed, plan).join(F.broadcast(info), P, "left")
    added = dict(zip(ADDED, (S, "__mix_source", "__mix_target", N, T), strict=True))
    return out.select(*docs.columns, *[F.col(c).alias(f"mix_{a}" if a in docs.columns else a) for a, c in added.items()])


def op1(docs: DataFrame) -> DataFrame:
    """The mixing query's columns. The text is read twice and never shuffled."""
    return mix_documents(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with how often (copies) and what for (size, source_size, target, taken)."""
    mixed = mix_documents(docs)
    return mixed.where(F.col("mix_copies" if "copies" in docs.columns else "copies") > 0)
