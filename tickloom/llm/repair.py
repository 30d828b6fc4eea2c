"""Repair of conversations: the cheapest edits that make the roles of each one ``(s?(ua)+)?``, by a checkpointed DP.

Rows of a conversation are walked in order. Keeping one costs nothing, giving it
the role user or assistant 1, deleting it 2 (a blank or repeated row must go),
inserting an empty row of either role 5, and a truncated row that stays 5 more.
An automaton of four states (begin, after a system row, after a user row, after
an assistant row) says which roles may follow; a state and an edit's letter
decide the next state, so of all cheapest edits the ASCII-least are found by
walking forward and taking the first letter that is tight: its cost and the cost
of what is left behind it make up the cost of what is left before it.

The costs of what is left (one number a state) are computed backward. Of a run of
m rows only every sqrt(m)-th vector is stored; walking forward, each block is
recomputed from the vector at its end. All rows are laid in one global order, cut
into range partitions, so a conversation of any length is a chain of pieces, one
a partition. A piece inside a partition is whole. Those at a partition's edges
(two a partition at most) are linear maps of the vector behind them over (min, +):
their 4 x 4 matrices, and then what each start state walks to, are put together on
the driver, two small rows a partition.

Defined results: null text and null role are one space, null conv_id is a
conversation of its own, null turns come first; rows of one turn go by the first
64 characters of role and text, then by the SHA-256 of both. Equal rows are
duplicates from the second on. A role counts by its first character; an empty one
is never kept. Texts move whole and are never cut. Other columns are ignored. An
empty table gives no rows. Digests (op11) need a conversation's rows in order, so
there a conversation is streamed through one task, with constant memory but for
its audit string; ``repaired`` has no such stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.llm.common import text_key
from tickloom.sources.store import cut

#: White space of the contract, what ends a sentence, and the costs of edits.
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Bits of ``at`` under the partition's number.
PART_BITS = 33
#: Faults of a row, and initials; a row's code is 4 times its initial's place plus its fault.
FINE, CUT_OFF, BLANK, REPEAT = range(4)
INITIALS = "sua"
#: The state that the next inserted or renamed row leads to, its role, and where a kept initial leads.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
FAR = 1 << 50
Vector = tuple[int, int, int, int]


# --- the automaton ----------------------------------------------------------------------------------------------------


def with_inserts(w: Vector) -> Vector:
    """Least costs where up to two rows may be inserted first; more lead round in a circle."""
    return tuple(min(w[s], INSERT + w[NEXT[s]], 2 * INSERT + w[NEXT[NEXT[s]]]) for s in range(4))


END: Vector = with_inserts((0, FAR, FAR, 0))


def choices(code: int, s: int) -> list[tuple[str, int, int]]:
    """What may be done to a row in a state: letter, cost, next state, in ASCII order of the letters."""
    initial, fault = divmod(code, 4)
    out = [("D", DELETE, s)]
    if fault in (FINE, CUT_OFF):
        stay = TRUNCATED * (fault == CUT_OFF)
        if s in KEEP[initial]:
            out.append(("K", stay, KEEP[initial][s]))
        out.append(("R", REROLE + stay, NEXT[s]))
    return out


class Walker:
    """Vectors of costs, each lessened by its least, under numbers; steps between them are worked out once."""

    def __init__(self):
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.steps: dict[tuple[int, int], int] = {}
        self.shifts: dict[tuple[int, int], int] = {}
        self.walks: dict[tuple[int, int, int], tuple[str, int]] = {}

    def number(self, v: Vector) -> int:
        low = min(v)
        v = tuple(x - low if x < FAR // 2 else FAR for x in v)
        if v not in self.numbers:
            self.numbers[v] = len(self.vectors)
            self.vectors.append(v)
        return self.numbers[v]

    @staticmethod
    def before(behind: Vector, code: int) -> Vector:
        return with_inserts(tuple(min(c + behind[t] for _, c, t in choices(code, s)) for s in range(4)))

    def step(self, behind: int, code: int) -> int:
        got = self.steps.get((behind, code))
        if got is None:
            v = self.before(self.vectors[behind], code)
            got = self.steps[behind, code] = self.number(v)
            self.shifts[behind, code] = min(v)
        return got

    def walk(self, behind: int, code: int, s: int) -> tuple[str, int]:
        """The letters up to and with a row's own, and the state behind it."""
        got = self.walks.get((behind, code, s))
        if got is None:
            v = self.vectors[behind]
            here, letters, t = self.before(v, code), "", s
            while True:
                options = [*choices(code, t), ("I", INSERT, None)]
                letter, _, to = min(o for o in options if o[1] + (here[NEXT[t]] if o[2] is None else v[o[2]]) == here[t])
                letters += letter
                if to is not None:
                    break
                t = NEXT[t]
            got = self.walks[behind, code, s] = (letters, to)
        return got

    def checkpoints(self, codes: bytes, behind: int) -> tuple[int, list[int]]:
        """The length of a block and the number of the vector at each block's begin; nothing else is stored."""
        size = isqrt(len(codes)) + 1
        marks = [0] * (-(-len(codes) // size))
        for i in range(len(codes) - 1, -1, -1):
            behind = self.step(behind, codes[i])
            if i % size == 0:
                marks[i // size] = behind
        return size, marks

    def edits(self, codes: bytes, behind: int, s: int) -> Iterator[tuple[int, str, int]]:
        """For each row the state before it, its letters, and the state behind it."""
        size, marks = self.checkpoints(codes, behind)
        for k in range(len(marks)):
            block = codes[k * size : (k + 1) * size]
            vectors = [marks[k + 1] if k + 1 < len(marks) else behind]
            for code in reversed(block):
                vectors.append(self.step(vectors[-1], code))
            for i, code in enumerate(block):
                letters, t = self.walk(vectors[len(block) - 1 - i], code, s)
                yield s, letters, t
                s = t


def tail(s: int) -> str:
    """Inserts behind the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[s]


def matrix(codes: bytes) -> list[list[int]]:
    """A piece as a map of the costs behind it: [state before][state behind]."""
    columns, walker = [], Walker()
    for t in range(4):
        v, low = walker.number(tuple(0 if s == t else FAR for s in range(4))), 0
        for code in reversed(codes):
            v, at = walker.step(v, code), (v, code)
            low += walker.shifts[at]
        columns.append([x + low for x in walker.vectors[v]])
    return [[min(columns[t][s], FAR) for t in range(4)] for s in range(4)]


# --- rows in one global order -----------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that a row's own key calls for: dropped, emptied, without sentence ends,
    repeated, or with the role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, a long that rises with conv_id, turn and the rest; its upper bits are the partition. Equal rows
    are told apart by where they were read, so that a great many of them spread too."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"r": F.left("role", F.lit(64)), "t": F.left("text", F.lit(64)), "h": F.sha2(F.concat("role", F.lit(":"), "text"), 256), "salt": F.monotonically_increasing_id()})
    key = ["conv_id", "turn", "r", "t", "h", "salt"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    return cut(rows.select("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id()))


def _faults(rows: DataFrame) -> DataFrame:
    """at, conv_id and code of each row, sorted by at, a partition's rows together."""
    plain = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(F.when(F.length("role") > 0, F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)) - 1), F.lit(3))
    own = F.when(plain == "", BLANK).when(~F.right(plain, F.lit(1)).isin(*".!?"), CUT_OFF).otherwise(FINE)
    narrow = rows.select("at", "conv_id", "role", text_key(F.col("text")).alias("key"), (initial * 4).alias("initial"), own.alias("own"))
    firsts = narrow.where(F.col("own") != BLANK).groupBy("conv_id", "role", "key").agg(F.min("at").alias("at"))
    both = narrow.select("at", "conv_id", (F.col("initial") + F.col("own")).cast("int").alias("code"), F.lit(0).alias("mark"))
    both = both.unionByName(firsts.select("at", F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(None).cast("int").alias("code"), F.lit(1).alias("mark")))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row that isn't blank and has no mark behind it has been seen before."""
        left = None
        for b in batches:
            b = pa.Table.from_batches([b])
            left = b if left is None else pa.concat_tables([left, b])
            if len(left) > 1:
                yield from told(left, len(left) - 1)
                left = left.slice(len(left) - 1)
        if left is not None:
            yield from told(left, len(left))

    def told(t: pa.Table, n: int) -> list[pa.RecordBatch]:
        at, mark = t.column("at").to_numpy(), t.column("mark").to_numpy()
        first = np.zeros(len(t), bool)
        first[:-1] = (at[1:] == at[:-1]) & (mark[1:] == 1)
        keep = np.flatnonzero(mark[:n] == 0)
        code = t.column("code").fill_null(0).to_numpy()[keep]
        again = ~first[keep] & (code % 4 != BLANK)
        code = np.where(again, code // 4 * 4 + REPEAT, code)
        out = pa.table({"at": pa.array(at[keep]), "conv_id": t.column("conv_id").take(pa.array(keep)), "code": pa.array(code.astype(np.int32))})
        return out.combine_chunks().to_batches()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return both.repartition(F.shiftright("at", PART_BITS)).sortWithinPartitions("at", "mark").mapInArrow(marked, f"at long, conv_id {kind}, code int")


class Piece:
    """The rows of one conversation in one partition."""

    def __init__(self, part: int, conv, first: bool):
        self.part, self.conv, self.first, self.last = part, conv, first, False
        self.at, self.codes = [], []

    @property
    def edge(self) -> bool:
        return self.first or self.last


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Whole pieces, one at a time; the first and the last of a partition are edges."""
    now: Piece | None = None
    for b in batches:
        ats, convs, codes = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
        parts = ats >> PART_BITS
        ids = convs.to_pylist()
        start = 0
        for i in range(1, len(ats) + 1):
            if i < len(ats) and parts[i] == parts[start] and ids[i] == ids[start]:
                continue
            if now is None or now.part != parts[start] or now.conv != ids[start]:
                if now is not None:
                    now.last = now.part != parts[start]
                    yield now
                now = Piece(int(parts[start]), ids[start], now is None or now.part != parts[start])
            now.at.append(ats[start:i])
            now.codes.append(codes[start:i])
            start = i
    if now is not None:
        now.last = True
        yield now


def _codes(piece: Piece) -> bytes:
    return np.concatenate(piece.codes).astype(np.uint8).tobytes()


Chain = dict[tuple[int, bool], tuple[Vector, int]]


def _chains(symbols: DataFrame) -> Chain:
    """(partition, first piece or last) -> the costs behind an edge piece and the state that it begins in. Two rows a
    partition come to the driver, twice."""
    kind = symbols.schema["conv_id"].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(p.part, p.first, p.conv, [x for r in matrix(_codes(p)) for x in r]) for p in _pieces(batches) if p.edge]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], conv_type), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["part", "first", "conv_id", "m"])

    conv_type = to_arrow_type(symbols.schema["conv_id"].dataType)
    edges = symbols.mapInArrow(maps, f"part long, first boolean, conv_id {kind}, m array<bigint>").collect()
    edges.sort(key=lambda r: (r["part"], not r["first"]))
    behind: dict[tuple[int, bool], Vector] = {}
    for k in range(len(edges) - 1, -1, -1):
        r = edges[k]
        same = k + 1 < len(edges) and edges[k + 1]["conv_id"] == r["conv_id"]
        if same:
            after = edges[k + 1]
            v, m = behind[after["part"], after["first"]], after["m"]
            behind[r["part"], r["first"]] = tuple(min(min(m[4 * s + t] + v[t] for t in range(4)), FAR) for s in range(4))
        else:
            behind[r["part"], r["first"]] = END
    held = symbols.sparkSession.sparkContext.broadcast(behind)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, rows = Walker(), []
        for p in _pieces(batches):
            if p.edge:
                v = walker.number(held.value[p.part, p.first])
                to = []
                for s in range(4):
                    for _, _, t in walker.edits(_codes(p), v, s):
                        pass
                    to.append(t)
                rows.append((p.part, p.first, to))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["part", "first", "states"])

    to = {(r["part"], r["first"]): r["states"] for r in symbols.mapInArrow(ends, "part long, first boolean, states array<bigint>").collect()}
    out: Chain = {}
    state = 0
    for k, r in enumerate(edges):
        at = r["part"], r["first"]
        if k == 0 or edges[k - 1]["conv_id"] != r["conv_id"]:
            state = 0
        out[at] = behind[at], state
        state = to[at][state]
    return out


def edits(rows: DataFrame) -> DataFrame:
    """Rows in order (``in_order``) -> at, conv_id, code, the state before each row, its letters (inserts first, then what
    becomes of the row itself), and the letters behind a conversation's last row."""
    symbols = cut(_faults(rows))
    chains = _chains(symbols)
    held = symbols.sparkSession.sparkContext.broadcast(chains)
    kind = symbols.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        end = walker.number(END)
        for p in _pieces(batches):
            v, s = held.value[p.part, p.first] if p.edge else (END, 0)
            codes, at = _codes(p), np.concatenate(p.at)
            got = list(walker.edits(codes, walker.number(v) if p.edge else end, s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array([p.conv] * len(at), conv_type), pa.array(np.frombuffer(codes, np.uint8).astype(np.int32)), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got], pa.int32())],
                ["at", "conv_id", "code", "state", "letters", "behind"],
            )

    conv_type = to_arrow_type(symbols.schema["conv_id"].dataType)
    return symbols.mapInArrow(run, f"at long, conv_id {kind}, code int, state int, letters string, behind int")


# --- what comes of it -------------------------------------------------------------------------------------------------


def _together(rows: DataFrame, made: DataFrame, by: Column) -> DataFrame:
    """Each row's edits, then the row, in order within what ``by`` deals out."""
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))}
    a = made.select("at", F.lit(0).alias("kind"), "conv_id", "code", "state", "letters", "behind", *[v.alias(c) for c, v in none.items()])
    b = rows.select("at", F.lit(1).alias("kind"), "conv_id", F.lit(None).cast("int").alias("code"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("letters"), F.lit(None).cast("int").alias("behind"), "turn", "role", "text")
    return a.unionByName(b).repartition(by).sortWithinPartitions("conv_id", "at", "kind")


Edited = tuple[object, int, int, str, int, int | None, str, str]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Edited]:
    """conv_id, code, state before, letters, state behind, turn, role, text of each row."""
    edit = None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("kind", "conv_id", "code", "state", "letters", "behind", "turn", "role", "text")), strict=True):
            if r[0] == 0:
                edit = r[1:6]
            else:
                yield (*edit, *r[6:])


def lines(row: Edited) -> Iterator[tuple[str, int | None, str, str]]:
    """letter, turn, role, text of what a row becomes; text and role of a deleted one are its own."""
    _, _, s, letters, _, turn, role, text = row
    for x in letters:
        if x == "I":
            yield x, None, ROLE[s], ""
            s = NEXT[s]
        elif x == "R":
            yield x, turn, ROLE[s], text
        else:
            yield x, turn, role, text


def repaired(conversations: DataFrame) -> DataFrame:
    """All edits with what they leave: conv_id, at (in order within a conversation), step, edit, turn, role, text. Deleted
    rows are there with edit D. Rows are dealt out evenly, whatever the lengths of conversations."""
    rows = in_order(conversations)
    made = edits(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [conv_type, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "at", "step", "edit", "turn", "role", "text"])

        for b in batches:
            out = []
            for at, row in zip(b.column("at").to_pylist(), zip(*(b.column(c).to_pylist() for c in ("conv_id", "code", "state", "letters", "behind", "turn", "role", "text")), strict=True), strict=True):
                out += [(row[0], at, k, *x) for k, x in enumerate(lines(row))]
            if out:
                yield flush(out)

    joined = made.drop("conv_id").join(rows, "at").select("at", "conv_id", "code", "state", "letters", "behind", "turn", "role", "text")
    body = joined.mapInArrow(run, f"conv_id {kind}, at long, step int, edit string, turn long, role string, text string")
    last = made.groupBy("conv_id").agg(F.max(F.struct("at", "behind", "code")).alias("x")).select("conv_id", "x.*")
    more = F.when(F.col("behind") == 1, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("behind") == 2, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    ends = last.select("conv_id", "at", F.posexplode(more).alias("k", "role")).select("conv_id", "at", (F.col("k") + 1000).cast("int").alias("step"), F.lit("I").alias("edit"), F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
    return body.unionByName(ends)


class _Digest:
    """What op11 says of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.counts, self.illegal, self.cost = conv, [0, 0, 0, 0], 0, 0
        self.low = self.high = self.turn = None
        self.turns, self.before, self.audit, self.state = 0, None, [], 0
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, row: Edited) -> None:
        _, code, _, letters, self.state, turn, role, _ = row
        initial, fault = divmod(code, 4)
        self.counts[fault] += 1
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        for x, _, r, text in lines(row):
            self.line(x, r, text)
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[x] + (TRUNCATED if fault == CUT_OFF and x in "KR" else 0)

    def line(self, letter: str, role: str, text: str) -> None:
        self.audit.append(letter)
        if letter != "D":
            self.hash.update(("\n" * self.begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.begun = True

    def row(self) -> tuple:
        for x in tail(self.state):
            self.line(x, ROLE[self.state], "")
            self.cost += INSERT
            self.state = NEXT[self.state]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.counts[BLANK], self.counts[REPEAT], self.counts[CUT_OFF], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def op11(conversations: DataFrame) -> DataFrame:
    """The repair query: what is wrong with each damaged conversation, the edits, and the digest of the repaired one."""
    rows = in_order(damaged(conversations))
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = to_arrow_type(rows.schema["conv_id"].dataType)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", *names])
            out.clear()
            return got

        out: list[tuple] = []
        now: _Digest | None = None
        for row in _rows(batches):
            if now is None or now.conv != row[0]:
                if now is not None:
                    out.append(now.row())
                now = _Digest(row[0])
            now.add(row)
            if len(out) >= 1000:
                yield flush()
        if now is not None:
            out.append(now.row())
            yield flush()

    longs = ", ".join(f"{c} long" for c in names[:6])
    found = _together(rows, edits(rows), F.col("conv_id")).mapInArrow(run, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")
    ids = conversations.select("conv_id").distinct()
    ids = ids.select("conv_id").join(found.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    empty = {**{c: F.lit(0).cast("long") for c in names[:6]}, "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return ids.select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])


OP11_SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x::UBIGINT], list_transform(range(8), lambda z: z::UBIGINT)),
    lambda c, i: CASE WHEN c & 1::UBIGINT = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: ascii(s)::UBIGINT) AS bytes
  FROM conversations
), hashed AS MATERIALIZED (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::UBIGINT], bytes),
    lambda c, b: xor(t[CAST((xor(c, b) & 255::UBIGINT) + 1 AS BIGINT)], c >> 8)), 4294967295::UBIGINT) % 20 AS h
  FROM keyed, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE h <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), sha256(role || ':' || text)) - 1 AS i
  FROM (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, * FROM hurt)
), judged AS (
  SELECT *, left(role, 1) AS x, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain,
    row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS px
  FROM ordered
), r AS MATERIALIZED (
  SELECT *, plain = '' AS blank, plain <> '' AND again AS dup, plain <> '' AND NOT again AND right(plain, 1) NOT IN ('.', '!', '?') AS trunc,
    CASE WHEN plain = '' OR again THEN 1000000000 WHEN right(plain, 1) IN ('.', '!', '?') THEN 0 ELSE 5 END AS stay
  FROM judged
), b AS (
  SELECT g, count(*) AS i, [0, 10, 5, 0]::BIGINT[] AS v FROM r GROUP BY g
  UNION ALL
  SELECT g, i, [least(w[1], 5 + w[3], 10 + w[4]), least(w[2], 5 + w[3], 10 + w[4]), least(w[3], 5 + w[4], 10 + w[3]), least(w[4], 5 + w[3], 10 + w[4])]
  FROM (SELECT r.g, r.i, [
      least(2 + v[1], stay + 1 + v[3], CASE x WHEN 's' THEN stay + v[2] WHEN 'u' THEN stay + v[3] ELSE 1000000000 END),
      least(2 + v[2], stay + 1 + v[3], CASE x WHEN 'u' THEN stay + v[3] ELSE 1000000000 END),
      least(2 + v[3], stay + 1 + v[4], CASE x WHEN 'a' THEN stay + v[4] ELSE 1000000000 END),
      least(2 + v[4], stay + 1 + v[3], CASE x WHEN 'u' THEN stay + v[3] ELSE 1000000000 END)]::BIGINT[] AS w
    FROM b JOIN r ON r.g = b.g AND r.i = b.i - 1)
), costs AS MATERIALIZED (SELECT * FROM b),
walk AS (
  SELECT g, 0::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS out, max(i) AS n FROM costs GROUP BY g
  UNION ALL
  SELECT g, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN k ELSE nx END, audit || e,
    CASE e WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || text)
      ELSE list_append(out, CASE s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END, n
  FROM (
    SELECT w.*, r.role, r.text, CASE s WHEN 3 THEN 4 ELSE 3 END AS nx,
      CASE WHEN s = 1 AND x = 's' THEN 2 WHEN s <> 3 AND x = 'u' THEN 3 WHEN s = 3 AND x = 'a' THEN 4 END AS k,
      CASE WHEN r.i IS NOT NULL AND 2 + f.v[s] = c.v[s] THEN 'D'
        WHEN 5 + c.v[CASE s WHEN 3 THEN 4 ELSE 3 END] = c.v[s] THEN 'I'
        WHEN stay + f.v[CASE WHEN s = 1 AND x = 's' THEN 2 WHEN s <> 3 AND x = 'u' THEN 3 WHEN s = 3 AND x = 'a' THEN 4 END] = c.v[s] THEN 'K' ELSE 'R' END AS e
    FROM walk w JOIN costs c ON c.g = w.g AND c.i = w.i LEFT JOIN r ON r.g = w.g AND r.i = w.i LEFT JOIN costs f ON f.g = w.g AND f.i = w.i + 1
    WHERE w.i < w.n OR s IN (2, 3)
  )
), done AS (
  SELECT w.g, audit, sha256(array_to_string(out, chr(10))) AS repaired_sha256, c.v[1] AS cost
  FROM walk w JOIN costs c ON c.g = w.g AND c.i = 0 WHERE w.i = w.n AND s IN (1, 4)
), sums AS (
  SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
    count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY g
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN (SELECT * FROM sums JOIN done USING (g)) d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
