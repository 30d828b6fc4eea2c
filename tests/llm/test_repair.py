"""Repair of conversations against a plain dynamic program, and each case that the docstring defines."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_edits(rows):
    """Cheapest edits by (cost, letters) of every suffix and state, nothing stored but the whole table."""
    follow = {"": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def renamed(state):
        return next(x for x in follow[state] if x != "s")

    table = {(len(rows), ""): (0, ""), (len(rows), "a"): (0, "")}
    for i in range(len(rows), -1, -1):
        best = {}
        for state in follow:
            options = [table[i, state]] if i == len(rows) and (i, state) in table else []
            if i < len(rows):
                role, fault = rows[i][0], rows[i][2]
                c, e = table[i + 1, state]
                options.append((c + 2, "D" + e))
                if fault not in ("blank", "duplicate"):
                    stay = 5 * (fault == "truncated")
                    if role[:1] in follow[state]:
                        c, e = table[i + 1, follow[state][role[:1]]]
                        options.append((c + stay, "K" + e))
                    c, e = table[i + 1, renamed(state)]
                    options.append((c + stay + 1, "R" + e))
            best[state] = options
        done = {s: min(o) if o else None for s, o in best.items()}
        for _ in range(3):
            for s in follow:
                after = done[renamed(s)]
                if after is not None:
                    new = (after[0] + 5, "I" + after[1])
                    done[s] = new if done[s] is None else min(done[s], new)
        table |= {(i, s): v for s, v in done.items()}
    cost, letters = table[0, ""]
    out, state, i = [], "", 0
    for x in letters:
        if x == "D":
            i += 1
            continue
        role = rows[i][0] if x == "K" else names[renamed(state)]
        out.append(f"{role}:{'' if x == 'I' else rows[i][1]}")
        state = follow[state][role[:1]]
        i += x != "I"
    return cost, letters, "\n".join(out)


def plain(rows):
    """op11's row of one conversation from its rows, given in any order."""
    hurt = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else text.translate({ord(x): None for x in ".!?"}) if h == 2 else text
        hurt += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64], hashlib.sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, judged = set(), []
    for _, role, text in hurt:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, letters, body = plain_edits(judged)
    turns = [t for t, _, _ in hurt if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    count = lambda f: sum(j[2] == f for j in judged)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256(body.encode()).hexdigest()


def made(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", None, "", "ursa"]
    texts = ["Yes.", "no", "Why?", "", None, " \n", "Go on!\n", "so.. ", "x" * 70 + "a.", "x" * 70 + "b."]
    turn = lambda: None if rng.random() < 0.05 else int(rng.integers(0, n + 3))
    pick = lambda: (roles[min(int(rng.exponential(1.2)), 6)], texts[int(rng.integers(0, 10))] if rng.random() < 0.4 else f"word {int(rng.integers(0, 9999))}.")
    return [(conv, turn(), *pick()) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = [r for c in range(120) for r in made(rng, c, int(rng.integers(1, 14)))]
    return out + made(rng, None, 9) + made(rng, 500, 700) + [(600, 4, "user", "again and again.")] * 300


def test_every_conversation_against_a_plain_program(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in repair.op11(df).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == {c: plain(g) for c, g in groups.items()}


def test_order_is_global_and_pieces_meet(spark, rows):
    """Many partitions, so that the long conversation is a chain of pieces; the edits are the same."""
    df = spark.createDataFrame(rows, SCHEMA)
    few = repair.op11(df).orderBy("conv_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = repair.in_order(repair.damaged(df)).collect()
        many = repair.op11(df).orderBy("conv_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r["at"] >> repair.PART_BITS for r in placed if r["conv_id"] == 500}) > 3
    key = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["turn"] is not None, r["turn"] or 0)
    assert [key(r) for r in sorted(placed, key=lambda r: r["at"])] == sorted(map(key, placed))
    assert few == many


def test_repaired_rows_alternate(spark, rows):
    got = repair.repaired(spark.createDataFrame(rows, SCHEMA)).where("edit <> 'D'").orderBy("conv_id", "at", "step").collect()
    roles = {}
    for r in got:
        roles[r["conv_id"]] = roles.get(r["conv_id"], "") + r["role"][:1]
    for x in roles.values():
        x = x.removeprefix("s")
        assert x == "ua" * (len(x) // 2)
    kept = [r for r in got if r["edit"] == "K"]
    assert kept
    assert all(r["text"] is not None for r in got)


def test_blocks_give_the_same_walk():
    rng = np.random.default_rng(5)
    w = repair.Walker()
    end = w.number(repair.END)
    for n in (1, 2, 3, 10, 101, 400):
        codes = bytes(rng.integers(0, 16, n).astype(np.uint8))
        size, marks = w.checkpoints(codes, end)
        assert len(marks) <= size + 1
        whole, vectors = [end], []
        for c in reversed(codes):
            whole.append(w.step(whole[-1], c))
        vectors = whole[::-1]
        assert [marks[k] for k in range(len(marks))] == [vectors[k * size] for k in range(len(marks))]
        s, walk = 0, []
        for i, c in enumerate(codes):
            letters, t = w.walk(vectors[i + 1], c, s)
            walk.append((s, letters, t))
            s = t
        assert walk == list(w.edits(codes, end, 0))


def test_matrices_compose():
    rng = np.random.default_rng(6)
    a, b = (bytes(rng.integers(0, 16, n).astype(np.uint8)) for n in (30, 50))
    x, y, z = repair.matrix(a), repair.matrix(b), repair.matrix(a + b)
    joined = [[min(min(x[s][k] + y[k][t] for k in range(4)), repair.FAR) for t in range(4)] for s in range(4)]
    assert [[min(v, repair.FAR // 2) for v in r] for r in joined] == [[min(v, repair.FAR // 2) for v in r] for r in z]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.op11(empty).count() == 0
    # 0:18 and the like are dropped by their key; a conversation with no row left gives zeros.
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(7, gone, "user", "Hi."), (8, None, None, None)], SCHEMA)
    clash = df.withColumns({c: F.lit(f"own {c}") for c in ("at", "code", "h", "r", "t", "salt", "kind", "letters", "copy", "key", "mark")})
    got = {r["conv_id"]: r for r in repair.op11(clash).collect()}
    assert got[7][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[8]["blank"] + got[8]["duplicate"] >= 1
    assert got[8]["cost"] == 2 * len(got[8]["audit"])
