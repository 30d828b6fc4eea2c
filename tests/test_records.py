"""Records as a log against a dict, and failures kept with their series."""

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources import store
from tickloom.sources.records import KIND, Records
from tickloom.streaming.quarantine import Quarantine, guarded


def rows(spark, *items):
    return spark.createDataFrame([(k, i, p, datetime(2024, 1, 1), n, "{}") for k, i, p, n in items], KIND).coalesce(1)


def test_random_operations(spark, tmp_path):
    rng = np.random.default_rng(4)
    r, want = Records(spark, str(tmp_path / "r")), {}
    ids, kinds = ["1", "2", "3"], ["conversation", "message", "strategy"]
    for step in range(40):
        kind, i = kinds[rng.integers(3)], ids[rng.integers(3)]
        match rng.integers(4):
            case 0 | 1:
                parent = [None, *ids][rng.integers(4)]
                r.put(rows(spark, (kind, i, parent, f"n{step}")))
                want[kind, i] = (parent, f"n{step}")
            case 2:
                r.rename(kind, i, f"r{step}")
                if (kind, i) in want:
                    want[kind, i] = (want[kind, i][0], f"r{step}")
            case 3:
                cascade = [None, "message"][rng.integers(2)]
                r.delete(kind, i, cascade)
                want.pop((kind, i), None)
                want = {k: (None if v[0] == i else v[0], v[1]) for k, v in want.items() if not (v[0] == i and k[0] == cascade)}
        if step % 10 == 9:
            if step == 29:
                assert r.compact(settle=0) > 5
            got = {(x["kind"], x["id"]): (x["parent"], x["name"]) for x in r.all().collect()}
            assert got == want, step
    assert Records(spark, str(tmp_path / "r")).all().count() == len(want)  # another process sees the same


def test_a_put_writes_only_its_rows(spark, tmp_path):
    r = Records(spark, str(tmp_path / "r"))
    r.put(rows(spark, *[("message", str(i), None, "x") for i in range(500)]))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    r.put(rows(spark, ("message", "7", None, "y")))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert before.items() <= after.items()
    assert len(after) == len(before) + 1
    assert r.get("message", "7").first()["name"] == "y"
    assert r.list("message", 3).count() == 3
    assert r.list("other").count() == 0


def test_compaction_keeps_what_comes_after(spark, tmp_path):
    r = Records(spark, str(tmp_path / "r"))
    assert r.compact(0) == 0
    r.put(rows(spark, ("a", "1", None, "x"), ("a", "2", "1", "y")))
    r.rename("a", "1", "z")
    assert r.compact(settle=3600) == 0  # too young
    assert r.compact(settle=0) == 2
    r.delete("a", "1", cascade="a")
    assert r.all().count() == 0
    r.put(rows(spark, ("a", "1", None, "new")))
    assert [(x["id"], x["name"]) for x in r.all().collect()] == [("1", "new")]


SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("n", T.LongType())])


def work(bad):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["symbol"].iloc[0]
        if s in bad:
            raise ValueError(f"bad {s}")
        return pd.DataFrame({"symbol": [s], "n": [len(pdf)]})

    return of


def test_one_bad_series_of_many(spark, tmp_path):
    bars = spark.createDataFrame([(s, i) for s in "ABCDE" for i in range(ord(s) - 60)], "symbol string, i int")
    q = Quarantine(spark, str(tmp_path / "q"), "count", ["symbol"], give_up=3)
    seen = []

    def write(df):
        seen.append({r["symbol"]: r["n"] for r in df.collect()})

    assert q.run(bars, work("C"), SCHEMA, write) == {"ok": 4, "failed": 1, "skipped": 0}
    assert seen[-1] == {"A": 5, "B": 6, "D": 8, "E": 9}
    got = q.failures().collect()
    assert [(r["symbol"], r["runs"]) for r in got] == [("C", 1)]
    assert got[0]["error"].startswith("ValueError: bad C (line ")
    # The next run takes up only the bad one.
    assert q.run(bars, work("C"), SCHEMA, write, only_due=True) == {"ok": 0, "failed": 1, "skipped": 0}
    assert seen[-1] == {}
    assert q.failures().first()["runs"] == 2
    assert q.run(bars, work(""), SCHEMA, write, only_due=True) == {"ok": 1, "failed": 0, "skipped": 0}
    assert seen[-1] == {"C": 7}
    assert q.failures().count() == 0
    assert q.run(bars, work(""), SCHEMA, write, only_due=True) == {"ok": 0, "failed": 0, "skipped": 0}


def test_a_series_that_keeps_failing_is_given_up(spark, tmp_path):
    bars = spark.createDataFrame([("A", 1), ("B", 1)], "symbol string, i int")
    q = Quarantine(spark, str(tmp_path / "q"), "count", ["symbol"], give_up=2)
    for _ in range(2):
        q.run(bars, work("B"), SCHEMA, lambda df: None)
    assert q.due().count() == 0
    assert q.run(bars, work(""), SCHEMA, lambda df: None) == {"ok": 1, "failed": 0, "skipped": 1}
    other = Quarantine(spark, str(tmp_path / "q"), "other", ["symbol"])
    assert other.failures().count() == 0


def test_work_that_gives_other_columns_is_a_failure(spark):
    got = guarded(spark.createDataFrame([("A", 1)], "symbol string, i int"), ["symbol"], lambda pdf: pdf[["symbol"]], SCHEMA).first()
    assert (got["symbol"], got["n"]) == ("A", None)
    assert "gave no ['n']" in got["__error"]


def test_features_come_by_the_chain(spark, tmp_path):
    rows_ = [(s, "1h", datetime(2024, 1, 1, h), h, float(h)) for s in "AB" for h in range(5)]
    bars = spark.createDataFrame(rows_, "symbol string, tf string, ts timestamp_ntz, bar_seq int, close double")
    asked = []

    def compute(b):
        asked.append({r["symbol"] for r in b.select("symbol").distinct().collect()})
        return b.select("symbol", "tf", "ts", F.col("close").alias("f"))

    root, cache = str(tmp_path / "f"), {}
    a = bars.where("symbol = 'A'")
    assert store.features_for(spark, root, a, compute, cache).count() == 5
    assert store.features_for(spark, root, a, compute, cache).count() == 5  # from the session
    assert store.features_for(spark, root, bars, compute).count() == 10  # B is computed and stored
    assert store.features_for(spark, root, bars, compute).count() == 10  # both are stored
    assert asked == [{"A"}, {"B"}]
