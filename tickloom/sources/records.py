"""Small app tables (conversations, messages, strategies) as a log of events.

A put, a rename or a delete appends its own rows and reads nothing. What a record
is comes out at reading: the latest put of its key, the name that a later rename
gave it, nothing if a later delete took it. A delete with ``cascade`` also takes the
children of that kind that were put before it; children of other kinds lose their
parent. ``compact`` writes the records as they are under the number of the last
event that they rest on; readers take the newest such base and the events after it.

Events have rising numbers: nanoseconds of the clock, at least one more than the
last that this writer made. Writers on other machines are ordered as their clocks
are. A compaction leaves out the last ``settle`` seconds, so a writer that is late by
less is not passed over.

Defined results: a rename of a record that isn't there does nothing; a record that
is put again after its delete is there again, with its new parent; of several rows
of one key in a put the greatest counts.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "kind string, id string, parent string, created timestamp, name string, body string"
COLUMNS = [c.split()[0] for c in KIND.split(", ")]
EVENT = KIND + ", op string, cascade string, seq long"


class Records:
    """List, get, put, rename, delete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._last = spark, path.rstrip("/"), 0

    def _paths(self, kind: str) -> list[tuple[int, str]]:
        """Numbers and folders of events or bases that are complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [f.getPath() for f in fs.listStatus(top)]
        return sorted((int(p.getName().partition("-")[0]), p.toString()) for p in found if fs.exists(path(p, "_SUCCESS")))

    def _append(self, rows: DataFrame, op: str, cascade: str | None = None) -> None:
        self._last = seq = max(time.time_ns(), self._last + 1)
        rows = rows.select(*COLUMNS).withColumns({"op": F.lit(op), "cascade": F.lit(cascade).cast("string"), "seq": F.lit(seq)})
        rows.write.parquet(f"{self.path}/events/{seq}-{uuid.uuid4().hex}")

    def events(self, until: int | None = None) -> DataFrame:
        """The newest base as puts, and the events after it."""
        bases = [b for b in self._paths("bases") if until is None or b[0] <= until]
        base = bases[-1] if bases else None
        later = [p for n, p in self._paths("events") if (base is None or n > base[0]) and (until is None or n <= until)]
        paths = [*([base[1]] if base else []), *later]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def _with_seq(self, until: int | None = None) -> DataFrame:
        e = self.events(until)
        row = F.struct("seq", *[c for c in COLUMNS if c not in ("kind", "id")])
        is_op = lambda op: F.col("op") == op
        by = e.groupBy("kind", "id").agg(F.max(F.when(is_op("put"), row)).alias("p"), F.max(F.when(is_op("rename"), F.struct("seq", "name"))).alias("r"), F.max(F.when(is_op("delete"), F.col("seq"))).alias("gone"))
        alive = by.where("p IS NOT NULL AND (gone IS NULL OR gone < p.seq)")
        # Of the deletes of a parent the last that took children of a kind, and the last of all.
        deletes = e.where("op = 'delete'")
        took = deletes.where("cascade IS NOT NULL").groupBy(F.col("id").alias("__parent"), F.col("cascade").alias("__kind")).agg(F.max("seq").alias("__took"))
        any_ = deletes.groupBy(F.col("id").alias("__up")).agg(F.max("seq").alias("__left"))
        out = alive.join(took, (F.col("p.parent") == F.col("__parent")) & (F.col("kind") == F.col("__kind")), "left").where("__took IS NULL OR __took < p.seq")
        out = out.join(any_, F.col("p.parent") == F.col("__up"), "left")
        parent = F.when(F.coalesce(F.col("__left") > F.col("p.seq"), F.lit(False)), None).otherwise(F.col("p.parent"))
        name = F.when(F.col("r.seq") > F.col("p.seq"), F.col("r.name")).otherwise(F.col("p.name"))
        return out.select("kind", "id", parent.alias("parent"), F.col("p.created").alias("created"), name.alias("name"), F.col("p.body").alias("body"), F.col("p.seq").alias("seq"))

    def all(self) -> DataFrame:
        return self._with_seq().drop("seq")

    def list(self, kind: str, limit: int = 50) -> DataFrame:
        return self.all().where(F.col("kind") == kind).orderBy(F.desc("created"), "id").limit(limit)

    def get(self, kind: str, id_: str) -> DataFrame:
        return self.all().where((F.col("kind") == kind) & (F.col("id") == id_))

    def put(self, rows: DataFrame) -> None:
        self._append(rows, "put")

    def _one(self, kind: str, id_: str, name: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(kind, id_, None, None, name, None)], KIND).coalesce(1)

    def rename(self, kind: str, id_: str, name: str) -> None:
        self._append(self._one(kind, id_, name), "rename")

    def delete(self, kind: str, id_: str, cascade: str | None = None) -> None:
        """Also deletes children of the cascade kind; others lose their parent."""
        self._append(self._one(kind, id_), "delete", cascade)

    def compact(self, settle: float = 60.0) -> int:
        """Write the records of all events but the last seconds' as a base, and remove the events and bases that it stands
        for; how many event folders went. Readers that began before must be done, so run it when few are about."""
        until = time.time_ns() - int(settle * 1e9)
        old = [(n, p) for n, p in self._paths("events") if n <= until]
        if not old:
            return 0
        at = old[-1][0]
        rows = self._with_seq(at).select(*COLUMNS, F.lit("put").alias("op"), F.lit(None).cast("string").alias("cascade"), "seq")
        rows.coalesce(1).write.parquet(f"{self.path}/bases/{at}-{uuid.uuid4().hex}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for p in [*[p for _, p in old], *[p for n, p in self._paths("bases") if n < at]]:
            fs.delete(path(p), True)
        return len(old)
