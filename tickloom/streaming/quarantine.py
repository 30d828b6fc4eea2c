"""Work by series whose failures stay with the series.

``guarded`` runs a function on each group; a group that raises gives a row with its
error in place of rows. ``run`` writes what the others gave and notes the failures as
records (kind ``failure``, one a key); the next run may take up just those keys, and a
key that succeeds leaves the list. A failure has the number of runs that it has
failed in; from ``give_up`` on it is only tried when asked for by name.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.records import KIND, Records
from tickloom.sources.store import cut

ERROR = "__error"


def guarded(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """The rows that groups give (schema, which has the keys), with ``__error``, null but in the one row of a group that
    failed, where only the keys and the error stand."""
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema], T.StructField(ERROR, T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            got = work(pdf)
            if missing := [c for c in schema.names if c not in got.columns]:
                raise ValueError(f"the work gave no {missing}")
            return got[schema.names].assign(**{ERROR: None})
        except Exception as e:
            where = traceback.extract_tb(e.__traceback__)[-1]
            row = {c: pdf[c].iloc[0] if c in keys else None for c in schema.names}
            return pd.DataFrame([row | {ERROR: f"{type(e).__name__}: {e} (line {where.lineno} of {where.name})"[:1000]}])[out.names]

    return rows.groupBy(*keys).applyInPandas(run, out)


def key_id(keys: list[str]) -> F.Column:
    return F.to_json(F.struct(*keys))


class Quarantine:
    """The list of failures of one kind of work, kept in records."""

    def __init__(self, spark: SparkSession, path: str, work: str, keys: list[str], give_up: int = 5):
        self.spark, self.records, self.work, self.keys, self.give_up = spark, Records(spark, path), work, keys, give_up

    def failures(self) -> DataFrame:
        """keys, error, runs: one row a key that has failed and not succeeded since."""
        body = "error string, runs long, " + ", ".join(f"{k} string" for k in self.keys)
        rows = self.records.all().where((F.col("kind") == "failure") & (F.col("parent") == self.work))
        return rows.select(F.from_json("body", body).alias("b")).select(*[f"b.{k}" for k in self.keys], "b.error", "b.runs")

    def due(self) -> DataFrame:
        return self.failures().where(F.col("runs") < self.give_up).select(*self.keys)

    def run(self, rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, write: Callable[[DataFrame], None], only_due: bool = False) -> dict[str, int]:
        """Work on all groups (or those due again), write what they gave, note what failed. How many keys went well, failed
        and were skipped as given up."""
        failed_before = cut(self.failures())
        lost = failed_before.where(F.col("runs") >= self.give_up).select(*self.keys)
        todo = rows.join(self.due(), self.keys, "left_semi") if only_due else rows.join(lost, self.keys, "left_anti")
        got = cut(guarded(todo, self.keys, work, schema))
        bad = cut(got.where(F.col(ERROR).isNotNull()).select(*self.keys, ERROR))
        good = got.where(F.col(ERROR).isNull()).drop(ERROR)
        write(good)
        now = bad.join(failed_before.select(*self.keys, F.col("runs").alias("__runs")), self.keys, "left")
        texts = [F.col(k).cast("string").alias(k) for k in self.keys]
        body = F.to_json(F.struct(*texts, F.col(ERROR).alias("error"), (F.coalesce("__runs", F.lit(0)) + 1).alias("runs")))
        notes = now.select(F.lit("failure").alias("kind"), F.concat(F.lit(f"{self.work} "), key_id(self.keys)).alias("id"), F.lit(self.work).alias("parent"), F.current_timestamp().alias("created"), F.lit(self.work).alias("name"), body.alias("body"))
        if not bad.isEmpty():
            self.records.put(notes)
        # Those that were tried again and went well leave the list: one event for all.
        tried = todo.select(*self.keys).distinct()
        mended = cut(failed_before.select(*self.keys).join(tried, self.keys, "left_semi").join(bad, self.keys, "left_anti"))
        if not mended.isEmpty():
            gone = mended.select(F.lit("failure").alias("kind"), F.concat(F.lit(f"{self.work} "), key_id(self.keys)).alias("id"), *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in KIND.split(", ")[2:]])
            self.records._append(gone, "delete")
        n, failed = tried.count(), bad.count()
        return {"ok": n - failed, "failed": failed, "skipped": 0 if only_due else lost.count()}
