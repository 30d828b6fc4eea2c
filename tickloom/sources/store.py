"""Feature tables, app records and the cutting of lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def write_features(features: DataFrame, root: str) -> None:
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "tf").parquet(f"{root}/features")


def stored_features(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/features")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def aligned_features(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Stored features of exactly these bars, only for series in which every bar has them."""
    ts = bars.select("symbol", "tf", "ts")
    gaps = ts.join(features.select("symbol", "tf", "ts"), ["symbol", "tf", "ts"], "left_anti").select("symbol", "tf").distinct()
    return ts.join(gaps, ["symbol", "tf"], "left_anti").join(features, ["symbol", "tf", "ts"])


def features_for(spark: SparkSession, root: str, bars: DataFrame, compute, cache: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features of these bars by a chain: those of the session (``cache``, by root and the bars' plan), those stored that
    cover a series whole, and for the rest computed ones, which are stored. One job over all series."""
    name = f"{root} {bars.semanticHash()}"
    if cache is not None and name in cache:
        return cache[name]
    held = stored_features(spark, root)
    if held is None:
        write_features(cut(compute(bars)), root)
        out = stored_features(spark, root)
    else:
        have = cut(aligned_features(bars, held))
        rest = bars.join(have.select("symbol", "tf").distinct(), ["symbol", "tf"], "left_anti")
        if rest.isEmpty():
            out = have
        else:
            # Laid over what is stored of these series; bars that weren't asked for stay.
            new, keys = cut(compute(rest)), ["symbol", "tf", "ts"]
            stay = held.join(new.select("symbol", "tf").distinct(), ["symbol", "tf"], "left_semi").join(new.select(keys), keys, "left_anti")
            write_features(cut(stay.unionByName(new, allowMissingColumns=True)), root)
            out = have.unionByName(new, allowMissingColumns=True)
    if cache is not None:
        cache[name] = out
    return out


def append_features(spark: SparkSession, root: str, bars: DataFrame, compute, rebuild: int = 600) -> DataFrame:
    """Recompute the last ``rebuild`` bars of each series and lay them over the stored rows; a series with as many new bars
    or none stored is computed whole. Long-memory columns of the tail differ from a full run (a known property)."""
    held = stored_features(spark, root)
    if held is None:
        return features_for(spark, root, bars, compute)
    last = held.groupBy("symbol", "tf").agg(F.max("ts").alias("__last"))
    b = bars.join(last, ["symbol", "tf"], "left")
    w = Window.partitionBy("symbol", "tf")
    b = b.withColumns({"__new": F.sum(F.when(F.col("__last").isNull() | (F.col("ts") > F.col("__last")), 1).otherwise(0)).over(w), "__n": F.count("*").over(w)})
    part = b.where((F.col("__new") >= rebuild) | F.col("__last").isNull() | (F.col("bar_seq") >= F.col("__n") - rebuild)).select(bars.columns)
    new = compute(part)
    keep = held.join(new.select("symbol", "tf", "ts"), ["symbol", "tf", "ts"], "left_anti")
    out = cut(keep.unionByName(new, allowMissingColumns=True))
    write_features(out, root)
    return stored_features(spark, root)
