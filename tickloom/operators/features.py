"""Feature tables put together, and what a forest finds in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.flags import flag_features, indicator_groups
from tickloom.operators.structure import feature_groups, market_structure

KEYS = ["symbol", "tf", "ts", "bar_seq"]


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables' columns by bar; where names clash the first table's count."""
    more = [c for c in second.columns if c in KEYS or c not in first.columns]
    return first.join(second.select(more), KEYS)


def all_features(bars: DataFrame, tf: str = "5m") -> DataFrame:
    """Market structure and the flag library side by side."""
    return merged(market_structure(bars), flag_features(bars, tf))


def forest_importances(rows: DataFrame, features: list[str], label: str = "label", trees: int = 50, seed: int = 7) -> DataFrame:
    """feature, category, importance of a random forest, largest first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed)]).fit(data)
    groups = {n: g for g, ns in (feature_groups(features) | indicator_groups(features)).items() for n in ns}
    got = model.stages[-1].featureImportances.toArray()
    return rows.sparkSession.createDataFrame([(f, groups.get(f, "Other"), float(v)) for f, v in zip(features, got, strict=True)], "feature string, category string, importance double").orderBy(F.desc("importance"), "feature")


def category_importances(importances: DataFrame) -> DataFrame:
    return importances.groupBy("category").agg(F.sum("importance").alias("total"), F.avg("importance").alias("mean"), F.count("*").alias("n")).orderBy(F.desc("total"), "category")
