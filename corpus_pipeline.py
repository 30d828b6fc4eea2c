"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
as it changes them; the last adds how often the mix takes each. Between stages
the documents are written as Parquet in the folder that the cluster shares; each
table is removed when the next one is written, the last one stays, for the result
reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, jaccard, language, mixing, privacy
from tickloom.llm.common import small_batches
from tickloom.session import shared_folder


def _bounded(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language", _bounded(language.stage)),
    ("near_duplicates", _bounded(jaccard.stage)),
    ("decontamination", _bounded(decontaminate.stage)),
    ("privacy", _bounded(privacy.stage)),
    ("mixing", _bounded(mixing.stage)),
]

#: SQL expresses neither the classifier nor the keyed surrogates; the stages are tested against brute force instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
