"""The queries of this package, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import chat, decontaminate, fingerprint, hnsw, jaccard, language, mixing, privacy, repair, substring, tokencount, toxicity, whiten
from tickloom.llm.common import small_batches, table


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(table(spark, sf_dir, "documents"))

    return query


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": _docs(mixing.op1),
        "op2_substring": _docs(substring.op2),
        "op3_chat": lambda spark, d: chat.op3(table(spark, d, "conversations")),
        "op4_language": _docs(language.op4),
        "op5_decontaminate": _contamination,
        "op6_privacy": _docs(privacy.op6),
        "op7_jaccard": _docs(jaccard.op7),
        "op8_tokens": _docs(tokencount.op8),
        "op9_fingerprint": _docs(fingerprint.op9),
        "op10_toxicity": _toxicity,
        "op11_repair": lambda spark, d: repair.op11(table(spark, d, "conversations")),
        "op12_neighbors": lambda spark, d: hnsw.op12(table(spark, d, "embeddings")),
        "op13_whitening": lambda spark, d: whiten.op13(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring": substring.OP2_SQL, "op3_chat": chat.OP3_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op7_jaccard": jaccard.OP7_SQL, "op11_repair": repair.OP11_SQL, "op12_neighbors": hnsw.OP12_SQL}
