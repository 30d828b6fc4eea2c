"""The training-data operators find all there is to find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language, mixing, toxicity
from tickloom.llm.common import small_batches


def test_repeated_passages_are_all_found(spark):
    model = toxicity.Model({"grumblex$": (9.0, 4.0), "snarlox$": (9.0, 4.0)})
    model.k = 0.05
    plain = " ".join(["word"] * 60)
    texts = [" ".join([plain, "grumblex snarlox grumblex"] * 10), " ".join(["grumblex"] * 30)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", toxicity.detect("text", model).alias("x")).orderBy("i").collect()
    assert [texts[0][p["start"] : p["end"]] for p in got[0]["x"]["passages"]] == ["grumblex snarlox grumblex"] * 10
    assert [(p["start"], p["end"], p["score"]) for p in got[1]["x"]["passages"]] == [(0, len(texts[1]), 120.0)]


def test_a_word_of_few_toxic_documents_is_learned(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(7600):
        toxic = i < 1600
        words = [f"word{k}" for k in rng.integers(0, 300, 12)]
        if toxic:
            words[3] = "zzrare" if i < 12 else "grumblex"  # 12 of 1600: under a hundredth
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    small_batches(spark)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert model.word("zzrare") > 0
    assert model.word("grumblex") > 0
    assert model.word("word7") == 0


def test_a_language_never_learned_is_rejected(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(3, 10))))
    books = {k: [word() for _ in range(150)] for k in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rng.choice(books[k], 60)), k) for i, k in enumerate(list(books) * 400)]
    rows += [(i, " ".join(word() for _ in range(60)), None) for i in range(5000, 5050)]
    small_batches(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["rejected"] for r in language.op4(docs).collect()}
    assert all(got[i] for i in range(5000, 5050))
    assert sum(got[i] for i in range(1200)) <= 24
    kept = {r["doc_id"] for r in language.stage(spark, docs, "").collect()}
    assert kept == {i for i, x in got.items() if not x}


def test_the_bound_on_sources_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, "some words here", f"s{i}") for i in range(3)], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs, max_patterns=3).count() == 3
    with pytest.raises(ValueError, match="over 2 sources"):
        mixing.mix_documents(docs, max_patterns=2)
