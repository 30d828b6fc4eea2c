"""The bound of a margin is the exact quantile over every training row, each told by a model that hasn't learned it."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import language
from tickloom.llm.common import small_batches


def test_every_training_row_counts(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 10))))
    books = {k: [word() for _ in range(150)] for k in ("aa", "bb")}
    rows = [(i, " ".join(rng.choice(books[k], int(rng.integers(2, 40)))), k) for i, k in enumerate(list(books) * 1500)]
    rows += [(5000, None, "aa"), (5001, "some words", None), (5002, None, None)]
    small_batches(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(5))
    margins, seen = [], 0
    for k in range(5):
        model = language.fit(docs.where(part != k), "text", "lang", F.col("doc_id"))
        c = language.Classifier(model, 0.0)
        for r in docs.where(part == k).where("text IS NOT NULL AND lang IS NOT NULL").collect():
            lang, _, margin, _ = c.one(r["text"])
            seen += 1
            if lang == r["lang"] and margin > 0:
                margins.append(margin)
    assert seen == 3000
    margins.sort()
    assert abs(language.margin_bound(docs) / (0.999 * margins[int(language.MAX_LOST * len(margins))]) - 1) < 1e-9
    assert language.judged(docs).count() == 3000
