"""The dictionaries come from the words of all training rows; the bound's quantile takes no product of partitions."""

from collections import Counter

from pyspark.sql import functions as F

from tickloom.functions.order import exact_quantile
from tickloom.llm import language
from tickloom.llm.common import small_batches


def test_every_training_row_teaches(spark, monkeypatch):
    small_batches(spark)
    monkeypatch.setattr(language, "DICT_BYTES", 4_000)
    monkeypatch.setattr(language, "HELD_WORDS", 500)
    # More words than a dictionary holds, some behind 7,000 characters: only counts of every word of every row give these.
    rows = [(i, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} " * (1 + i % 7), "aa") for i in range(3000)]
    rows += [(3000 + i, "filler " * 1000 + " ".join(f"deep{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in range(100)), "aa") for i in range(40)]
    rows += [(4000, "z" * 100, "bb"), (4001, None, "bb"), (4002, "nothing", None), (4003, "12 !", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    part = F.pmod(F.col("doc_id"), F.lit(3))
    models = language.fits(docs, "text", "lang", part, 3)
    for k, model in enumerate(models):
        some = [r for r in rows if r[1] is not None and r[2] is not None and (k == 3 or r[0] % 3 != k)]
        n = Counter(w for _, t, lang in some if lang == "aa" for w in language.normal(t).split())
        got = dict(model)["aa"].split()
        assert len(dict(model)["aa"]) <= 4_000 < len(dict(model)["aa"]) + 10
        assert [n[w] for w in got] == sorted(n[w] for w in got)
        assert sorted(n[w] for w in got) == sorted(n.values())[-len(got) :]
        assert dict(language.fit(docs if k == 3 else docs.where(part != k), "text", "lang"))["aa"] == dict(model)["aa"]
    assert dict(models[3])["bb"].split() == [b"z" * 4, b"z" * 32]
    assert dict(models[3])["cc"] == b" "
    assert [k for k, _ in models[3]][0] == "aa"


def test_a_quantile_of_all_rows_is_no_product_of_partitions(spark):
    df = spark.range(0, 1001, 1, 7).select((F.col("id") / 10).alias("x"))
    got = exact_quantile(df, [], "x", 0.25, "q")
    assert got.first()["q"] == 25.0
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
