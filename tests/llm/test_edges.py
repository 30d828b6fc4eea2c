"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, decontaminate, fingerprint, jaccard, language, mixing, privacy, substring, tokencount, toxicity
from tickloom.llm.common import small_batches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5),
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5),
    (2, "the quick brown fox jumps over the lazy dog and runs away", None, None, None),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "der schnelle braune fuchs springt über den faulen hund", "de", "b", 3),
    (5, "   \n\t ", "de", "c", 5),
    (6, "x", "de", "c", 1),
    (7, LONG, "en", "d", len(LONG)),
    (8, "12345 %%% 67", "en", None, 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 1, None), (3, 0, 1), (3, 0, 0), (None, 0, 1), (7, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(10, "quick brown fox"), (11, None), (12, ""), (None, "lazy dog"), (10, "lazy dog")], "item_id long, text string")


def case(op, docs, labels, items):
    """Every operator on these rows, columns that clash with what it makes included."""
    return {
        "op1": lambda: mixing.mix_documents(docs),
        "op2": lambda: substring.deduplicated(docs),
        "op4": lambda: language.identified(docs),
        "op5": lambda: decontaminate.decontaminated(docs, items),
        "op5 by shuffle": lambda: decontaminate.decontaminated(docs, items, 0),
        "op6": lambda: privacy.replaced(docs, b"k"),
        "op7": lambda: jaccard.op7(docs),
        "op8": lambda: tokencount.op8(docs),
        "op9": lambda: fingerprint.op9(docs),
        "op10": lambda: toxicity.op10(docs, labels),
    }[op]()


#: Names that the operators and stages use or add themselves.
CLASH = ["size", "source_size", "target", "copies", "taken", "items", "n_hit", "n_words", "found", "spans", "mask", "k", "n", "kind", "norm", "h", "g", "rid", "salt", "toxic", "tokens"]


@pytest.fixture(scope="module")
def clash(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.mark.parametrize("op", ["op1", "op2", "op4", "op5", "op5 by shuffle", "op6", "op7", "op8", "op9", "op10"])
def test_each_row_has_a_result(clash, labels, items, op):
    made = case(op, clash, labels, items)
    rows = made.collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    first, second = (r for r in rows if r["doc_id"] == 1)
    assert first == second  # repeated rows agree
    if "size" in made.columns:
        assert {r[c] for r in rows for c in CLASH} == {f"own {c}" for c in CLASH}
    assert case(op, clash.where("false"), labels.where("false"), items.where("false")).count() == 0


def test_both_ways_of_decontamination_agree(clash, items):
    a, b = (sorted(map(str, decontaminate.decontaminated(clash, items, m).select("doc_id", "__found").collect())) for m in (10**6, 0))
    assert a == b


@pytest.mark.parametrize("name", ["language", "jaccard", "decontaminate", "privacy", "mixing"])
def test_stages_keep_columns(spark, clash, items, tmp_path, name):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = {"language": language, "jaccard": jaccard, "decontaminate": decontaminate, "privacy": privacy, "mixing": mixing}[name].stage
    out = stage(spark, clash, str(tmp_path))
    assert out.columns[: len(clash.columns)] == clash.columns
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) <= len(ROWS)
    assert {r[c] for r in rows for c in CLASH} == {f"own {c}" for c in CLASH}
    assert stage(spark, clash.where("false"), str(tmp_path)).count() == 0


def test_language_rejects_what_has_no_letter(docs):
    got = {r["doc_id"]: r for r in language.op4(docs).collect()}
    for i in (3, 4, 5, 8):
        assert (got[i]["lang_pred"], got[i]["rejected"], got[i]["score"]) == ("und", True, 0.0)


def test_short_texts_and_copies(docs):
    got = {(r["doc_id"]): r for r in jaccard.op7(docs).collect()}
    assert got[2]["class_id"] == 1
    assert got[1]["n_copies"] == 3
    assert got[4]["class_id"] == 4
    assert got[3]["class_id"] == 3


def test_empty_sketches(docs):
    got = {r["doc_id"]: r for r in fingerprint.op9(docs).collect()}
    assert got[3]["fingerprint"] == ""
    assert got[4]["n_chars"] == 0


def test_chat_of_nothing_and_odd_rows(spark):
    assert chat.op3(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1
    odd = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (1, 1, "a>\\b<", "</turn>\n<turn x>"), (None, None, "assistant", "é\\l"), (2, 0, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    names = ["formatted", "loss_spans", "ms", "m", "n", "seq", "event", "parts", "cut", "begun", "last_role", "whole", "turns", "loss", "head"]
    got = {r["conv_id"]: r for r in chat.op3(odd.withColumns({c: F.lit(1) for c in names})).collect()}
    assert got[1]["n_turns"] == 3
    assert got[None]["loss_chars"] == 3
    assert got[2]["loss_chars"] == len(LONG)
    events = chat.as_events(odd).withColumns({c: F.lit(1) for c in names if c not in ("seq", "event")})
    assert chat.fold_events(events).count() == 5


def test_copies_of_one_row_move_once(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 400 + [(2, " ".join([*words[:-1], "x"]))]
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1, 400), (2, 1, 1, 1)}
