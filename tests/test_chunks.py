"""Word facts by chunks of texts: the same rows as with broadcast tables, without a row for every token."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import features as FT
from gradeflow.operators import vocab as V
from gradeflow.plans import chunks

TEXTS = [(1, "The cat sat. The dog ran!"), (1, "A cat ran"), (None, "dog dog"), (2, None), (3, ""), (4, "Interesting elephants' tales, the END")]


@pytest.fixture
def essays(spark):
    return spark.createDataFrame(TEXTS, "essay_id long, essay string")


def lists(spark):
    words = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    lexicon = spark.createDataFrame([("cat", "NOUN"), ("dog", "NOUN"), ("ran", "VERB"), ("elephants'", "NOUN"), ("sat", "VERB")], "word string, tag string")
    return FT.WordLists(lexicon, words(["the", "cat", "end"]), words(["the", "cat", "dog"]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_of_tables_beyond_the_bound(spark, essays):
    """Repeated and null ids have the counts of their own text, whatever the size of
    the tables."""
    rows = lambda df: sorted(map(str, df.collect()))
    small = [rows(f(essays, lists(spark))) for f in (FT.generate_features, FT.word_list_features)]
    spark.conf.set("gradeflow.broadcast.maxBytes", "1")
    try:
        large = [f(essays, lists(spark)) for f in (FT.generate_features, FT.word_list_features)]
        assert [rows(x) for x in large] == small
        assert not any("Generate" in plan(x) for x in large)  # no row for each token
        none = FT.WordLists(*[df.filter("false") for df in (lists(spark).lexicon, lists(spark).dictionary, lists(spark).easy_words)])
        assert FT._joined_counts(essays, FT.word_facts(none), "essay_id", "essay").count() == len(TEXTS)
    finally:
        spark.conf.unset("gradeflow.broadcast.maxBytes")


def test_mean_embedding_by_chunks(spark, essays):
    """Rows of one id share the mean of their tokens, a null id has none; a word with
    two vectors counts for each."""
    vec = {"cat": [[1.0, 2.0]], "dog": [[0.5, 0.0], [1.5, -1.0]], "the": [[-1.0, 4.0]]}
    vectors = spark.createDataFrame([(w, v) for w, vs in vec.items() for v in vs], "word string, vec array<float>")
    out = V.mean_embedding(essays, vectors, 2)
    assert "Generate" not in plan(out)
    tokens = {1: "the cat sat the dog ran a cat ran".split(), 4: "interesting elephants' tales the end".split()}
    got = sorted((r["essay_id"] or 0, r["mean_vec"]) for r in out.collect())
    assert [i for i, _ in got] == [0, 1, 1, 2, 3, 4]
    for i, mean in got:
        held = [v for w in tokens.get(i, []) for v in vec.get(w, [[0.0, 0.0]])]
        assert np.allclose(mean, np.mean(held, axis=0) if held else [0.0, 0.0])


def test_mean_embedding_without_texts_or_vectors(spark, essays):
    vectors = spark.createDataFrame([], "word string, vec array<float>")
    assert V.mean_embedding(essays.filter("false"), vectors, 2).count() == 0
    assert V.mean_embedding(essays.filter(F.col("essay") == ""), vectors, 2).collect()[0]["mean_vec"] == [0.0, 0.0]
    assert {tuple(r["mean_vec"]) for r in V.mean_embedding(essays, vectors, 2).collect()} == {(0.0, 0.0)}


def test_word_counts_shuffle_the_lower_cased_text_alone(spark, essays, monkeypatch):
    """F9 to F14 and F19 read the lower-cased text; the text itself stays where it was read."""
    met = []

    def noted(df, *rest):
        met.append(df.columns)
        return chunks.with_word_facts(df, *rest)

    monkeypatch.setattr(FT, "with_word_facts", noted)
    out = FT._joined_counts(essays, FT.word_facts(lists(spark)), "essay_id", "essay")
    assert met == [["essay_id", "_low"]] and out.count() == len(TEXTS)
    assert sorted(r["num_nouns"] for r in out.collect()) == [0, 0, 1, 1, 2, 2]


def test_words_outside_the_table_have_no_answer(spark, essays):
    """Only answers of the table travel back; a chunk without any is met all the same."""
    low = essays.select("essay_id", F.lower("essay").alias("_low"))
    table = spark.createDataFrame([("cat", 1), ("moon", 2), (None, 4)], "word string, bits int")

    def use(texts, facts):
        return pa.table({"n": pa.array([len(texts)], pa.int64()), "words": pa.array([facts["word"].to_pylist()], pa.list_(pa.string()))})

    ask = lambda t: chunks.with_word_facts(low, "_low", [F.col("_low")], t, (0,), use, "n long, words array<string>").collect()
    got = ask(table)
    assert sum(r["n"] for r in got) == len(TEXTS) and [w for r in got for w in r["words"]] == ["cat"]
    none = ask(table.filter("false"))
    assert sum(r["n"] for r in none) == len(TEXTS) and not any(r["words"] for r in none)
