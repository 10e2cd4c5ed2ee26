"""Hand-made cases for the essay features."""

import math

from pyspark.sql import functions as F

from gradeflow.operators import features as FT


def _row(spark, text):
    df = spark.createDataFrame([(1, text)], "essay_id long, essay string")
    return FT.row_features(df).first()


def test_counts_and_ratios(spark):
    r = _row(spark, "Hello, world! Is this   fine? Yes, it is.")
    assert r["num_words"] == 8
    assert r["num_commas"] == 2
    assert r["num_exclamation_marks"] == 1
    assert r["num_question_marks"] == 1
    assert r["num_sentences"] == 3
    assert math.isclose(r["average_sentence_length"], 8 / 3)
    # characters of the blank tokens / their number
    toks = "Hello, world! Is this fine? Yes, it is.".split()
    assert math.isclose(r["average_word_length"], sum(map(len, toks)) / len(toks))
    # lemma tokens: words, numbers, single symbols
    assert r["num_lemmas"] == 8 + 5


def test_empty_and_punctuation_only(spark):
    r = _row(spark, "")
    assert r["num_words"] == 0 and r["average_word_length"] is None
    assert r["automated_readability_index"] is None and r["smog_index"] is None
    r = _row(spark, "?!...")
    assert r["num_words"] == 1 and r["num_sentences"] == 1
    assert r["flesch_kincaid_grade"] is None and r["syllables_count"] == 0


def test_readability_formulas(spark):
    text = "The cat sat. A beautiful elephant walked slowly. Dogs bark."
    r = _row(spark, text)
    words = ["The", "cat", "sat", "A", "beautiful", "elephant", "walked", "slowly", "Dogs", "bark"]
    import re

    syl = [max(1, len(re.findall("[aeiouy]+", w.lower()))) for w in words]
    W, S, C, Y = len(words), 3, sum(map(len, words)), sum(syl)
    H = sum(1 for s in syl if s >= 3)
    assert math.isclose(r["automated_readability_index"], 4.71 * C / W + 0.5 * W / S - 21.43)
    assert math.isclose(r["flesch_kincaid_grade"], 0.39 * W / S + 11.8 * Y / W - 15.59)
    assert math.isclose(r["gunning_fog"], 0.4 * (W / S + 100 * H / W))
    assert r["smog_index"] == 1.043 * math.sqrt(30 * H / S) + 3.1291
    assert r["syllables_count"] == Y


def test_word_list_features_require_lists(spark):
    df = spark.createDataFrame([(1, "a b")], "essay_id long, essay string")
    try:
        FT.word_list_features(df, FT.WordLists())
    except ValueError as e:
        assert "lexicon" in str(e)
    else:
        raise AssertionError("missing lexicon must raise")


def test_word_list_features(spark):
    df = spark.createDataFrame([(1, "The dog runs. The dog, happy!"), (2, "")], "essay_id long, essay string")
    lex = spark.createDataFrame([("dog", "NOUN"), ("runs", "VERB"), ("happy", "ADJ")], "word string, tag string")
    dic = spark.createDataFrame([("the",), ("dog",)], "word string")
    easy = spark.createDataFrame([("the",), ("dog",)], "word string")
    out = FT.generate_features(df, FT.WordLists(lex, dic, easy)).orderBy("essay_id").collect()
    a, b = out
    assert a["num_nouns"] == 2 and a["num_verbs"] == 1 and a["num_adjectives"] == 1
    # distinct lower-case blank tokens not in the dictionary: runs. dog, happy!
    assert a["num_spelling_errors"] == 3
    # distinct words outside the easy list with >= 2 syllables: happy
    assert a["difficult_word_count"] == 1
    assert b["num_nouns"] == 0 and b["dale_chall_index"] is None


def test_counts_in_place_match_the_joined_ones(spark):
    texts = ["", None, "The cat, the CAT and a béautiful dog!", "cat cat cat", "?!...", "don't re-use it; It's fine", "x" * 5000, "the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "essay_id long, essay string")
    words = lambda *rows: spark.createDataFrame(list(rows), "word string")
    lists = FT.WordLists(
        spark.createDataFrame([("cat", "NOUN"), ("cat", "VERB"), ("dog", "PROPN"), ("and", "CCONJ"), (None, "NOUN")], "word string, tag string"),
        words(("the",), ("cat",), ("it;",), ("the",)), words(("the",), ("a",), ("it",), (None,)))
    got = {r["essay_id"]: tuple(r[c] for c in FT.COUNTS) for r in FT.word_list_features(df, lists).collect()}
    want = {r["essay_id"]: tuple(r[c] for c in FT.COUNTS)
            for r in FT._joined_counts(df, FT.word_facts(lists), "essay_id", "essay").collect()}
    none = (0,) * len(FT.COUNTS)
    assert got == {i: want.get(i, none) for i in range(len(texts))}
    assert got[3] == (3, 3, 0, 0, 0, 0, 3, 0) and got[0] == got[1] == none
    spark.conf.set("gradeflow.broadcast.maxBytes", "1")
    try:
        joined = FT.generate_features(df, lists).orderBy("essay_id").collect()
    finally:
        spark.conf.unset("gradeflow.broadcast.maxBytes")
    assert joined == FT.generate_features(df, lists).orderBy("essay_id").collect()
