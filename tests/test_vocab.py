"""Tokenizer, vocabulary order, sequences, padding, masks."""

from pyspark.sql import functions as F

from gradeflow.operators import vocab as V


def test_keras_tokens(spark):
    df = spark.createDataFrame([(1, "Hello, World! it's  a-b\tc\nD")], "essay_id long, essay string")
    toks = V.tokenize(df).first()["tokens"]
    assert toks == ["hello", "world", "it's", "a", "b", "c", "d"]


def test_vocab_order_and_sequences(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c a d")], "essay_id long, essay string")
    voc = {r["word"]: (r["count"], r["index"]) for r in V.fit_vocab(df).collect()}
    # counts desc, ties by first appearance: b(2) a(2) c d
    assert voc == {"b": (2, 1), "a": (2, 2), "c": (1, 3), "d": (1, 4)}
    seq = V.texts_to_sequences(df, V.fit_vocab(df), num_words=3).orderBy("essay_id").collect()
    assert [r["seq"] for r in seq] == [[1, 2, 1], [2]]
    padded = V.token_mask(V.pad_sequences(V.texts_to_sequences(df, V.fit_vocab(df)), "seq", 4))
    r = padded.orderBy("essay_id").first()
    assert r["padded"] == [1, 2, 1, 0] and r["mask"] == [1, 1, 1, 0]
    pre = df.select(V.pad_column(F.array(F.lit(1), F.lit(2), F.lit(3)), 2, "pre", "pre").alias("p")).first()["p"]
    assert pre == [2, 3]


def test_clean_oov_and_hierarchy(spark):
    df = spark.createDataFrame([(1, "a b. c"), (2, "")], "essay_id long, essay string")
    voc = V.fit_vocab(df)
    h = V.encode_hierarchical(df, voc, max_sents=3, max_words=2).orderBy("essay_id").first()["matrix"]
    assert len(h) == 3 and all(len(r) == 2 for r in h)
    seqs = V.texts_to_sequences(df, voc, num_words=None)
    assert V.clean_oov(seqs, "seq", 3).count() == 1  # id 3 ('c') reaches the size
