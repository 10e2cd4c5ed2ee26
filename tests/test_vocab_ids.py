"""V3 in place against the joined form, and K9's search against a full scan."""

import numpy as np
from pyspark.sql import functions as F

from gradeflow.operators import attention as A
from gradeflow.operators import vocab as V


def test_ids_in_place_match_the_joined_ones(spark):
    texts = ["the cat the", None, "", "?! ...", "dog unknown cat", "Cat CAT béa", "x" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "essay_id long, essay string").repartition(3)
    vocab = spark.createDataFrame([("the", 9, 1), ("cat", 5, 2), ("dog", 3, 3), ("béa", 1, 4), (None, 1, 5)], "word string, count long, index long")
    for cap in (None, 4, 1):
        got = {r["essay_id"]: r["seq"] for r in V.texts_to_sequences(df, vocab, num_words=cap).collect()}
        voc = vocab.select("word", F.col("index").cast("int").alias("wid")).filter(F.col("wid") < (cap or 99))
        want = {r["essay_id"]: r["seq"] for r in V._joined_sequences(df, voc, "essay_id", "essay", "seq").collect()}
        assert got == want
    assert got == {i: [] for i in range(len(texts))}
    spark.conf.set("gradeflow.broadcast.maxBytes", "1")
    try:
        joined = {r["essay_id"]: r["seq"] for r in V.texts_to_sequences(df, vocab, num_words=4).collect()}
    finally:
        spark.conf.unset("gradeflow.broadcast.maxBytes")
    assert joined[0] == [1, 2, 1] and joined[1] == [] and joined[5] == [2, 2]


def _table(rng, n_words, dim, copies, op="dp"):
    emb = np.zeros((n_words, dim))
    emb[1 : n_words - 5] = np.round(rng.normal(size=(n_words - 6, dim)), 1)
    emb[copies + 1 : 2 * copies + 1] = emb[1 : copies + 1]  # equal vectors tie
    rubric = [{"key_id": i, "seq": rng.integers(1, n_words, rng.integers(0, 6)).tolist()} for i in range(8)]
    return A.ScoreTable(A.Words(emb), rubric, op), emb, rubric


def test_search_down_the_order_matches_a_full_scan():
    rng = np.random.default_rng(4)
    for n_words, copies in ((40, 0), (300, 30)):
        table, emb, _ = _table(rng, n_words, 3, copies)
        for _ in range(40):
            seq = rng.integers(1, n_words, rng.integers(1, 30))
            best = table.best(seq)
            rows = table.words.row[seq]
            for i, at in enumerate(best):
                score = table.z[rows, i]
                assert at == int(np.flatnonzero(score == score.max())[0])


def test_table_matches_the_loop_for_each_option():
    rng = np.random.default_rng(6)
    for op in ("dp", "cos", "sdp"):
        table, emb, rubric = _table(rng, 30, 4, 0, op)
        for pool in ("mean", "sum"):
            for merge in ("concat", "mean", "ans", "key"):
                seq = rng.integers(1, 30, 12)
                got = table.attend(seq, pool, merge)
                for g, r in zip(got, rubric):
                    assert np.allclose(g, A.attend(emb[seq], emb[np.array(r["seq"], dtype=int)].reshape(-1, 4), op, pool, merge)[0])
        assert not table.attend(np.empty(0, "int64"), "mean", "concat").any()


def test_scores_of_a_wide_range():
    rng = np.random.default_rng(7)
    emb = rng.normal(size=(12, 3)) * 40
    emb[0] = 0
    rubric = [{"key_id": 1, "seq": [1, 2, 3]}, {"key_id": 2, "seq": []}, {"key_id": 3, "seq": [4, 4]}]
    table = A.ScoreTable(A.Words(emb), rubric, "dp")
    assert table.weight is None
    seq = np.array([5, 6, 7, 5])
    for got, r in zip(table.attend(seq, "mean", "concat"), rubric):
        assert np.allclose(got, A.attend(emb[seq], emb[np.array(r["seq"], dtype=int)].reshape(-1, 3))[0])


def test_word_counts_of_batches(spark):
    texts = [(5, "b a b"), (3, "c b"), (None, "d c"), (3, None), (9, ""), (4, "a a a a")]
    df = spark.createDataFrame(texts, "essay_id long, essay string").repartition(2)
    extra = spark.createDataFrame([(1, "zz a"), (0, "yy zz")], "key_id long, phrase string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [(r["word"], r["count"], r["index"]) for r in V.fit_vocab(df, extra=extra).orderBy("index").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # by count, then first appearance: the null id, then 3, 4, 5, then the extra texts in id order
    assert got == [("a", 6, 1), ("b", 3, 2), ("c", 2, 3), ("zz", 2, 4), ("d", 1, 5), ("yy", 1, 6)]
