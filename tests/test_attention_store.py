"""The stored attention weights against the formulas, essay by essay."""

import numpy as np
from pyspark.sql import functions as F

from gradeflow.operators import attention as A
from gradeflow.operators import attention_store as AS
from gradeflow.sources import io as IO


def test_weights_are_restored(spark):
    rng = np.random.default_rng(1)
    dim, n = 4, 9
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, n)], "word string, count long, index long")
    vecs = {f"w{i}": rng.normal(size=dim).tolist() for i in range(1, n - 2)}  # w7 and w8 have none
    vectors = spark.createDataFrame(list(vecs.items()), "word string, vec array<double>")
    essays = {1: [1, 2, 7, 2, 8], 2: [], 3: [3], 4: [8]}
    phrases = {10: [2, 3, 2], 11: [7], 12: []}
    answers = spark.createDataFrame([(i, "x", s) for i, s in essays.items()] + [(5, "y", [1])], "essay_id long, essay_set string, seq array<int>")
    keys = spark.createDataFrame([(i, "x", s) for i, s in phrases.items()] + [(13, "y", [4])], "key_id long, essay_set string, seq array<int>")
    path = IO.scratch_path(spark, "weights")
    AS.write_attention_weights(answers, keys, vocab, vectors, path, dim, 10)
    E = np.zeros((10, dim))
    for w, v in vecs.items():
        E[int(w[1:])] = v
    got = {(r["essay_id"], r["key_id"]): r for r in AS.read_attention(spark, path).collect()}
    assert set(got) == {(i, k) for i in essays for k in phrases} | {(5, 13)}
    for i, seq in essays.items():
        for k, kseq in phrases.items():
            r = got[(i, k)]
            assert sum(r["counts"]) == len(seq) and len(r["z"]) == len(kseq)
            z = A._scores(E[seq], E[kseq], "dp") if seq and kseq else None
            if z is None:
                continue
            cos = A._scores(E[seq], E[kseq], "cos")
            for j, word in enumerate(seq):
                at = r["words"].index(word if word < n - 2 else -1)
                assert np.allclose([row[at] for row in r["z"]], z[:, j])
                assert np.allclose([row[at] for row in r["z_ans"]], A._softmax(z, 1)[:, j])
                assert np.allclose([row[at] for row in r["z_key"]], A._softmax(z, 0)[:, j])
                assert np.isclose(r["beta_key"][at], 1 / (1 + np.exp(-5 * cos[:, j].max())))
            assert np.allclose(r["beta_ans"], 1 / (1 + np.exp(-5 * cos.max(axis=1))))
    some = AS.read_attention(spark, path, sets=["x"], essays=answers.filter("essay_id = 3"))
    assert {r["essay_id"] for r in some.collect()} == {3}
    plan = spark.read.parquet(f"{path}/essays").filter(F.col("essay_set") == "x").select("counts")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(essay_set" in plan and "over_ans" not in plan.split("ReadSchema")[1]
    sums = {(r["essay_id"], r["key_id"]): r for r in AS.attention_sums(spark, path).collect()}
    r = got[(1, 10)]
    assert np.isclose(sums[(1, 10)]["z"], sum(c * x for row in r["z"] for c, x in zip(r["counts"], row)))


def test_a_block_travels_once_not_with_every_essay(spark, monkeypatch):
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 5)], "word string, count long, index long")
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(1, 4)], "word string, vec array<double>")
    answers = spark.createDataFrame([(i, "x", [1 + i % 4, 2]) for i in range(40)], "essay_id long, essay_set string, seq array<int>")
    keys = spark.createDataFrame([(1, "x", [2, 3])], "key_id long, essay_set string, seq array<int>")
    path = IO.scratch_path(spark, "weights")
    AS.write_attention_weights(answers, keys, vocab, vectors, path, 2, 10)
    want = sorted(map(tuple, AS.attention_sums(spark, path).collect()))
    assert len(want) == 40
    for held, copies in ((16_000, 1), (15, 3)):
        monkeypatch.setattr(AS, "ESSAYS_PER_COPY", held)
        rows, _ = AS._pairs(spark, path, None, None)
        assert rows.filter("b is not null").count() == copies and rows.count() == 40 + copies
        assert sorted(map(tuple, AS.attention_sums(spark, path).collect())) == want


def test_gates_are_summed_before_the_essays_travel(spark):
    """The sums equal those of the restored gates, also of essays and phrases without a token; the
    gates themselves are not shuffled."""
    rng = np.random.default_rng(2)
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 9)], "word string, count long, index long")
    vectors = spark.createDataFrame([(f"w{i}", rng.normal(size=3).tolist()) for i in range(1, 7)], "word string, vec array<double>")
    answers = spark.createDataFrame([(i, "xy"[i % 2], [1 + i % 8, 2] * (i % 3)) for i in range(12)], "essay_id long, essay_set string, seq array<int>")
    keys = spark.createDataFrame([(1, "x", [2, 3, 2]), (2, "x", []), (3, "y", [7]), (4, "x", [5, 1])], "key_id long, essay_set string, seq array<int>")
    path = IO.scratch_path(spark, "weights")
    AS.write_attention_weights(answers, keys, vocab, vectors, path, 3, 10)
    want = {(r["essay_id"], r["key_id"]): (len(r["beta_ans"]), sum(r["beta_ans"])) for r in AS.read_attention(spark, path).collect()}
    got = {(r["essay_id"], r["key_id"]): (r["n_key"], r["beta_ans"]) for r in AS.attention_sums(spark, path).collect()}
    assert set(got) == set(want) and len(got) == 6 * 3 + 6
    assert all(got[k][0] == n and np.isclose(got[k][1], total) for k, (n, total) in want.items())
    rows, _ = AS._pairs(spark, path, None, None, gates=False)
    assert "gate_ans" not in rows.columns and "gate_sums" in rows.columns
