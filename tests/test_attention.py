"""K7-K9 against a brute-force loop on a small fixture."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import attention as A
from gradeflow.session import DICTIONARY_BYTES, keep_dictionaries
from gradeflow.sources import io as IO


def _brute(a, k, d):
    """Straight loops over the formulas (dp, mean pooling, concat)."""
    if not a or not k:
        return [0.0] * (2 * d)
    z = [[sum(ki[t] * aj[t] for t in range(d)) for aj in a] for ki in k]
    U = []
    for i in range(len(k)):
        m = max(z[i])
        w = [math.exp(x - m) for x in z[i]]
        s = sum(w)
        U.append([sum(w[j] / s * a[j][t] for j in range(len(a))) for t in range(d)])
    V = []
    for j in range(len(a)):
        col = [z[i][j] for i in range(len(k))]
        m = max(col)
        w = [math.exp(x - m) for x in col]
        s = sum(w)
        V.append([sum(w[i] / s * k[i][t] for i in range(len(k))) for t in range(d)])
    u = [sum(r[t] for r in U) / len(U) for t in range(d)]
    v = [sum(r[t] for r in V) / len(V) for t in range(d)]
    return u + v


def test_attention_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    dim, n_words = 4, 6
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, n_words)], "word string, count long, index long")
    vecs = {f"w{i}": rng.normal(size=dim).tolist() for i in range(1, n_words - 1)}  # w5 has no vector
    vectors = spark.createDataFrame(list(vecs.items()), "word string, vec array<double>")
    answers = spark.createDataFrame([(1, "x", [1, 2, 5, 2]), (2, "x", []), (3, "x", [3]), (4, "y", [1]), (5, None, [1])], "essay_id long, essay_set string, seq array<int>")
    phrases = spark.createDataFrame([(10, "x", [2, 3]), (11, "x", [4]), (12, "x", []), (13, "y", [2])], "key_id long, essay_set string, seq array<int>")
    got = {(r["essay_id"], r["key_id"]): r["f"] for r in A.keyword_attention(answers, phrases, vocab, vectors, dim, 10).collect()}
    assert {k for k in got if k[0] > 3} == {(4, 13)}  # another set's rubric; no set, no rubric
    E = np.zeros((10, dim))
    for w, v in vecs.items():
        E[int(w[1:])] = v
    for eid, seq in [(1, [1, 2, 5, 2]), (2, []), (3, [3])]:
        for kid, kseq in [(10, [2, 3]), (11, [4]), (12, [])]:
            want = _brute([E[i].tolist() for i in seq], [E[i].tolist() for i in kseq], dim)
            assert np.allclose(got[(eid, kid)], want), (eid, kid)
    feats = A.keyword_features(A.keyword_attention(answers, phrases, vocab, vectors, dim, 10)).collect()
    assert {r["essay_id"]: len(r["keyword_features"]) for r in feats} == {1: 6 * dim, 2: 6 * dim, 3: 6 * dim, 4: 2 * dim}
    top = A.attention_top_words(answers, phrases, vocab, vectors, dim, 10)
    r = top.filter((F.col("essay_id") == 1) & (F.col("key_id") == 11)).first()
    z = [float(E[4] @ E[i]) for i in [1, 2, 5, 2]]
    assert r["apos"] == int(np.argmax(z))


def test_attention_options_loop_path(spark):
    rng = np.random.default_rng(2)
    dim = 3
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 5)], "word string, count long, index long")
    vecs = {f"w{i}": rng.normal(size=dim).tolist() for i in range(1, 5)}
    vectors = spark.createDataFrame(list(vecs.items()), "word string, vec array<double>")
    answers = spark.createDataFrame([(1, "x", [1, 2, 3]), (2, "x", [4])], "essay_id long, essay_set string, seq array<int>")
    phrases = spark.createDataFrame([(10, "x", [2, 4])], "key_id long, essay_set string, seq array<int>")
    E = np.zeros((10, dim))
    for w, v in vecs.items():
        E[int(w[1:])] = v
    for op, pool, merge, beta in [("cos", "max", "concat", True), ("sdp", "sum", "mean", False), ("dp", "mean", "key", True)]:
        got = {r["essay_id"]: r["f"] for r in A.keyword_attention(
            answers, phrases, vocab, vectors, dim, 10, op=op, pool=pool, merge=merge, beta=beta).collect()}
        for eid, seq in [(1, [1, 2, 3]), (2, [4])]:
            want, _ = A.attend(E[seq], E[[2, 4]], op, pool, merge, beta)
            assert np.allclose(got[eid], want), (op, pool, merge, beta, eid)


@pytest.mark.parametrize("op", ["dp", "sdp", "cos"])
def test_all_options_equal_the_loop(op):
    """Gate and max pooling on shared tables: repeated words, words without a vector,
    empty answers and phrases, and scores too far apart for one shift."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 60.0):
        E = np.zeros((30, 4))
        E[1:20] = rng.normal(size=(19, 4)) * scale
        phrases = [[2, 4, 2], [], [25, 7], [25], list(range(1, 30)), [4]]
        table = A.ScoreTable(A.Words(E), [{"key_id": i, "seq": p} for i, p in enumerate(phrases)], op)
        for seq in ([1, 2, 2, 28, 5], [28], [], list(range(1, 28)) * 2):
            seq = np.array(seq, dtype="int64")
            for pool in ("mean", "sum", "max"):
                for merge in ("concat", "mean", "ans", "key"):
                    for beta in (False, True):
                        got = table.attend(seq, pool, merge, beta)
                        for p, f in zip(phrases, got):
                            want, _ = A.attend(E[seq], E[np.array(p, dtype="int64")], op, pool, merge, beta)
                            assert np.allclose(f, want, atol=1e-9), (op, scale, pool, merge, beta, p, seq)


def test_a_table_serves_the_answers_of_many_batches(spark, monkeypatch):
    """Tables are built once for the answers that wait, not again in every batch; blocks
    beyond the broadcast bound give the same rows."""
    built = []
    monkeypatch.setattr(A.ScoreTable, "__init__", lambda self, *a, f=A.ScoreTable.__init__: (built.append(1), f(self, *a))[1])
    emb = np.random.default_rng(0).normal(size=(9, 3))
    schema = pa.schema([("essay_id", pa.int64()), ("essay_set", pa.string()), ("seq", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pylist([{"essay_id": 10 * b + i, "essay_set": "xyn"[i], "seq": [1 + i, 2]} for i in range(3)], schema=schema) for b in range(5)]
    blocks = {s: [(k, [{"key_id": k, "seq": [1, 2 + k]}]) for k in range(4)] for s in "xy"}
    met = [(b, i) for _, _, b, i, _ in A._Tables(emb, "dp").answers(batches, "essay_id", "essay_set", blocks)]
    assert len(built) == 8 and sorted(met) == sorted((k, 10 * b + i) for k in range(4) for b in range(5) for i in range(2))
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 9)], "word string, count long, index long")
    vectors = spark.createDataFrame([(f"w{i}", emb[i].tolist()) for i in range(1, 7)], "word string, vec array<double>")
    answers = spark.createDataFrame([(i, "x" if i % 2 else None, [1 + i % 8, 2]) for i in range(12)], "essay_id long, essay_set string, seq array<int>")
    keys = spark.createDataFrame([(1, "x", [2, 3]), (2, None, [4]), (3, "x", [])], "key_id long, essay_set string, seq array<int>")
    out = []
    for bound in ("1000000", "1"):
        spark.conf.set("gradeflow.broadcast.maxBytes", bound)
        try:
            out.append(sorted(map(str, A.keyword_attention(answers, keys, vocab, vectors, 3, 10, pool="max", decimals=6).collect())))
        finally:
            spark.conf.unset("gradeflow.broadcast.maxBytes")
    assert out[0] == out[1] and len(out[0]) == 12


def test_answer_features_equal_the_joined_vectors(spark, monkeypatch):
    """Vectors of an answer are put together where its token ids are: same numbers as from K7's
    rows, for repeated ids, sets without a rubric and any cut into batches, and none is shuffled."""
    rng = np.random.default_rng(3)
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 9)], "word string, count long, index long")
    vectors = spark.createDataFrame([(f"w{i}", rng.normal(size=3).tolist()) for i in range(1, 7)], "word string, vec array<double>")
    answers = [(i, "xyn"[i % 3], [1 + i % 8, 2] * (i % 4)) for i in range(40)] + [(7, "x", [5]), (7, "x", [3, 5]), (8, None, [1]), (9, "y", None)]
    answers = spark.createDataFrame(answers, "essay_id long, essay_set string, seq array<int>")
    keys = [(k, "xy"[k % 2], [1 + k % 7, 3, 8][: k % 4]) for k in range(9)] + [(4, "x", [2])]
    keys = spark.createDataFrame(keys, "key_id long, essay_set string, seq array<int>")
    monkeypatch.setattr(A, "block_tokens", lambda words: 4)  # many blocks a set
    args = (answers, keys, vocab, vectors, 3, 10)
    want = {r["essay_id"]: r["keyword_features"] for r in A.keyword_features(A.keyword_attention(*args, decimals=6)).collect()}
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(45)] + [(7, "again"), (None, "none")], "essay_id long, name string")
    for feature_bytes, batch_bytes in ((128 << 20, 16 << 20), (1000, 300), (1, 1)):
        monkeypatch.setattr(A, "FEATURE_BYTES", feature_bytes)
        monkeypatch.setattr(A, "BATCH_BYTES", batch_bytes)
        alone = A.answer_features(*args, decimals=6)
        assert {r["essay_id"]: r["keyword_features"] for r in alone.collect()} == want and alone.count() == len(want)
        beside = A.answer_features(*args, decimals=6, rows=rows)
        assert beside.columns == ["essay_id", "name", "keyword_features"]
        got = beside.collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in rows.join(spark.createDataFrame(list(want.items()), "essay_id long, keyword_features array<double>"), "essay_id", "left").collect())
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0].replace("AdaptiveSparkPlan", "")
    spark.conf.set("gradeflow.broadcast.maxBytes", "1")
    try:
        assert {r["essay_id"]: r["keyword_features"] for r in A.answer_features(*args, decimals=6).collect()} == want
    finally:
        spark.conf.unset("gradeflow.broadcast.maxBytes")


def test_written_attention_keeps_a_dictionary_of_rounded_numbers(spark, tmp_path):
    number = lambda i: F.round(F.pmod(F.xxhash64("id", i), F.lit(140_000)) / 1e6, 6)
    att = spark.range(8000).coalesce(1).select(F.col("id").alias("essay_id"), F.lit(1).cast("long").alias("key_id"), F.transform(F.sequence(F.lit(1), F.lit(100)), number).alias("f"))
    IO.write_attention(att, str(tmp_path / "kept"))
    att.write.parquet(str(tmp_path / "plain"))
    size = {x: sum(p.stat().st_size for p in (tmp_path / x).glob("*.parquet")) for x in ("kept", "plain")}
    assert size["kept"] < 0.6 * size["plain"]
    assert spark.read.parquet(str(tmp_path / "kept")).exceptAll(att).count() == 0


def test_top_words_look_their_words_up_in_place(spark, tmp_path):
    """K9's many rows are not shuffled for their words, however small the bound of Spark's own broadcasts."""
    from gradeflow.plans.q_attention import top_words_query

    d = str(tmp_path)
    spark.createDataFrame([(i, "de", f"aa bb w{i} cc") for i in range(8)], "doc_id long, lang string, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "bb dd"), (4, "aa w3 ee")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    vectors = np.random.default_rng(4).normal(size=(13, 64)).tolist()
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = top_words_query(spark, d)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("MapInArrow")[0]
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 8 * 5 and all(r["word"] == ["aa", "bb", f"w{r['essay_id']}", "cc"][r["apos"]] for r in rows)
    assert out.columns == ["word_id", "essay_id", "key_id", "kpos", "apos", "word"]


def test_rounded_vectors_are_stored_by_a_dictionary(spark, tmp_path):
    """Parquet's writer keeps a dictionary of K7's numbers, unless the session names a size."""
    key = "parquet.dictionary.page.size"
    number = lambda i: F.round(F.pmod(F.xxhash64("id", i), F.lit(140_000)) / 1e6, 6)
    att = spark.range(8000).coalesce(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(100)), number).alias("f"))
    size, before = {}, spark.conf.get(key, None)
    for named in (str(1 << 20), None):
        spark.conf.unset(key) if named is None else spark.conf.set(key, named)
        try:
            keep_dictionaries(spark)
            assert spark.conf.get(key) == (named or str(DICTIONARY_BYTES))
            att.write.parquet(str(tmp_path / f"x{named}"))
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        size[named] = sum(p.stat().st_size for p in (tmp_path / f"x{named}").glob("*.parquet"))
    assert size[None] < 0.6 * size[str(1 << 20)]
    assert spark.read.parquet(str(tmp_path / "xNone")).exceptAll(att).count() == 0
