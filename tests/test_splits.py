"""Fold properties: disjoint tests, cover, sizes within 1, padding."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import splits as D
from gradeflow.plans import cuts


def test_rotate_folds_disjoint_cover(spark):
    df = spark.range(0, 200).toDF("essay_id")
    f = D.rotate_folds(df).collect()
    tests = [r["essay_id"] for r in f if r["split"] == "test"]
    assert sorted(tests) == list(range(200))  # each id is test exactly once
    dev = {(r["fold"], r["essay_id"]) for r in f if r["split"] == "dev"}
    test = {(r["fold"], r["essay_id"]) for r in f if r["split"] == "test"}
    # dev of fold i is test of fold i-1
    assert dev == {((k + 1) % 5, i) for k, i in test}


def test_kfold_sizes(spark):
    df = spark.range(0, 103).toDF("essay_id")
    sizes = [r["c"] for r in D.kfold_split(df, 5).groupBy("fold").agg(F.count("*").alias("c")).orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]


def test_holdout_then_kfold(spark):
    df = spark.range(0, 50).toDF("essay_id")
    out = D.holdout_then_kfold(df, 0.2, 4).collect()
    assert sum(r["role"] == "val" for r in out) == 10
    assert sorted({r["fold"] for r in out if r["role"] == "cv"}) == [0, 1, 2, 3]


def test_pad_and_downsample(spark):
    df = spark.range(0, 15).toDF("essay_id").withColumn("domain1_score", (F.col("essay_id") % 3).cast("int"))
    padded = D.pad_to_multiple(df, 32)
    assert padded.count() == 30  # n < missing: the table form appends n rows once
    cyc = D.pad_to_multiple(df, 32, form="list")
    assert cyc.count() == 32
    kept = D.stratified_downsample(df, 0.5)
    assert kept.count() == 15 - 8  # ceil(0.5 * 15) dropped
    assert D.drop_quotas({0: 5, 1: 5, 2: 5}, 0.5) == {0: 3, 1: 3, 2: 2}


def test_oversample(spark):
    df = spark.range(0, 10).toDF("essay_id").withColumn("domain1_score", (F.col("essay_id") % 2).cast("int"))
    out = D.oversample_by_class(df, {1: (3, 2)})
    assert out.count() == 10 + 3 * 2
    assert out.filter(F.col("variant") > 0).agg(F.min("applied"), F.max("length")).first() == (1, 0)


def _order(rows, seed=42):
    return sorted(rows, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n,k", [(0, 5), (3, 5), (1, 1), (103, 5), (4000, 7)])
def test_kfold_is_the_ntile_of_the_hash_order(spark, n, k):
    df = spark.range(0, n).toDF("essay_id")
    got = {r["essay_id"]: r["fold"] for r in D.kfold_split(df, k).collect()}
    order, (q, m) = _order(range(n)), divmod(n, k)
    want = {}
    for fold in range(k):
        size = q + (fold < m)
        want.update({i: fold for i in order[:size]})
        order = order[size:]
    assert got == want


def test_cuts_go_deeper_until_few_rows_are_left(spark, monkeypatch):
    monkeypatch.setattr(cuts, "READ_ROWS", 3)
    monkeypatch.setattr(cuts, "HELD_ROWS", 16)
    monkeypatch.setattr(cuts, "FIRST_DIGITS", 1)
    ids = list(range(0, 6000, 2))
    df = spark.createDataFrame([(i,) for i in ids], "essay_id long")
    found = cuts.hash_cuts(df, D.hash_key("essay_id", 42), "essay_id", lambda n: {"": [0, 1, 777, n[""] - 1, n[""]]})
    order = _order(ids)
    assert {p: c[1] for p, c in found[""].items()} == {p: order[p] for p in (0, 1, 777, len(ids) - 1)}


def test_cuts_without_sorting(spark):
    plan = D.kfold_split(spark.range(0, 50).toDF("essay_id"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_ids_repeated_across_a_cut_are_numbered(spark):
    df = spark.createDataFrame([(7,)] * 30 + [(i,) for i in range(100, 110)] + [(None,)] * 3, "essay_id long")
    out = D.kfold_split(df, 4).groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in out) == [(0, 11), (1, 11), (2, 11), (3, 10)]
    # nulls come first in the hash order
    held = D.holdout_then_kfold(df, 3 / 43, 2).filter("role = 'val'").collect()
    assert [r["essay_id"] for r in held] == [None] * 3


@pytest.mark.parametrize("most", [64, 1])
def test_class_quotas_by_hash_order(spark, monkeypatch, most):
    """The same rows by cuts and, where the classes are too many, by numbers."""
    monkeypatch.setattr(cuts, "MOST_CUTS", most)
    rows = [(i, i % 3 if i % 10 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "essay_id long, domain1_score int")
    of = {c: _order([i for i, s in rows if s == c]) for c in range(3)}
    quota = D.drop_quotas({c: len(v) for c, v in of.items()}, 0.3)
    kept = {r["essay_id"] for r in D.stratified_downsample(df, 0.3).collect()}
    assert kept == {i for c, v in of.items() for i in v[quota[c]:]}
    more = D.oversample_by_class(df, {1: (5, 2), 2: (1000, 1), 9: (4, 4)}).filter("variant > 0").collect()
    assert sorted((r["essay_id"], r["variant"]) for r in more) == sorted(
        [(i, v) for i in of[1][:5] for v in (1, 2)] + [(i, 1) for i in of[2]])


def test_padding_takes_the_lowest_ids(spark):
    df = spark.createDataFrame([(i, "t") for i in (9, 4, 7, None, 1)], "essay_id long, essay string")
    copies = lambda out: sorted(((r["essay_id"], r["copy"]) for r in out.collect() if r["copy"]), key=str)
    assert copies(D.pad_to_multiple(df, 4)) == sorted([(None, 1), (1, 1), (4, 1)], key=str)
    assert copies(D.pad_to_multiple(df, 12, form="list")) == sorted(
        [(i, 1) for i in (9, 4, 7, None, 1)] + [(None, 2), (1, 2)], key=str)
    assert D.pad_to_multiple(df.limit(0), 4, form="list").count() == 0
    assert D.pad_to_multiple(df, 5).count() == 5


def test_synonyms_by_chunks(spark):
    """Repeated ids are taken together, rows without an id or a text get an empty one, the place
    counts, whatever the blanks and the number of chunks; tokens are not shuffled one by one."""
    texts = [(1, "The  CAT sat\ton the mat", "a"), (2, None, "b"), (3, "  ", "c"), (4, "cat " * 40, "d"), (5, "x cat y", "e"), (5, "cat b", "f"),
             (5, None, "g"), (None, "cat the", "h"), (6, "İcat ΣΑΣ caté　cat", "i"), (7, "dog", "j")]
    df = spark.createDataFrame(texts, "essay_id long, essay string, note string")
    syn = spark.createDataFrame([("cat", "lynx"), ("cat", "ounce"), ("the", "a"), ("dog", None), (None, "x"), ("σας", "s"), ("mat", "rug")], "word string, synonym string")
    table = {"cat": "lynx", "the": "a", "σας": "s", "mat": "rug"}

    def pick(i, pos, token):
        digest = hashlib.md5(f"{i}:1:{pos}".encode()).hexdigest()
        return table[token.lower()] if token.lower() in table and int(digest[:8], 16) % 10 < 3 else token

    want = []
    for i, _, note in texts:
        tokens = [(pos, pick(i, pos, t)) for j, text, _ in texts if j == i and i is not None for pos, t in enumerate((text or "").split())]
        want.append((i, note, " ".join(t for _, t in sorted(tokens))))
    for chunk_bytes in (1 << 20, 10):
        out = D.synonym_substitute(df, syn, chunk_bytes=chunk_bytes)
        assert out.columns == ["essay_id", "note", "essay"]
        assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    assert any("lynx" in x for _, _, x in want) and "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert D.synonym_substitute(df.limit(0), syn).count() == 0
