"""The shared fit of all folds against fits of one model each and Spark ML."""

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from gradeflow.operators import experiment as X
from gradeflow.operators import shared_fit as SF
from gradeflow.operators import splits as D
from gradeflow.operators.features import FEATURE_COLUMNS


def _rows(spark, n=240, folds=3, partitions=5):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        label = int(rng.integers(0, 3))
        wide = (rng.normal(size=4) + label * np.array([0.8, 0, -0.5, 0])).tolist()
        per = [(f"f{k}", ["train", "train", "dev", "test"][(i + k) % 4], float((i + k) % 4 < 2) * (1 + i % 2),
                (rng.normal(size=2) * 3 + label + k).tolist()) for k in range(folds)]
        out.append((["a", "b"][i % 2], label, wide if i % 2 else wide[:2], per))
    schema = "name string, label int, wide array<double>, folds array<struct<fold:string,split:string,weight:double,narrow:array<double>>>"
    return spark.createDataFrame(out, schema).repartition(partitions)


def test_shared_fit_equals_separate_fits(spark):
    rows = _rows(spark)
    blocks = SF.build_blocks(rows, 2)
    fit = SF.fit_all(blocks, 2, 3, max_passes=25)
    assert 5 < fit.passes <= 25
    for name in ("a", "b"):
        for i in range(3):
            alone = rows.filter(F.col("name") == name).withColumn("folds", F.filter("folds", lambda f: f["fold"] == f"f{i}")).repartition(1)
            one = SF.fit_all(SF.build_blocks(alone, 2), 2, 3, max_passes=25)
            assert np.allclose(one.weight[name][0], fit.weight[name][i], atol=1e-5) and np.allclose(one.bias[name][0], fit.bias[name][i], atol=1e-5)
    pred = SF.predict_held_out(blocks, 2, fit).collect()
    want = sum(1 for r in rows.collect() for f in r["folds"] if f["split"] != "train")
    assert len(pred) == want and np.mean([p["label"] == p["pred"] for p in pred]) > 0.5


def test_loss_is_as_low_as_that_of_spark_ml(spark):
    rows = _rows(spark, folds=1).filter("name = 'b'")
    fit = SF.fit_all(SF.build_blocks(rows, 2), 2, 3, max_passes=100, tol=1e-9)
    flat = rows.select("label", F.col("folds")[0]["weight"].alias("w"), *[F.col("wide")[i].alias(f"w{i}") for i in range(4)],
                       *[F.col("folds")[0]["narrow"][i].alias(f"n{i}") for i in range(2)]).filter("w > 0")
    flat = VectorAssembler(inputCols=["w0", "w1", "w2", "w3", "n0", "n1"], outputCol="x").transform(flat)
    flat = StandardScaler(inputCol="x", outputCol="features", withMean=True, withStd=True).fit(flat).transform(flat)
    model = LogisticRegression(labelCol="label", weightCol="w", family="multinomial", maxIter=200, tol=1e-10).fit(flat)
    total = flat.agg(F.sum("w")).first()[0]
    loss = 0.0
    for r in model.transform(flat).select("label", "w", "probability").collect():
        loss -= r["w"] * math.log(r["probability"][r["label"]]) / total
    assert abs(fit.loss["b"][0] - loss) < 1e-4


def test_one_class_folds_have_no_model(spark):
    rows = _rows(spark).withColumn("label", F.when(F.col("name") == "a", 1).otherwise(F.col("label")))
    blocks = SF.build_blocks(rows, 2)
    fit = SF.fit_all(blocks, 2, 3, max_passes=5)
    assert not fit.usable["a"].any() and fit.usable["b"].all()
    assert {r["name"] for r in SF.predict_held_out(blocks, 2, fit).collect()} == {"b"}
    empty = SF.build_blocks(rows.limit(0), 2)
    assert SF.fit_all(empty, 2, 3).passes == 0


def test_weights_match_downsample_and_padding(spark):
    rows = [(f"s/fold_{k}", ["train", "train", "train", "dev", "test"][(i + k) % 5], i % 3, i) for i in range(100) for k in range(2)]
    df = spark.createDataFrame(rows, "fold string, split string, label int, essay_id long")
    got = {(r["fold"], r["essay_id"]): r["weight"] for r in X.train_weights(df, 0.5, 16, 42, "essay_id").collect()}
    for fold in ("s/fold_0", "s/fold_1"):
        train = df.filter((F.col("fold") == fold) & (F.col("split") == "train"))
        kept = D.pad_to_multiple(D.stratified_downsample(train, 0.5, "label", 42), 16)
        want = {r["essay_id"]: float(r["n"]) for r in kept.groupBy("essay_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert {i: w for (f, i), w in got.items() if f == fold and w} == want
    assert len(got) == 200


def test_run_folds_with_and_without_keywords(spark):
    rng = np.random.default_rng(3)
    cols = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    rows = [(i, ["x", "y"][i % 2], i % 3, *[None if rng.random() < 0.05 else float(rng.normal() + (i % 3)) for _ in FEATURE_COLUMNS]) for i in range(450)]
    df = spark.createDataFrame(rows, f"essay_id long, essay_set string, domain1_score int, {cols}")
    kw = spark.createDataFrame([(i, rng.normal(size=4 if i % 2 else 6).tolist()) for i in range(450)], "essay_id long, keyword_features array<double>")
    # half the train rows of a model are little more than its columns
    for extra, share, least in ((None, 1.0, 0.8), (kw, 0.5, 0.6)):
        out = X.run_folds(df, k=3, keyword_features=extra, train_share=share, multiple=8).collect()
        assert len(out) == 2 * 3 * 2 * 5 + 2
        acc = [r["value"] for r in out if r["metric"] == "eval_acc"]
        assert sum(acc) / len(acc) > least


def test_keyword_vectors_are_made_at_the_blocks(spark):
    """X2 over a ``KeywordBlock`` gives what it gives over the joined vectors, also beside
    essays without a phrase, and shuffles no vector."""
    from gradeflow.operators import attention as A

    rng = np.random.default_rng(6)
    cols = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    rows = [(i, "xyn"[i % 3], i % 2, *[float(rng.normal() + i % 2) for _ in FEATURE_COLUMNS]) for i in range(240)]
    df = spark.createDataFrame(rows, f"essay_id long, essay_set string, domain1_score int, {cols}")
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 9)], "word string, count long, index long")
    vectors = spark.createDataFrame([(f"w{i}", rng.normal(size=3).tolist()) for i in range(1, 7)], "word string, vec array<double>")
    seqs = spark.createDataFrame([(i, "xyn"[i % 3], [1 + i % 8, 2 + i % 5]) for i in range(0, 235)], "essay_id long, essay_set string, seq array<int>")
    keys = spark.createDataFrame([(k, "xy"[k % 2], [1 + k % 7, 3]) for k in range(5)], "key_id long, essay_set string, seq array<int>")
    args = (seqs, keys, vocab, vectors, 3, 10)
    block = A.keyword_block(*args)
    assert {r["essay_id"] for r in block.ids.collect()} == {i for i in range(235) if i % 3 < 2}
    out = [sorted(map(str, X.run_folds(df, k=3, keyword_features=kf, train_share=0.5, multiple=8).collect()))
           for kf in (A.keyword_features(A.keyword_attention(*args)), block)]
    assert out[0] == out[1] and len(out[0]) == 2 * 3 * 2 * 5 + 2
    plan = block.beside(df.select("essay_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0].replace("AdaptiveSparkPlan", "")


def test_a_pass_sends_no_more_sums_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    blocks = SF.build_blocks(_rows(spark).repartition(3 * cores), 2)
    assert blocks.rdd.getNumPartitions() > cores and SF._by_core(blocks).rdd.getNumPartitions() == cores
    count = lambda b: np.array([float(len(b["labels"]))])
    got = {k: v[0] for k, v in SF._summed(blocks, 2, count).items()}
    assert got == {r["name"]: r["count"] for r in _rows(spark).groupBy("name").count().collect()}
