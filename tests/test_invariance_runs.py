"""Same results under 1 and 8 partitions; the experiment runners in folder
and regression mode; the JSON metrics sink."""

import json

from pyspark.sql import functions as F

from gradeflow.operators import experiment as X
from gradeflow.operators import features as FT
from gradeflow.operators import vocab as V
from gradeflow.plans import bindings as B
from gradeflow.sources import io as IO

SF = "/root/testdata/sf0.001"


def test_partition_invariance(spark):
    e = B.essays(spark, SF).select("essay_id", "essay")
    vocab8 = sorted(tuple(r) for r in V.fit_vocab(e.repartition(8)).collect())
    vocab1 = sorted(tuple(r) for r in V.fit_vocab(e.coalesce(1)).collect())
    assert vocab1 == vocab8
    lex = B.lexicon_from(V.fit_vocab(e))
    wl = FT.WordLists(lex, B.dictionary_from(V.fit_vocab(e)), B.easy_words_from(V.fit_vocab(e)))
    f8 = sorted(tuple(r) for r in FT.generate_features(e.repartition(8), wl).drop("essay").collect())
    f1 = sorted(tuple(r) for r in FT.generate_features(e.coalesce(1), wl).drop("essay").collect())
    assert f1 == f8


def test_run_config_folder_regression(spark):
    rows = [(i, "en" if i % 2 else "fr", float(i % 7), float((i * 13) % 5), float(i % 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "essay_id long, essay_set string, a double, b double, label double")
    splits = {
        "train": df.filter(F.col("essay_id") < 80),
        "val": df.filter((F.col("essay_id") >= 80) & (F.col("essay_id") < 100)),
        "test": df.filter(F.col("essay_id") >= 100),
    }
    out_dir = IO.scratch_path(spark, "run")
    cfg = X.RunConfig(mode="folder", task="regression", cat_cols=["essay_set"], num_cols=["a", "b"],
                      numerical_transformer="yeo_johnson", output_dir=out_dir)
    out = {(r["fold"], r["split"], r["metric"]): r["value"] for r in X.run_config(cfg, splits=splits).collect()}
    for split in ("val", "test"):
        assert ("folder", split, "eval_mse") in out and out[("stdev", split, "eval_mse")] == 0.0
        lines = [r["value"] for r in spark.read.text(f"{out_dir}/folder/{split}/predictions").collect()]
        assert lines[0] == "index\tprediction" and len(lines) == 21
    summary = json.loads(spark.read.text(f"{out_dir}/summary").first()["value"])
    assert "mean_test_eval_mse" in summary


def test_run_config_scores_holdout_and_folds(spark):
    rows = [(i, "en" if i % 2 else "fr", float(i % 3) + (i % 7) / 10, None if i % 11 == 0 else float(i % 3), float(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "essay_id long, essay_set string, a double, b double, label double")
    cfg = X.RunConfig(k=3, cat_cols=["essay_set"], num_cols=["a", "b"])
    out = X.run_config(cfg, data=df).collect()
    assert len(out) == 3 * 2 * 5 + 2 * 2 * 5
    acc = [r["value"] for r in out if r["metric"] == "eval_acc" and r["fold"].startswith("fold_")]
    assert len(acc) == 6 and min(acc) >= 0.8 and sum(acc) / 6 > 0.9


def test_preparation_imputes_by_split_and_normalises(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("f0", "train" if i < 200 else "val", float(x)) for i, x in enumerate(np.exp(rng.normal(size=300)))]
    rows += [("f0", "train", None), ("f0", "val", None)]
    df = spark.createDataFrame(rows, "fold string, split string, a double")
    fitted = X.prepare(df, ["a"])
    for split in ("train", "val"):
        assert abs(fitted.medians[f"f0\x1f{split}\x1fa"] - np.median([x for _, s, x in rows if s == split and x is not None])) < 1e-9
    out = X.apply_prepared(df, "f0", ["train", "val"], ["a"], fitted)
    train = np.array([r["a"] for r in out.filter("split = 'train'").collect()])
    assert abs(np.median(train)) < 0.1 and 0.5 < train[np.abs(train) < 4].std() < 1.5
    assert out.filter("a is null").count() == 0


def test_metrics_json(spark):
    m = spark.createDataFrame([("eval_QWK", 0.5), ("eval_acc", 0.25)], "metric string, value double")
    p = IO.scratch_path(spark, "json")
    IO.write_metrics(m, p, as_json=True)
    obj = json.loads(spark.read.text(p).first()["value"])
    assert obj == {"eval_QWK": 0.5, "eval_acc": 0.25}
