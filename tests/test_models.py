"""Model fits (M1-M4): determinism, a quality floor on a learnable fixture,
and the MLP size rule."""

from pyspark.sql import functions as F

from gradeflow.operators import models as MD


def _fixture(spark):
    rows = [(i, float(i % 4), float((i * 7) % 11), float(i % 4) * 2.0 + (i % 3) * 0.1) for i in range(240)]
    return spark.createDataFrame(rows, "id long, label double, noise double, signal double")


def test_hidden_layer_sizes():
    assert MD.hidden_layer_sizes(24, 2, 4) == [12, 6]
    assert MD.hidden_layer_sizes(5, 2, 4) == []
    assert MD.hidden_layer_sizes(16, 2, 4) == [8] and MD.hidden_layer_sizes(24, 2, 1) == [12, 6, 3]


def test_linear_head_deterministic_and_learns(spark):
    df = _fixture(spark)
    m1 = MD.train_score_classifier(df, ["noise", "signal"], "label")
    m2 = MD.train_score_classifier(df, ["noise", "signal"], "label")
    p1 = MD.predict(m1, df, ["id", "label"]).orderBy("id").collect()
    p2 = MD.predict(m2, df, ["id", "label"]).orderBy("id").collect()
    assert [r["pred"] for r in p1] == [r["pred"] for r in p2]
    acc = sum(r["pred"] == int(r["label"]) for r in p1) / len(p1)
    assert acc > 0.9  # majority class would be 0.25


def test_mlp_and_regression_heads(spark):
    df = _fixture(spark)
    mlp = MD.train_score_classifier(df, ["noise", "signal"], "label", head="mlp", seed=7, num_classes=4)
    preds = MD.predict(mlp, df, ["id"]).select("pred").distinct().count()
    assert preds >= 2
    reg = MD.train_score_regressor(df, ["noise", "signal"], "label")
    out = reg.transform(df).select(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae")).first()
    assert out["mae"] < 0.2


def test_rfe_keeps_the_signal(spark):
    df = _fixture(spark).withColumn("noise2", (F.col("id") * 13 % 7).cast("double"))
    ranks = {r["feature"]: r["rank"] for r in MD.select_features_rfe(df, ["noise", "noise2", "signal"], "label", k=1).collect()}
    assert ranks["signal"] == 1 and sorted(ranks.values()) == [1, 2, 3]
