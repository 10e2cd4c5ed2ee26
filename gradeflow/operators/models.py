"""Scoring models on Spark ML (M1-M4), re-aimed from the reference's
single-GPU heads: the "simple classifier" (one linear layer +
cross-entropy) is multinomial logistic regression, the MLP head is
Spark's MLP classifier, the regression head is linear regression.  Fits
are distributed (tree aggregation over partitions)."""

from __future__ import annotations

from itertools import count, takewhile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hidden_layer_sizes(inputs: int, shrink: int = 2, outputs: int = 1) -> list[int]:
    """Sizes between the input and output layers: ``inputs`` divided by the
    powers of ``shrink``, as far as they stay above ``outputs``."""
    sizes = (inputs // shrink**power for power in count(1))
    return list(takewhile(lambda size: size > outputs, sizes))


def _assemble(cols: list[str]):
    # callers fill missing values first (the reference imputes before the model)
    return VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="error")


def train_score_classifier(
    train: DataFrame,
    feature_cols: list[str],
    label_col: str = "label",
    head: str = "linear",
    weight_col: str | None = None,
    num_classes: int | None = None,
    division: int = 2,
    seed: int = 42,
    max_iter: int = 100,
):
    """M1 (linear) / M2 (mlp): a fitted pipeline predicting ``prediction``
    and ``probability`` from the feature columns, numbers or vectors."""
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    prepare = Pipeline(stages=[_assemble(feature_cols), scaler]).fit(train)
    if head == "linear":
        clf = LogisticRegression(
            featuresCol="features", labelCol=label_col, family="multinomial", maxIter=max_iter
        )
        if weight_col:
            clf.setWeightCol(weight_col)
    elif head == "mlp":
        if num_classes is None:
            num_classes = train.select(label_col).distinct().count()
        n_in = prepare.stages[-1].mean.size
        layers = [n_in, *hidden_layer_sizes(n_in, division, num_classes), num_classes]
        clf = MultilayerPerceptronClassifier(
            featuresCol="features", labelCol=label_col, layers=layers, seed=seed, maxIter=max_iter
        )
    else:
        raise ValueError(f"unknown head {head}")
    return PipelineModel([*prepare.stages, clf.fit(prepare.transform(train))])


def train_score_regressor(train: DataFrame, feature_cols: list[str], label_col: str = "label", max_iter: int = 100):
    """M3: mean-square loss head."""
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    reg = LinearRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter)
    return Pipeline(stages=[_assemble(feature_cols), scaler, reg]).fit(train)


def logits_of(pred: DataFrame) -> DataFrame:
    """Model output in the reference's form: a ``logits`` array column."""
    return pred.withColumn("logits", vector_to_array("rawPrediction"))


def select_features_rfe(
    df: DataFrame, feature_cols: list[str], label_col: str = "label", k: int = 10, step: int = 1, max_iter: int = 50
) -> DataFrame:
    """M4: recursive feature elimination with one-vs-rest linear SVMs: drop
    the feature(s) with the least summed squared weight until ``k`` remain.
    Returns (feature, rank): 1 for kept, higher = eliminated earlier."""
    spark = df.sparkSession
    remaining = list(feature_cols)
    ranks: dict[str, int] = {}
    # every elimination round refits on the same rows: cut the lineage once
    data = df.select(*feature_cols, label_col).checkpoint(eager=True)
    rounds = []
    while len(remaining) > k:
        model = Pipeline(
            stages=[
                _assemble(remaining),
                StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
                OneVsRest(classifier=LinearSVC(maxIter=max_iter), featuresCol="features", labelCol=label_col, parallelism=4),
            ]
        ).fit(data)
        ovr = model.stages[-1]
        score = [0.0] * len(remaining)
        for m in ovr.models:
            w = m.coefficients.toArray()
            score = [s + float(x) * float(x) for s, x in zip(score, w)]
        n_drop = min(step, len(remaining) - k)
        order = sorted(range(len(remaining)), key=lambda i: (score[i], i))[:n_drop]
        dropped = [remaining[i] for i in order]
        rounds.append(dropped)
        remaining = [c for c in remaining if c not in dropped]
    for c in remaining:
        ranks[c] = 1
    for depth, dropped in enumerate(reversed(rounds), start=2):
        for c in dropped:
            ranks[c] = depth
    return spark.createDataFrame(sorted(ranks.items()), "feature string, rank int")


def predict(model, df: DataFrame, keep: list[str]) -> DataFrame:
    out = model.transform(df)
    cols = [*keep, F.col("prediction").cast("int").alias("pred")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return out.select(*cols)
