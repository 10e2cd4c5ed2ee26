"""Metrics against direct formulas on hand-made cases (ties, one class,
zero denominators)."""

import math

from pyspark.sql import functions as F

from gradeflow.operators import metrics as M


def _df(spark, rows, schema="label int, pred int"):
    return spark.createDataFrame(rows, schema)


def test_qwk_identity_and_cases(spark):
    df = _df(spark, [(0, 0), (1, 1), (2, 2), (3, 3), (1, 1)])
    assert M.qwk(df).first()["qwk"] == 1.0
    # one class everywhere: expected disagreement 0 -> null
    assert M.qwk(_df(spark, [(1, 1), (1, 1)])).first()["qwk"] is None


def _qwk_brute(y, p):
    classes = sorted(set(y) | set(p))
    idx = {c: i for i, c in enumerate(classes)}
    k = len(classes)
    O = [[0] * k for _ in range(k)]
    for a, b in zip(y, p):
        O[idx[a]][idx[b]] += 1
    n = len(y)
    t = [sum(O[i]) for i in range(k)]
    q = [sum(O[i][j] for i in range(k)) for j in range(k)]
    num = sum((i - j) ** 2 * O[i][j] for i in range(k) for j in range(k))
    den = sum((i - j) ** 2 * t[i] * q[j] / n for i in range(k) for j in range(k))
    return 1 - num / den


def test_qwk_and_mcc_brute(spark):
    y = [0, 1, 2, 3, 3, 2, 1, 0, 2, 2, 5]
    p = [0, 2, 2, 3, 1, 2, 1, 1, 0, 2, 5]
    df = _df(spark, list(zip(y, p)))
    assert math.isclose(M.qwk(df).first()["qwk"], _qwk_brute(y, p))
    cs = M.classification_scores(df).first()
    assert math.isclose(cs["acc"], sum(a == b for a, b in zip(y, p)) / len(y))
    assert math.isclose(cs["f1_micro"], cs["acc"])
    # mcc: zero denominator -> 0
    assert M.mcc(_df(spark, [(1, 1), (1, 1)])).first()["mcc"] == 0.0


def _auc_brute(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l == 1]
    neg = [s for s, l in zip(scores, labels) if l != 1]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def test_roc_auc_with_ties(spark):
    scores = [0.1, 0.4, 0.4, 0.35, 0.8, 0.8, 0.2, 0.4]
    labels = [0, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int")
    assert math.isclose(M.roc_auc(df).first()["roc_auc"], _auc_brute(scores, labels))
    pr = {r["threshold"]: r for r in M.pr_curve(df).collect()}
    assert math.isclose(pr[0.4]["precision"], 3 / 5) and math.isclose(pr[0.4]["recall"], 3 / 4)
    best = M.best_f1_threshold(df).first()
    assert best["f1"] == max(
        2 * r["precision"] * r["recall"] / (r["precision"] + r["recall"]) for r in pr.values()
    )


def test_regression_and_folds(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "pred double, label double")
    r = M.regression_metrics(df).first()
    assert r["mse"] == 0.5 and r["mae"] == 0.5 and math.isclose(r["rmse"], math.sqrt(0.5))
    fm = spark.createDataFrame(
        [("fold_0", "eval_QWK", 0.5), ("fold_1", "eval_QWK", 0.7), ("fold_2", "eval_QWK", 0.7)],
        "fold string, metric string, value double",
    )
    agg = M.aggregate_folds(fm).first()
    assert math.isclose(agg["mean"], 0.6333333333333333)
    assert M.best_fold(fm).first()["fold"] == "fold_2"  # ties -> greatest name
    one = M.aggregate_folds(fm.limit(1)).first()
    assert one["stdev"] == 0.0


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "logits array<double>")
    r = df.select(M.predict_class("logits").alias("p"), M.softmax("logits").alias("s")).first()
    assert r["p"] == 1  # lowest index on ties
    assert math.isclose(sum(r["s"]), 1.0)
