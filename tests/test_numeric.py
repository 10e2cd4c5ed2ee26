"""Imputation, power and quantile transforms, encoders."""

import math

import numpy as np
from pyspark.sql import functions as F

from gradeflow.operators import categorical as CT
from gradeflow.operators import numeric as NU


def test_exact_percentiles_and_median(spark):
    vals = [5.0, 1.0, 3.0, None, 2.0, 8.0, 3.0]
    df = spark.createDataFrame([(i, v, "a" if i % 2 else "b") for i, v in enumerate(vals)], "id int, x double, split string")
    got = sorted((r["p_idx"], r["value"]) for r in NU.exact_percentiles(df, "x", [0.0, 0.25, 0.5, 1.0]).collect())
    arr = np.array([v for v in vals if v is not None])
    assert [v for _, v in got] == [float(np.quantile(arr, q)) for q in (0.0, 0.25, 0.5, 1.0)]
    imp = {r["id"]: r["x"] for r in NU.impute_median(df, ["x"], by="split").collect()}
    a = [v for i, v in enumerate(vals) if i % 2 and v is not None]
    assert imp[3] == float(np.median(a))


def test_percentiles_with_a_hot_value(spark):
    # a third of the rows hold one value: it becomes one counted row
    vals = [7.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(8)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = [v for _, v in sorted((r["p_idx"], r["value"]) for r in NU.exact_percentiles(df, "x", probs).collect())]
    assert got == [float(np.quantile(np.array(vals), q)) for q in probs]


def test_all_null_and_constant(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 2.0)], "id int, x double, c double")
    out = NU.impute_median(df, ["x"], by=None).collect()
    assert all(r["x"] is None for r in out)
    bn = NU.batch_normalise(df, ["c"]).collect()
    assert all(r["c"] == 0.0 for r in bn)


def test_quantile_normal_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=300), 1)  # ties on purpose
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    out = {r["id"]: r["x"] for r in NU.quantile_normal(df, ["x"], n_quantiles=50).collect()}
    probs, refs = NU.fit_quantiles(df, "x", 50)
    assert refs == [float(np.quantile(x, q)) for q in probs]
    want = NU.np_quantile_normal(x, probs, refs)
    assert np.allclose([out[i] for i in range(len(x))], want)
    # probit sanity
    assert abs(NU.np_probit(np.array([0.975]))[0] - 1.959963984540054) < 1e-8


def test_power_fit_grid(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10, 20, 50]], "x double")
    fit = NU.fit_power(df, "x", "box-cox")
    xs = np.array([1, 2, 3, 4, 10, 20, 50.0])
    best = max(NU.LAMBDA_GRID, key=lambda l: (-len(xs) / 2 * np.log(np.var(((xs**l - 1) / l) if l else np.log(xs)))
                                              + (l - 1) * np.log(xs).sum(), -l))
    assert fit["lambda"] == best


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b, x"), (2, "a"), (3, "b, x"), (4, "c")], "id int, v string")
    oh = CT.one_hot(df, ["v"]).orderBy("id").collect()
    assert oh[0]["v_b, x"] == 1 and oh[1]["v_a"] == 1
    le = {r["id"]: r["v_label"] for r in CT.label_encode(df, ["v"]).collect()}
    assert le == {1: 1, 2: 0, 3: 1, 4: 2}
    be = CT.binary_encode(df, ["v"], "id").orderBy("id").first()
    assert be["v_b_x"] == 1  # lower case, ', ' -> '_'
    two = CT.binary_encode(df.filter(F.col("id") <= 2), ["v"], "id").orderBy("id").collect()
    assert [r["v_binary"] for r in two] == [0, 1]  # 1 = the class seen second
    one = CT.binary_encode(df.filter(F.col("id") == 2), ["v"], "id").first()
    assert one["v_binary"] == 0
    na = CT.category_na(spark.createDataFrame([(None,)], "v int"), ["v"]).first()["v"]
    assert na == "nan"
