"""Evaluation (E1-E15) and score-level model outputs (M5-M7).

Every metric starts from a map-side aggregation: the confusion table
(classes x classes rows), or per-distinct-score positive/negative counts for
the curves.  Curve running sums use the distributed running sum (no
unpartitioned window over raw rows).  Quadratic kappa expands
``sum_ij (i-j)^2 t_i p_j / n`` into per-class sums, so no classes x classes
cross product is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.plans.joins import lookup_join
from gradeflow.plans.rank import global_rank, global_running_sum

# ---------------------------------------------------------------- M5-M7


def predict_class(logits) -> F.Column:
    """M5: arg-max, the lowest index on ties (0-based)."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("int")


def softmax(logits) -> F.Column:
    """M6: softmax shifted by the row max."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(lg)
    ex = F.transform(lg, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / total)


def log_sum_exp(logits) -> F.Column:
    lg = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(lg)
    return m + F.log(F.aggregate(F.transform(lg, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))


def cross_entropy(df: DataFrame, logits="logits", label="label", weights: list[float] | None = None) -> DataFrame:
    """M7: (weighted) mean of ``logsumexp(l) - l[label]``."""
    nll = log_sum_exp(logits) - F.element_at(F.col(logits), F.col(label) + 1)
    if weights is None:
        return df.agg(F.avg(nll).alias("cross_entropy"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col(label) + 1)
    return df.agg((F.sum(w * nll) / F.sum(w)).alias("cross_entropy"))


def mse_loss(df: DataFrame, pred="pred", label="label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(pred) - F.col(label), 2)).alias("mse_loss"))


# ---------------------------------------------------------------- confusion based


def confusion(df: DataFrame, label="label", pred="pred", by=()) -> DataFrame:
    """Counts by (label, pred)."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).cast("long").alias("count")
    )


def binary_confusion(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """E1 binary form with labels [0, 1]."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
        F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
        F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"),
    )


def per_class(conf: DataFrame, by=()) -> DataFrame:
    """tp, fp, fn, support per class over the union of labels and predictions."""
    same = F.col("label") == F.col("pred")
    roles = F.array(
        F.struct(F.col("label").alias("c"), F.when(same, F.col("count")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"), F.when(~same, F.col("count")).otherwise(0).alias("fn"),
                 F.col("count").alias("support")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("tp"),
                 F.when(~same, F.col("count")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"),
                 F.lit(0).cast("long").alias("support")),
    )
    x = conf.select(*by, F.explode(roles).alias("r")).select(*by, "r.*")
    return x.groupBy(*by, "c").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "support")])


def _f1_col():
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(den == 0, F.lit(0.0)).otherwise(2 * F.col("tp") / den)


def classification_scores(df: DataFrame, label="label", pred="pred", by=()) -> DataFrame:
    """E6, E7, E8 in one row (per group ``by``): acc, f1_micro, f1_macro,
    f1_weighted, mcc."""
    return _scores_of(confusion(df, label, pred, by), by)


def _scores_of(conf: DataFrame, by=()) -> DataFrame:
    pc = per_class(conf, by).withColumn("f1", _f1_col())
    agg = pc.groupBy(*by).agg(
        F.sum("tp").alias("tp"),
        F.sum("support").alias("n"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum(F.col("support") * (F.col("tp") + F.col("fp"))).alias("sum_tp_k"),
        F.sum(F.pow(F.col("tp") + F.col("fp"), 2)).alias("sum_p2"),
        F.sum(F.pow(F.col("support"), 2)).alias("sum_t2"),
    )
    n, c = F.col("n").cast("double"), F.col("tp").cast("double")
    den = F.sqrt((n * n - F.col("sum_p2")) * (n * n - F.col("sum_t2")))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((c * n - F.col("sum_tp_k")) / den)
    acc = c / n
    micro_den = 2 * c + 2 * (n - c)
    f1_micro = F.when(micro_den == 0, F.lit(0.0)).otherwise(2 * c / micro_den)
    return agg.select(
        *by, acc.alias("acc"), f1_micro.alias("f1_micro"), F.col("f1_macro"), F.col("f1_weighted"), mcc.alias("mcc")
    )


def accuracy(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """E6."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"))


def f1(df: DataFrame, average: str = "weighted", label="label", pred="pred") -> DataFrame:
    """E7."""
    return classification_scores(df, label, pred).select(F.col(f"f1_{average}").alias(f"f1_{average}"))


def mcc(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """E8."""
    return classification_scores(df, label, pred).select("mcc")


def _qwk_of(conf: DataFrame, by=()) -> DataFrame:
    """E9 from a confusion table (one row per class pair)."""
    by = list(by)
    classes = conf.select(*by, F.col("label").alias("c")).union(conf.select(*by, F.col("pred").alias("c"))).distinct()
    # one row per class and group: the window never holds data rows
    place = Window.partitionBy(*(by or [F.lit(0)])).orderBy("c")
    idx = classes.withColumn("i", (F.row_number().over(place) - 1).cast("double"))
    x = conf.join(idx.withColumnsRenamed({"c": "label", "i": "ti"}), [*by, "label"]).join(
        idx.withColumnsRenamed({"c": "pred", "i": "pj"}), [*by, "pred"])
    n = F.col("count")
    s = x.groupBy(*by).agg(
        F.sum(n).cast("double").alias("n"),
        F.sum(n * F.pow(F.col("ti") - F.col("pj"), 2)).alias("obs"),
        F.sum(n * F.col("ti") * F.col("ti")).alias("t2"),
        F.sum(n * F.col("pj") * F.col("pj")).alias("p2"),
        F.sum(n * F.col("ti")).alias("t1"),
        F.sum(n * F.col("pj")).alias("p1"),
    )
    expected = F.col("t2") + F.col("p2") - 2 * F.col("t1") * F.col("p1") / F.col("n")
    kappa = F.when(expected == 0, F.lit(None)).otherwise(1 - F.col("obs") / expected).cast("double")
    return s.select(*by, kappa.alias("qwk"))


def qwk(df: DataFrame, label="label", pred="pred", by=()) -> DataFrame:
    """Quadratic weighted kappa with class index = position in the sorted
    union of labels and predictions (per group); null when the expected
    disagreement is 0.  Rows with a null label or prediction do not count."""
    fine = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    return _qwk_of(confusion(fine, label, pred, by).checkpoint(), by)


def benchmark_report(df: DataFrame, label="label", pred="pred", by=()) -> DataFrame:
    """E13 (and E10): acc, f1 (weighted), acc_and_f1, mcc, qwk in one row per
    group, all from one confusion table."""
    conf = confusion(df, label, pred, by).checkpoint()
    cs = _scores_of(conf, by)
    k = _qwk_of(conf.filter(F.col("label").isNotNull() & F.col("pred").isNotNull()), by)
    row = cs.select(*by, "acc", F.col("f1_weighted").alias("f1"), "mcc")
    j = _zip_rows(row, k, by=by)
    return j.select(*by, "acc", "f1", ((F.col("acc") + F.col("f1")) / 2).alias("acc_and_f1"), "mcc", "qwk")


# ---------------------------------------------------------------- curves (binary)


def score_counts(df: DataFrame, score="score", label="label") -> DataFrame:
    """Positives and negatives per distinct score (map-side partial agg)."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("pos"),
        F.count_if(F.col(label) != 1).cast("long").alias("neg"),
    )


def _cumulative(df: DataFrame, score="score", label="label") -> DataFrame:
    """Per distinct score in descending order: cumulative tp and fp (scores >=)."""
    sc = score_counts(df, score, label)
    return global_running_sum(sc, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})


def _curve(df: DataFrame, score="score", label="label") -> DataFrame:
    """One row per distinct score, highest first: threshold, precision,
    recall, F, the slice of the ROC area, and the slice of the PR area from
    the point before, which is this one without its own counts."""
    c = _cumulative(df, score, label)
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "pos", "neg"))
    total = F.col("tp_total")
    c = c.withColumns({"precision": tp / (tp + fp), "recall": tp / total})
    before = tp - pos + fp - neg
    p0 = F.when(before == 0, F.lit(1.0)).otherwise((tp - pos) / F.nullif(before, F.lit(0)))
    den = F.col("precision") + F.col("recall")
    f = F.try_divide(2 * F.col("precision") * F.col("recall"), den)
    return c.select(
        F.col("score").alias("threshold"), "precision", "recall", "tp_total", "fp_total",
        F.when((den == 0) | f.isNull() | F.isnan(f), F.lit(0.0)).otherwise(f).alias("f1"),
        (neg * (tp - pos / 2.0)).alias("roc_part"),
        ((F.col("recall") - (tp - pos) / total) * (F.col("precision") + p0) / 2).alias("pr_part"),
    )


def _roc():
    return F.sum("roc_part") / (F.max("tp_total") * F.max("fp_total"))


def roc_auc(df: DataFrame, score="score", label="label") -> DataFrame:
    """Tie-aware ROC AUC (trapezoid over distinct scores)."""
    return _curve(df, score, label).agg(_roc().alias("roc_auc"))


def pr_curve(df: DataFrame, score="score", label="label") -> DataFrame:
    """Precision, recall per distinct score as threshold (predict >= t)."""
    return _curve(df, score, label).select("threshold", "precision", "recall")


def best_f1_threshold(df: DataFrame, score="score", label="label") -> DataFrame:
    """The threshold with the highest F (NaN -> 0), lowest threshold on
    ties; no row when every F is 0."""
    best = _curve(df, score, label).filter(F.col("f1") > 0).orderBy(F.col("f1").desc(), F.col("threshold")).limit(1)
    return best.select("threshold", "precision", "recall", "f1")


def pr_auc(df: DataFrame, score="score", label="label") -> DataFrame:
    """E5: trapezoid over (recall, precision) from the point (0, 1) through
    the thresholds in descending order."""
    return _curve(df, score, label).agg(F.sum("pr_part").alias("pr_auc"))


def regression_metrics(df: DataFrame, pred="pred", label="label", by=()) -> DataFrame:
    """Mse, rmse, mae (per group ``by``)."""
    err = F.col(pred) - F.col(label)
    s = df.groupBy(*by).agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"))
    return s.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae")


def _zip_rows(*dfs: DataFrame, by=()) -> DataFrame:
    """Put one-row-per-group results side by side: each goes to long form
    (metric, value), they are unioned and folded back by one aggregation per
    group (no join between the results)."""
    by = list(by)
    cols, longs = [], []
    for d in dfs:
        fields = [f for f in d.schema.fields if f.name not in by]
        cols += [(f.name, f.dataType) for f in fields]
        pairs = F.array(*[F.struct(F.lit(f.name).alias("m"), F.col(f.name).cast("double").alias("v")) for f in fields])
        longs.append(d.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*"))
    u = reduce(lambda a, b: a.unionByName(b), longs)
    return u.groupBy(*by).agg(
        *[F.max(F.when(F.col("m") == name, F.col("v"))).cast(dt).alias(name) for name, dt in cols]
    )


def classification_report(df: DataFrame, score="score", label="label", pred="pred") -> DataFrame:
    """Binary branch when there are exactly two distinct labels (AUCs,
    best-F threshold, confusion), else the multiclass scores."""
    n_labels = df.select(label).distinct().limit(3).count()
    if n_labels != 2:
        return classification_scores(df, label, pred)
    best = F.when(F.col("f1") > 0, F.struct("f1", (-F.col("threshold")).alias("low"), "precision", "recall"))
    curve = _curve(df, score, label).agg(
        _roc().alias("roc_auc"), F.sum("pr_part").alias("pr_auc"), F.max(best).alias("b"))
    curve = curve.select("roc_auc", (-F.col("b.low")).alias("threshold"), F.col("b.precision").alias("precision"),
                         F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"), "pr_auc")
    return _zip_rows(curve, binary_confusion(df, label, pred))


def aggregate_folds(metrics: DataFrame) -> DataFrame:
    """Per metric the mean and sample deviation over folds (0 for one
    fold).  Input is long: (fold, metric, value)."""
    return metrics.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev")
    )


def best_fold(metrics: DataFrame, metric: str = "eval_QWK") -> DataFrame:
    """The fold with the highest metric, ties -> the greatest fold name."""
    m = metrics.filter(F.col("metric") == metric)
    return m.orderBy(F.col("value").desc(), F.col("fold").desc()).limit(1).select("fold", "value")
