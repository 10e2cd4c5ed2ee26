"""E1-E15 and M5-M7 over the logits / binary / regress bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import metrics as M
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.registry import register


def _r(df, digits=6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lp(spark, d):
    lg = B.logits(spark, d)
    return lg.withColumn("pred", M.predict_class("logits"))


def folded(spark, d):
    return lp(spark, d).withColumn("fold", F.concat(F.lit("fold_"), B.bucket_of("row_id").cast("string")))


def bin_pred(spark, d, ties=False):
    b = B.binary_ties(spark, d) if ties else B.binary(spark, d)
    return b.withColumn("pred", (F.col("score") > (2 if ties else 0)).cast("int"))


LP = S.with_(S.LOGITS) + """, lp AS (SELECT row_id, logits, label,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM logits)"""

PC = """, conf AS (SELECT label, pred, count(*) AS cnt FROM src GROUP BY label, pred),
roles AS (
  SELECT label AS c, CASE WHEN label = pred THEN cnt ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN label <> pred THEN cnt ELSE 0 END AS fn, cnt AS support FROM conf
  UNION ALL SELECT pred, 0, CASE WHEN label <> pred THEN cnt ELSE 0 END, 0, 0 FROM conf),
pc AS (SELECT c, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn,
  CAST(sum(support) AS DOUBLE) AS support FROM roles GROUP BY c),
pf AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM pc),
ag AS (SELECT sum(tp) AS c, sum(support) AS n, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted,
  sum(support * (tp + fp)) AS sum_tp_k, sum((tp + fp) * (tp + fp)) AS sum_p2, sum(support * support) AS sum_t2 FROM pf),
cs AS (SELECT c / n AS acc, CASE WHEN 2 * c + 2 * (n - c) = 0 THEN 0.0 ELSE 2 * c / (2 * c + 2 * (n - c)) END AS f1_micro,
  f1_macro, f1_weighted,
  CASE WHEN sqrt((n * n - sum_p2) * (n * n - sum_t2)) = 0 THEN 0.0
       ELSE (c * n - sum_tp_k) / sqrt((n * n - sum_p2) * (n * n - sum_t2)) END AS mcc FROM ag),
cls AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS DOUBLE) AS i FROM (SELECT label AS c FROM src UNION SELECT pred FROM src)),
kx AS (SELECT count(*) AS n, sum((a.i - b.i) * (a.i - b.i)) AS obs, sum(a.i * a.i) AS t2, sum(b.i * b.i) AS p2,
  sum(a.i) AS t1, sum(b.i) AS p1 FROM src JOIN cls a ON src.label = a.c JOIN cls b ON src.pred = b.c),
kq AS (SELECT CASE WHEN t2 + p2 - 2 * t1 * p1 / n = 0 THEN NULL ELSE 1 - obs / (t2 + p2 - 2 * t1 * p1 / n) END AS qwk FROM kx)"""

LPS = LP + ", src AS (SELECT label, pred FROM lp)" + PC


def r6(e):
    return S.r6(e)


# ---------------------------------------------------------------- M5-M7
register("M5_predict_class", LP + " SELECT row_id, pred FROM lp")(
    lambda spark, d: lp(spark, d).select("row_id", "pred")
)

register(
    "M6_softmax_scores",
    LP + """ SELECT row_id, list_transform(list_transform(logits, lambda x: exp(x - list_max(logits))),
  lambda e: round(e / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 6)) AS probs FROM lp""",
)(
    lambda spark, d: B.logits(spark, d).select(
        "row_id", F.transform(M.softmax("logits"), lambda x: F.round(x, 6)).alias("probs")
    )
)

register(
    "M7_cross_entropy",
    LP + """ SELECT round(avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
  - logits[label + 1]), 6) AS cross_entropy FROM lp""",
)(lambda spark, d: _r(M.cross_entropy(B.logits(spark, d))))

# the binary form takes class 1 of two logits
register(
    "M6_softmax_class_1",
    S.with_(S.LOGITS) + "SELECT row_id, round(exp(logits[2]) / (exp(logits[1]) + exp(logits[2])), 6) AS prob FROM logits",
)(
    lambda spark, d: B.logits(spark, d).select(
        "row_id", F.round(F.element_at(M.softmax(F.slice("logits", 1, 2)), 2), 6).alias("prob"))
)

_WEIGHTS = [1.0 + i / 4 for i in range(10)]
register(
    "M7_weighted_cross_entropy",
    LP + """, w AS (SELECT 1 + label / 4.0::DOUBLE AS w, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
  - logits[label + 1] AS nll FROM lp)
SELECT round(sum(w * nll) / sum(w), 6) AS cross_entropy FROM w""",
)(lambda spark, d: _r(M.cross_entropy(B.logits(spark, d), weights=_WEIGHTS)))

register("M7_mse_loss", S.with_(S.REGRESS) + "SELECT round(avg((pred - label) * (pred - label)), 3) AS mse_loss FROM regress")(
    lambda spark, d: M.mse_loss(B.regress(spark, d)).select(F.round("mse_loss", 3).alias("mse_loss"))
)

# ---------------------------------------------------------------- E1, E6-E10, E13
register("E1_confusion", LP + " SELECT label, pred, CAST(count(*) AS BIGINT) AS count FROM lp GROUP BY label, pred")(
    lambda spark, d: M.confusion(lp(spark, d))
)

register(
    "E1_binary_confusion",
    S.with_(S.BINARY)
    + """SELECT CAST(count(*) FILTER (WHERE label = 0 AND score <= 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE label = 0 AND score > 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND score <= 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE label = 1 AND score > 0) AS BIGINT) AS tp FROM bin""",
)(lambda spark, d: M.binary_confusion(bin_pred(spark, d)))

register("E6_accuracy", LP + " SELECT round(avg(CAST(label = pred AS DOUBLE)), 6) AS acc FROM lp")(
    lambda spark, d: _r(M.accuracy(lp(spark, d)))
)

register(
    "E7_f1",
    LPS + f" SELECT {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro, {r6('f1_weighted')} AS f1_weighted FROM cs",
)(lambda spark, d: _r(M.classification_scores(lp(spark, d)).select("f1_micro", "f1_macro", "f1_weighted")))

register("E8_mcc", LPS + f" SELECT {r6('mcc')} AS mcc FROM cs")(lambda spark, d: _r(M.mcc(lp(spark, d))))

register("E9_qwk", LPS + f" SELECT {r6('qwk')} AS qwk FROM kq")(lambda spark, d: _r(M.qwk(lp(spark, d))))

register("E10_acc_and_f1", LPS + f" SELECT {r6('(acc + f1_weighted) / 2')} AS acc_and_f1 FROM cs")(
    lambda spark, d: _r(M.benchmark_report(lp(spark, d)).select("acc_and_f1"))
)

register(
    "E13_benchmark_report",
    LPS + f""" SELECT {r6('acc')} AS acc, {r6('f1_weighted')} AS f1, {r6('(acc + f1_weighted) / 2')} AS acc_and_f1,
  {r6('mcc')} AS mcc, {r6('qwk')} AS qwk FROM cs, kq""",
)(lambda spark, d: _r(M.benchmark_report(lp(spark, d))))

# ---------------------------------------------------------------- curves
CURVE = """, sc AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM bin GROUP BY score),
cu AS (SELECT score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
  CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
  CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS P, CAST(sum(neg) OVER () AS DOUBLE) AS N FROM sc),
pr AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / P AS recall FROM cu),
prf AS (SELECT *, CASE WHEN precision + recall = 0 OR isnan(2 * precision * recall / (precision + recall)) THEN 0.0
  ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
roc AS (SELECT sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)) AS roc_auc FROM cu),
best AS (SELECT threshold, precision, recall, f1 FROM prf WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1),
pra AS (SELECT sum((recall - r0) * (precision + p0) / 2) AS pr_auc FROM (
  SELECT precision, recall, coalesce(lag(precision) OVER (ORDER BY threshold DESC), 1.0) AS p0,
         coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0.0) AS r0 FROM pr))"""

TIES = S.with_(S.BINARY_TIES) + CURVE
EMB = S.with_(S.BINARY) + CURVE

register("E2_roc_auc", TIES + f" SELECT {r6('roc_auc')} AS roc_auc FROM roc")(
    lambda spark, d: _r(M.roc_auc(B.binary_ties(spark, d)))
)

register(
    "E3_pr_curve",
    TIES + f" SELECT threshold, {r6('precision')} AS precision, {r6('recall')} AS recall FROM pr",
)(lambda spark, d: _r(M.pr_curve(B.binary_ties(spark, d))))

register(
    "E4_best_f1_threshold",
    TIES + f" SELECT threshold, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM best",
)(lambda spark, d: _r(M.best_f1_threshold(B.binary_ties(spark, d))))

register("E5_pr_auc", TIES + f" SELECT {r6('pr_auc')} AS pr_auc FROM pra")(
    lambda spark, d: _r(M.pr_auc(B.binary_ties(spark, d)))
)

register(
    "E11_regression_metrics",
    S.with_(S.REGRESS)
    + """ SELECT round(avg((pred - label) * (pred - label)), 3) AS mse, round(sqrt(avg((pred - label) * (pred - label))), 6) AS rmse,
  round(avg(abs(pred - label)), 6) AS mae FROM regress""",
)(
    lambda spark, d: M.regression_metrics(B.regress(spark, d)).select(
        F.round("mse", 3).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae")
    )
)

register(
    "E12_classification_report",
    S.with_(S.BINARY)
    + CURVE
    + f""", bp AS (SELECT label, CAST(score > 0 AS INTEGER) AS pred FROM bin),
cf AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS BIGINT) AS tp FROM bp)
SELECT {r6('roc_auc')} AS roc_auc, threshold, {r6('precision')} AS precision, {r6('recall')} AS recall,
  {r6('f1')} AS f1, {r6('pr_auc')} AS pr_auc, tn, fp, fn, tp FROM roc, best, pra, cf""",
)(lambda spark, d: _r(M.classification_report(bin_pred(spark, d))))

# more than two labels: the multiclass branch
register(
    "E12_classification_report_multiclass",
    LPS + f""" SELECT {r6('acc')} AS acc, {r6('f1_micro')} AS f1_micro, {r6('f1_macro')} AS f1_macro,
  {r6('f1_weighted')} AS f1_weighted, {r6('mcc')} AS mcc FROM cs""",
)(lambda spark, d: _r(M.classification_report(lp(spark, d))))

# ---------------------------------------------------------------- folds
FOLD_SQL = (
    S.with_(S.LOGITS)
    + f""", fl AS (SELECT 'fold_' || CAST({S.bucket_of('row_id')} AS VARCHAR) AS fold, label,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM logits),
conf AS (SELECT fold, label, pred, count(*) AS cnt FROM fl GROUP BY fold, label, pred),
roles AS (
  SELECT fold, label AS c, CASE WHEN label = pred THEN cnt ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN label <> pred THEN cnt ELSE 0 END AS fn, cnt AS support FROM conf
  UNION ALL SELECT fold, pred, 0, CASE WHEN label <> pred THEN cnt ELSE 0 END, 0, 0 FROM conf),
pc AS (SELECT fold, c, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn,
  CAST(sum(support) AS DOUBLE) AS support FROM roles GROUP BY fold, c),
pf AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM pc),
ag AS (SELECT fold, sum(tp) AS c, sum(support) AS n, sum(f1 * support) / sum(support) AS f1w,
  sum(support * (tp + fp)) AS sum_tp_k, sum((tp + fp) * (tp + fp)) AS sum_p2, sum(support * support) AS sum_t2 FROM pf GROUP BY fold),
cs AS (SELECT fold, c / n AS acc, f1w,
  CASE WHEN sqrt((n * n - sum_p2) * (n * n - sum_t2)) = 0 THEN 0.0
       ELSE (c * n - sum_tp_k) / sqrt((n * n - sum_p2) * (n * n - sum_t2)) END AS mcc FROM ag),
cls AS (SELECT fold, c, CAST(row_number() OVER (PARTITION BY fold ORDER BY c) - 1 AS DOUBLE) AS i
  FROM (SELECT fold, label AS c FROM fl UNION SELECT fold, pred FROM fl)),
kx AS (SELECT fl.fold, count(*) AS n, sum((a.i - b.i) * (a.i - b.i)) AS obs, sum(a.i * a.i) AS t2, sum(b.i * b.i) AS p2,
  sum(a.i) AS t1, sum(b.i) AS p1 FROM fl JOIN cls a ON fl.fold = a.fold AND fl.label = a.c
  JOIN cls b ON fl.fold = b.fold AND fl.pred = b.c GROUP BY fl.fold),
kq AS (SELECT fold, CASE WHEN t2 + p2 - 2 * t1 * p1 / n = 0 THEN NULL ELSE 1 - obs / (t2 + p2 - 2 * t1 * p1 / n) END AS qwk FROM kx),
fm AS (
  SELECT fold, 'eval_acc' AS metric, acc AS value FROM cs
  UNION ALL SELECT fold, 'eval_f1', f1w FROM cs
  UNION ALL SELECT fold, 'eval_acc_and_f1', (acc + f1w) / 2 FROM cs
  UNION ALL SELECT fold, 'eval_mcc', mcc FROM cs
  UNION ALL SELECT fold, 'eval_QWK', qwk FROM kq)"""
)


def fold_metrics(spark, d):
    rep = M.benchmark_report(folded(spark, d), by=["fold"])
    names = {"acc": "eval_acc", "f1": "eval_f1", "acc_and_f1": "eval_acc_and_f1", "mcc": "eval_mcc", "qwk": "eval_QWK"}
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(k).alias("value")) for k, v in names.items()])
    return rep.select("fold", F.explode(pairs).alias("x")).select("fold", "x.metric", "x.value")


register(
    "E14_aggregate_folds",
    FOLD_SQL + f" SELECT metric, {r6('avg(value)')} AS mean, {r6('coalesce(stddev_samp(value), 0.0)')} AS stdev FROM fm GROUP BY metric",
)(lambda spark, d: _r(M.aggregate_folds(fold_metrics(spark, d))))

register(
    "E15_best_fold",
    FOLD_SQL + f" SELECT fold, {r6('value')} AS value FROM fm WHERE metric = 'eval_QWK' ORDER BY value DESC, fold DESC LIMIT 1",
)(lambda spark, d: _r(M.best_fold(fold_metrics(spark, d))))
