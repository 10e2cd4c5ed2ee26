"""M1-M4, X2, X3 (model fits: rows-only checks, tests hold quality floors; M3
with two inputs has SQL)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradeflow.operators import categorical as CT
from gradeflow.operators import experiment as X
from gradeflow.operators import features as FT
from gradeflow.operators import models as MD
from gradeflow.operators import splits as D
from gradeflow.operators import vocab as V
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.joins import lookup_join
from gradeflow.plans.q_attention import inputs as attention_inputs
from gradeflow.plans.q_features import word_lists
from gradeflow.plans.q_vocab import DIM
from gradeflow.plans.registry import register
from gradeflow.sources import io as IO

FEATS = list(FT.FEATURE_COLUMNS)


def raw_features(spark, d, vocab=None):
    """Features of the scored essays; missing values stay missing."""
    feats = FT.generate_features(B.scored(spark, d), word_lists(spark, d, vocab))
    return feats.withColumn("label", F.col("domain1_score").cast("double"))


def scored_features(spark, d, vocab=None):
    return raw_features(spark, d, vocab).fillna(0.0, subset=FEATS)


def model_rows(spark, d):
    """N14 rows of the scored essays: mean vector, essay set and features."""
    vocab = B.corpus_vocab(spark, d)
    rows = scored_features(spark, d, vocab).drop("essay")
    vectors = B.vectors_from(vocab, B.table(spark, d, "embeddings"))
    mean = V.mean_embedding(B.scored(spark, d).select("essay_id", "essay"), vectors, DIM)
    joined = rows.join(mean, "essay_id").checkpoint()  # read for the categories and for the rows
    wide = CT.one_hot(joined, ["essay_set"])
    sets = sorted(c for c in wide.columns if c.startswith("essay_set_"))
    return CT.combine_concat(wide, "mean_vec", sets, FEATS).select("essay_id", "label", array_to_vector("combined").alias("row"))


def _split(spark, d):
    data = model_rows(spark, d).checkpoint()  # the fits read it many times
    roles = D.rotate_folds(data.select("essay_id")).filter(F.col("fold") == 0)
    part = data.join(roles, "essay_id")
    return part.filter(F.col("split") != "test"), part.filter(F.col("split") == "test")


def _classify(spark, d, head):
    train, test = _split(spark, d)
    model = MD.train_score_classifier(train, ["row"], "label", head=head, seed=42)
    return MD.predict(model, test, ["essay_id", F.col("label").cast("int").alias("label")])


def m1(spark, d):
    return _classify(spark, d, "linear")


def m2(spark, d):
    return _classify(spark, d, "mlp")


def m3(spark, d):
    reg = B.regress(spark, d).withColumn("log_pred", F.log1p("pred"))
    roles = D.rotate_folds(reg.select(F.col("row_id").alias("essay_id"))).filter(F.col("fold") == 0)
    part = reg.join(roles.withColumnRenamed("essay_id", "row_id"), "row_id")
    model = MD.train_score_regressor(part.filter(F.col("split") != "test"), ["pred", "log_pred"], "label")
    out = model.transform(part.filter(F.col("split") == "test"))
    return out.select("row_id", "label", F.round("prediction", 2).alias("pred"))


# Two inputs, so the normal equations are solved by hand: centred sums, then the
# inverse of a 2 x 2 matrix.
M3_SQL = S.with_(S.REGRESS) + f""", r AS (
  SELECT row_id, label, pred AS a, ln(1 + pred) AS b, {S.bucket_of('row_id')} = 0 AS held FROM regress),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(label) AS my FROM r WHERE NOT held),
c AS (SELECT sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb,
  sum((a - ma) * (label - my)) AS ay, sum((b - mb) * (label - my)) AS by_ FROM r, m WHERE NOT held)
SELECT row_id, label, round(my + (a - ma) * (ay * bb - by_ * ab) / (aa * bb - ab * ab) + (b - mb) * (by_ * aa - ay * ab) / (aa * bb - ab * ab), 2) AS pred
FROM r, m, c WHERE held"""


def m3_row(spark, d):
    """M3 on the combined rows of N14, as M1 and M2."""
    train, test = _split(spark, d)
    out = MD.train_score_regressor(train, ["row"], "label").transform(test)
    return out.select("essay_id", "label", F.col("prediction").alias("pred"))


def m1_weighted(spark, d):
    """M1 with class weights: rows of a class count as much as its share is small."""
    train, test = _split(spark, d)
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # a row per class
    total = train.count()
    train = lookup_join(train, sizes, ["label"]).withColumn("class_weight", F.lit(float(total)) / F.col("n"))
    model = MD.train_score_classifier(train, ["row"], "label", head="linear", weight_col="class_weight", seed=42)
    return MD.predict(model, test, ["essay_id", F.col("label").cast("int").alias("label")])


def m4(spark, d):
    return MD.select_features_rfe(scored_features(spark, d), FEATS, "label", k=16, step=2, max_iter=25)


register("M1_train_score_classifier")(m1)
register("M2_train_score_classifier_mlp")(m2)
register("M3_train_score_regressor", M3_SQL)(m3)
register("M1_train_score_classifier_weighted")(m1_weighted)
register("M3_train_score_regressor_row")(m3_row)
register("M4_select_features_rfe")(m4)


def x2(share=1.0, keywords=True):
    """One of the four kinds of runs; each covers all essay sets."""

    def run(spark, d):
        vocab = B.corpus_vocab(spark, d)  # fitted once, shared by the word lists and the attention
        features, kf = raw_features(spark, d, vocab), None
        if keywords:
            from gradeflow.operators.attention import keyword_block

            seqs, pseq, vocab, vectors = attention_inputs(spark, d, vocab)
            # attention only for the essays that carry a score (the ones scored per fold)
            seqs = seqs.join(B.scored(spark, d).select("essay_id"), "essay_id", "left_semi")
            kf = keyword_block(seqs, pseq, vocab, vectors, 64, 10000)
        return X.run_folds(features, k=5, keyword_features=kf, train_share=share, multiple=32)

    return run


def x3(task="classification", transform="quantile_normal"):
    """k-fold mode with one head and one numeric transform."""

    def run(spark, d):
        feats = raw_features(spark, d).select("essay_id", "essay_set", "label", *FEATS)
        cfg = X.RunConfig(mode="kfold", task=task, k=5, numerical_transformer=transform, cat_cols=["essay_set"], num_cols=FEATS, label_col="label")
        return X.run_config(cfg, data=feats)

    return run


def x3_folder(task):
    """Folder mode: the splits of the first rotation."""

    def run(spark, d):
        feats = raw_features(spark, d).select("essay_id", "essay_set", "label", *FEATS)
        roles = D.rotate_folds(feats.select("essay_id")).filter(F.col("fold") == 0).drop("fold")
        part = feats.join(roles, "essay_id").checkpoint()
        splits = {name: part.filter(F.col("split") == role).drop("split") for name, role in (("train", "train"), ("val", "dev"), ("test", "test"))}
        cfg = X.RunConfig(mode="folder", task=task, cat_cols=["essay_set"], num_cols=FEATS, label_col="label",
                          output_dir=IO.scratch_path(spark, "folder-run"))
        return X.run_config(cfg, splits=splits)

    return run


register("X2_run_folds")(x2())
register("X2_run_folds_half")(x2(0.5))
register("X2_run_folds_no_keywords")(x2(1.0, False))
register("X2_run_folds_half_no_keywords")(x2(0.5, False))
register("X3_run_folder_or_folds")(x3())
register("X3_run_folds_regression")(x3("regression"))
register("X3_run_folds_yeo_johnson")(x3(transform="yeo_johnson"))
register("X3_run_folds_no_transform")(x3(transform="none"))
register("X3_run_folder_regression")(x3_folder("regression"))
register("X3_run_folder_classification")(x3_folder("classification"))
