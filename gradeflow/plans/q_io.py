"""Each query writes data derived from the given tables to
the scratch folder with our sink and reads it back with our source."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions.text import num_sentences, num_words
from gradeflow.operators import clean as C
from gradeflow.operators import metrics as M
from gradeflow.operators import splits as D
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.q_metrics import FOLD_SQL, fold_metrics, lp
from gradeflow.plans.registry import register
from gradeflow.sources import io as IO


def s1(spark, d):
    path = IO.scratch_path(spark, "essays_tsv")
    IO.write_delimited(B.essays(spark, d), path, "\t", "ISO-8859-1")
    return IO.read_essays(spark, path, "\t", "ISO-8859-1")


register("S1_read_essays", S.with_(S.ESSAYS) + "SELECT essay_id, essay_set, essay, domain1_score FROM essays")(s1)


def s2(spark, d):
    folder = IO.scratch_path(spark, "split_folder")
    e = B.essays(spark, d)
    roles = D.rotate_folds(e.select("essay_id")).filter(F.col("fold") == 0)
    j = e.join(roles, "essay_id")
    for name, role in (("train", "train"), ("val", "dev"), ("test", "test")):
        IO.write_delimited(j.filter(F.col("split") == role).select(*e.columns), f"{folder}/{name}.csv", ",", "UTF-8")
    return IO.union_splits(IO.read_split_folder(spark, folder)).select("essay_id", "split")


register(
    "S2_read_split_folder",
    S.with_(S.ESSAYS)
    + f"""SELECT essay_id, CASE {S.bucket_of('essay_id')} WHEN 0 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS split
FROM essays""",
)(s2)


def s3(spark, d):
    folder = IO.scratch_path(spark, "fold_ids")
    IO.write_fold_ids(B.fold_ids(spark, d), folder)
    return IO.read_fold_ids(spark, folder)


register("S3_read_fold_ids", S.with_(S.FOLD_IDS) + "SELECT CAST(fold AS INTEGER) AS fold, role, essay_id FROM fold_ids")(s3)


def s4(spark, d):
    path = IO.scratch_path(spark, "vectors_txt")
    vocab = B.corpus_vocab(spark, d)
    IO.write_word_vectors(B.vectors_from(vocab, B.table(spark, d, "embeddings")), path)
    v = IO.read_word_vectors(spark, path)
    return v.select("word", F.transform("vec", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


register(
    "S4_read_word_vectors",
    S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS)
    + f"SELECT word, list_transform(vec, lambda x: {S.r6('x')}) AS vec FROM vectors",
)(s4)


def s6(spark, d):
    path = IO.scratch_path(spark, "features")
    e = B.texts(spark, d)
    feats = e.select("essay_id", "essay_set", num_words("essay").alias("num_words"), num_sentences("essay").alias("num_sentences"))
    IO.write_features(feats, path)
    back = spark.read.parquet(path)
    return back.select("essay_id", "essay_set", "num_words", "num_sentences")


register(
    "S6_write_features",
    S.with_(S.ESSAYS)
    + f"SELECT essay_id, essay_set, {S.num_words('essay')} AS num_words, {S.num_sentences('essay')} AS num_sentences FROM essays",
)(s6)


def s7(spark, d):
    path = IO.scratch_path(spark, "splits")
    IO.write_splits(D.rotate_folds(B.texts(spark, d).select("essay_id")), path)
    back = spark.read.parquet(path)
    return back.select(F.col("fold").cast("int").alias("fold"), "split", "essay_id")


register(
    "S7_write_splits",
    S.with_(S.ESSAYS)
    + f""", pf AS (SELECT essay_id, {S.bucket_of('essay_id')} AS b, unnest(range(0, 5)) AS fold FROM essays)
SELECT CAST(fold AS INTEGER) AS fold,
  CASE WHEN b = fold THEN 'test' WHEN b = (fold + 4) % 5 THEN 'dev' ELSE 'train' END AS split, essay_id FROM pf""",
)(s7)


def s8(spark, d):
    path = IO.scratch_path(spark, "predictions")
    IO.write_predictions(lp(spark, d), path, "classification", "row_id", "pred")
    return spark.read.text(path)


register(
    "S8_write_predictions",
    S.with_(S.LOGITS)
    + """SELECT 'index' || chr(9) || 'prediction' AS value
UNION ALL SELECT CAST(row_id AS VARCHAR) || chr(9) || CAST(list_position(logits, list_max(logits)) - 1 AS VARCHAR) FROM logits""",
)(s8)


_NAMES = [f"grade {i}" for i in range(10)]


def s8_names(spark, d):
    path = IO.scratch_path(spark, "predictions")
    IO.write_predictions(C.map_label_names(lp(spark, d), _NAMES, "pred", "name"), path, "classification", "row_id", "name")
    return spark.read.text(path)


register(
    "S8_write_predictions_names",
    S.with_(S.LOGITS)
    + """SELECT 'index' || chr(9) || 'prediction' AS value
UNION ALL SELECT CAST(row_id AS VARCHAR) || chr(9) || 'grade ' || CAST(list_position(logits, list_max(logits)) - 1 AS VARCHAR) FROM logits""",
)(s8_names)


def s8_regression(spark, d):
    """Eighths are exact in both engines, so three decimals need no rounding."""
    path = IO.scratch_path(spark, "predictions")
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id")
    rows = docs.select("doc_id", (F.col("n_chars") / 8.0).alias("pred"), "quality")
    IO.write_predictions(rows, path, "regression", "doc_id", "pred", "quality")
    return spark.read.text(path)


register(
    "S8_write_predictions_regression",
    """SELECT 'index' || chr(9) || 'prediction' AS value
UNION ALL SELECT printf('%d	%.3f	%d', d.doc_id, d.n_chars / 8.0::DOUBLE, l.quality) FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)(s8_regression)


def s9(spark, d):
    path = IO.scratch_path(spark, "metrics")
    agg = M.aggregate_folds(fold_metrics(spark, d)).select("metric", F.col("mean").alias("value"))
    IO.write_metrics(agg, path)
    return spark.read.text(path)


register(
    "S9_write_metrics",
    FOLD_SQL + " SELECT printf('%s = %.6f', metric, avg(value)) AS value FROM fm GROUP BY metric",
)(s9)


def s9_json(spark, d):
    path = IO.scratch_path(spark, "metrics")
    agg = M.aggregate_folds(fold_metrics(spark, d)).select("metric", F.col("mean").alias("value"))
    IO.write_metrics(agg, path, as_json=True)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))
    return back.select("metric", F.round("value", 6).alias("value"))


register(
    "S9_write_metrics_json",
    FOLD_SQL + " SELECT metric, round(avg(value), 6) AS value FROM fm GROUP BY metric",
)(s9_json)


def s10(spark, d):
    from gradeflow.plans.q_attention import keyword_attention_query

    path = IO.scratch_path(spark, "attention")
    IO.write_attention(keyword_attention_query(spark, d), path)
    return spark.read.parquet(path)


def _k7_sql():
    from gradeflow.plans.q_attention import K7_SQL

    return K7_SQL


register("S10_write_attention", _k7_sql())(s10)
