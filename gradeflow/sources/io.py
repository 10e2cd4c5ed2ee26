"""Sources and sinks.

Scratch output goes under the session's reliable checkpoint folder (shared
storage on a cluster), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.session import DICTIONARY_BYTES, ensure_checkpoint_dir
from gradeflow.sources.records import ENCODINGS, read_records

ESSAY_SCHEMA = T.StructType(
    [
        T.StructField("essay_id", T.LongType()),
        T.StructField("essay_set", T.StringType()),
        T.StructField("essay", T.StringType()),
        T.StructField("domain1_score", T.IntegerType()),
    ]
)

# CSV dialect shared by the readers and writers: '"' quotes and escapes
# (RFC 4180), multi-line fields, blanks kept as they are.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/gradeflow-io/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S1-S4
def read_essays(
    spark: SparkSession, path: str, sep: str = "\t", encoding: str = "ISO-8859-1", schema: T.StructType = ESSAY_SCHEMA
) -> DataFrame:
    """Delimited essays with a header and an explicit schema (no
    inference at scale); TSV Latin-1 by default, CSV UTF-8 on request.  Files are
    read by byte ranges though quoted fields may hold line breaks; in other
    encodings than ``records.ENCODINGS`` a file is one task."""
    if encoding.upper() in ENCODINGS:
        return read_records(spark, path, schema, sep, encoding)
    return spark.read.schema(schema).options(**_CSV).option("sep", sep).option("encoding", encoding).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", encoding: str = "ISO-8859-1") -> None:
    df.write.mode("overwrite").options(**_CSV).option("sep", sep).option("encoding", encoding).csv(path)


def _read_optional(spark, path, sep, encoding, schema):
    try:
        return read_essays(spark, path, sep, encoding, schema)
    except AnalysisException:
        return None


def read_split_folder(
    spark: SparkSession, folder: str, schema: T.StructType = ESSAY_SCHEMA, sep: str = ",", encoding: str = "UTF-8"
) -> dict[str, DataFrame | None]:
    """``train.csv`` and ``test.csv`` required, ``val.csv`` optional (None)."""
    out = {
        "train": read_essays(spark, f"{folder}/train.csv", sep, encoding, schema),
        "val": _read_optional(spark, f"{folder}/val.csv", sep, encoding, schema),
        "test": read_essays(spark, f"{folder}/test.csv", sep, encoding, schema),
    }
    return out


def union_splits(splits: dict[str, DataFrame | None]) -> DataFrame:
    parts = [d.withColumn("split", F.lit(k)) for k, d in splits.items() if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_fold_ids(spark: SparkSession, folder: str) -> DataFrame:
    """S3: ``fold_k/{dev,test}_ids.txt``, one id per line -> (fold, role, essay_id)."""
    lines = spark.read.text(f"{folder}/fold_*/*_ids.txt").withColumn("_f", F.input_file_name())
    pat = r"fold_(\d+)/(dev|test)_ids\.txt"
    return lines.filter(F.trim("value") != "").select(
        F.regexp_extract("_f", pat, 1).cast("int").alias("fold"),
        F.regexp_extract("_f", pat, 2).alias("role"),
        F.trim("value").cast("long").alias("essay_id"),
    )


def write_fold_ids(fold_ids: DataFrame, folder: str) -> None:
    """The id files' layout (one write per fold and role: k x 2 writes)."""
    keys = fold_ids.select("fold", "role").distinct().collect()  # k x 2 rows
    for r in keys:
        part = fold_ids.filter((F.col("fold") == r["fold"]) & (F.col("role") == r["role"]))
        part.select(F.col("essay_id").cast("string").alias("value")).write.mode("overwrite").text(
            f"{folder}/fold_{r['fold']}/{r['role']}_ids.txt"
        )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word f1 ... fd`` lines, split on one blank -> (word, vec)."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).filter(F.col("value") != "").select(
        F.element_at(parts, 1).alias("word"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("vec"),
    )


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- S6-S10
def write_features(df: DataFrame, path: str, fmt: str = "parquet", set_col: str = "essay_set") -> None:
    """The feature table partitioned by set (partition pruning on read)."""
    w = df.write.mode("overwrite").partitionBy(set_col)
    if fmt == "csv":
        w.options(**_CSV).csv(path)
    else:
        w.parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """The split tables keyed by (fold, split)."""
    splits.write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def prediction_lines(
    df: DataFrame, task: str, index_col: str, pred_col: str, label_col: str | None = None, keep: tuple = ()
):
    """S8 rows: classification ``index\\tlabel``; regression
    ``index\\tpred(%3.3f)\\tlabel``."""
    if task == "regression":
        line = F.format_string("%d\t%3.3f\t%d", F.col(index_col), F.col(pred_col), F.col(label_col).cast("long"))
    else:
        line = F.format_string("%d\t%s", F.col(index_col), F.col(pred_col).cast("string"))
    return df.select(line.alias("value"), *keep)


def write_predictions(df: DataFrame, path: str, task: str, index_col: str, pred_col: str, label_col=None, few_files: bool = False) -> None:
    """One text file set with a header line ``index\\tprediction``, which is the
    first file; the rows follow in the order of ``df``'s partitions, unsorted.  With
    ``few_files`` rows share files as far as their size allows, and the header is the
    first line of the first (of the only one, where there are few rows)."""
    if few_files:
        marked = df.sparkSession.createDataFrame([(None,)], "value string")  # so that there is a first file
        lines = marked.unionByName(prediction_lines(df, task, index_col, pred_col, label_col))

        def with_header(batches):
            if TaskContext.get().partitionId() == 0:
                yield pa.RecordBatch.from_pydict({"value": pa.array(["index\tprediction"])})
            for batch in batches:
                yield batch.filter(batch.column("value").is_valid())

        lines.hint("rebalance").mapInArrow(with_header, "value string").write.mode("overwrite").text(path)
        return
    header = df.sparkSession.createDataFrame([("index\tprediction",)], "value string").coalesce(1)
    header.union(prediction_lines(df, task, index_col, pred_col, label_col)).write.mode("overwrite").text(path)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """S9 rows from a long (metric, value) table: ``key = value``."""
    return metrics.select(F.format_string("%s = %.6f", F.col("metric"), F.col("value")).alias("value"))


def write_metrics(metrics: DataFrame, path: str, as_json: bool = False) -> None:
    """``key = value`` lines, or one JSON object per run."""
    if as_json:
        obj = metrics.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))).alias("value"))
        obj.write.mode("overwrite").text(path)
    else:
        metric_lines(metrics).write.mode("overwrite").text(path)


def write_attention(att: DataFrame, path: str) -> None:
    """The attention table (K7 / K9 long form) as Parquet.  Rounded numbers
    repeat, so a dictionary is kept for more of them than by default."""
    att.write.mode("overwrite").option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(path)
