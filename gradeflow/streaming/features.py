"""Row-local operators on a stream.

The reference is batch only; its row-local work (cleaning, the
regex/array features, V1 tokens) is made of Column expressions, so the same
functions apply unchanged to a Structured Streaming DataFrame.  Essays
arriving as files are featurised incrementally with exactly-once output
(checkpointed file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.operators.features import row_features
from gradeflow.operators.vocab import tokenize

STREAM_COLUMNS = [
    "num_words", "num_sentences", "num_lemmas", "num_commas", "num_exclamation_marks",
    "num_question_marks", "average_word_length", "average_sentence_length", "num_stopwords",
    "automated_readability_index", "coleman_liau_index", "flesch_kincaid_grade", "gunning_fog",
    "linsear_write_formula", "smog_index", "syllables_count",
]


def read_essay_stream(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def stream_row_features(stream: DataFrame, id_col: str = "essay_id", text_col: str = "essay") -> DataFrame:
    """Row-local features and V1 tokens of each arriving essay (no state)."""
    feats = tokenize(row_features(stream, text_col), text_col, "tokens")
    return feats.select(id_col, *STREAM_COLUMNS, "tokens")


def run_to_parquet(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Start the file sink; ``available_now`` processes what is there and stops."""
    w = stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def documents_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents table read as a file stream, renamed to essays."""
    s = read_essay_stream(spark, sf_dir, documents_schema(), glob="documents.parquet")
    return s.select(F.col("doc_id").alias("essay_id"), F.col("text").alias("essay"))
