"""Set statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.text import num_words, ws_tokens


def set_stats(df: DataFrame, set_col="essay_set", score_col="domain1_score") -> DataFrame:
    """G1: per set the essays, the attributes left after dropping columns with
    a null in that set, and the score range (one partial aggregation)."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in df.columns]
    agg = df.groupBy(set_col).agg(
        F.count(F.lit(1)).alias("n_essays"),
        F.min(score_col).alias("min_score"),
        F.max(score_col).alias("max_score"),
        *nulls,
    )
    attrs = reduce(lambda a, b: a + b, [F.when(F.col(f"_n_{c}") == 0, 1).otherwise(0) for c in df.columns])
    return agg.select(
        set_col, F.col("n_essays").cast("long"), attrs.cast("long").alias("n_attributes"), "min_score", "max_score"
    )


def score_histogram(df: DataFrame, score_col="domain1_score") -> DataFrame:
    """Value counts of the score, most frequent first (nulls skipped)."""
    return (
        df.filter(F.col(score_col).isNotNull())
        .groupBy(score_col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(score_col))
    )


def mean_words(df: DataFrame, set_col="essay_set", text_col="essay") -> DataFrame:
    """G3."""
    return df.groupBy(set_col).agg(F.avg(num_words(text_col)).alias("mean_words"))


def max_words(df: DataFrame, set_col="essay_set", text_col="essay") -> DataFrame:
    """The pad length per set."""
    return df.groupBy(set_col).agg(F.max(num_words(text_col)).alias("max_words"))


def max_phrase_words(phrases: DataFrame, col="phrase") -> DataFrame:
    """The keyword pad length."""
    return phrases.agg(F.max(F.size(ws_tokens(col))).cast("long").alias("max_phrase_words"))


def count_classes(df: DataFrame, label_col="domain1_score", regression=False, num_classes=None) -> DataFrame:
    """Distinct labels; 1 for regression; an explicit number wins."""
    if num_classes is not None:
        return df.sparkSession.range(1).select(F.lit(num_classes).cast("long").alias("n_classes"))
    if regression:
        return df.sparkSession.range(1).select(F.lit(1).cast("long").alias("n_classes"))
    return df.agg(F.count_distinct(label_col).cast("long").alias("n_classes"))
