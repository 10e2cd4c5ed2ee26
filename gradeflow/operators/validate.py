"""Input validation before a fit (quirk Q17): null labels and all-zero
feature rows are the two known causes of a NaN loss.  One aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_inputs(df: DataFrame, label_col: str, feature_cols: list[str]) -> DataFrame:
    """(n_rows, n_null_labels, n_all_zero_rows); a row is all-zero when every
    feature is 0 or null."""
    zero = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0 for c in feature_cols])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label_col).isNull()).alias("n_null_labels"),
        F.count_if(zero).alias("n_all_zero_rows"),
    )
