"""Projection, filter and cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import text as T


def filter_set(df: DataFrame, n, col: str = "essay_set") -> DataFrame:
    """Rows of one essay set (a pushed-down Parquet filter)."""
    return df.filter(F.col(col) == F.lit(n))


def filter_score(df: DataFrame, s, col: str = "domain1_score") -> DataFrame:
    """Rows with one label value."""
    return df.filter(F.col(col) == F.lit(s))


def null_counts(df: DataFrame) -> DataFrame:
    """One aggregation: per column the number of nulls (long form)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = F.stack(F.lit(len(df.columns)), *[x for c in df.columns for x in (F.lit(c), F.col(c).cast("long"))])
    return row.select(stacked.alias("column_name", "n_null"))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column that holds at least one null.  One aggregation
    job returns one small row of counts; the projection stays lazy."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] == 0])


def clean_text(df: DataFrame, col: str = "essay") -> DataFrame:
    """P5 (opt-in): collapse blanks, drop characters outside the kept set."""
    return df.withColumn(col, T.clean_text(col))


def normalize_quotes(df: DataFrame, col: str = "essay", keep_ellipsis: bool = False) -> DataFrame:
    """P6."""
    return df.withColumn(col, T.normalize_quotes(col, keep_ellipsis))


def combine_text_columns(
    df: DataFrame,
    cols: list[str],
    sep: str = "[SEP]",
    empty_values: tuple[str, ...] = ("nan", "None"),
    replace: str | None = None,
    out: str = "text",
) -> DataFrame:
    """Cast to string (null reads 'nan'), drop or replace empty markers,
    join with ``' ' + sep + ' '``."""
    vals = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])
    empties = F.array(*[F.lit(v) for v in empty_values])
    if replace is None:
        kept = F.filter(vals, lambda x: ~F.array_contains(empties, x))
    else:
        kept = F.transform(vals, lambda x: F.when(F.array_contains(empties, x), F.lit(replace)).otherwise(x))
    return df.withColumn(out, F.array_join(kept, f" {sep} "))


def add_constants(df: DataFrame, lemmatized_from: str | None = "essay") -> DataFrame:
    """``temp_cat = 1``; ``lemmatized`` = the essay (or a blank)."""
    lem = F.col(lemmatized_from) if lemmatized_from else F.lit(" ")
    return df.withColumns({"temp_cat": F.lit(1), "lemmatized": lem})


def debug_limit(df: DataFrame, n: int = 500, id_col: str = "essay_id") -> DataFrame:
    """The first n rows by id (TakeOrderedAndProject: n per task)."""
    return df.orderBy(id_col).limit(n)


def map_label_names(df: DataFrame, label_list: list[str], col: str = "label", out: str = "label_name") -> DataFrame:
    """P10: class index -> name."""
    names = F.array(*[F.lit(str(x)) for x in label_list])
    return df.withColumn(out, F.try_element_at(names, F.col(col).cast("int") + 1))


def hash_order(id_col: str, seed) -> list:
    """Pinned random order: md5(id || ':' || seed), then id."""
    return [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), F.col(id_col)]


def sample_row(df: DataFrame, seed=42, id_col: str = "essay_id") -> DataFrame:
    """One pseudo-random row."""
    return df.orderBy(*hash_order(id_col, seed)).limit(1)
