"""Categorical preparation and row assembly.

Category dictionaries are fitted on all splits together (the reference's
choice).  The distinct values of a column come back to the driver only to
name output columns (one column per category is the operator's output, so
the category count is bounded by the schema the user asked for).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.plans.joins import lookup_join
from gradeflow.plans.rank import global_rank


def category_na(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to string with null as the category 'nan'."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols})


def _sorted_categories(df: DataFrame, col: str) -> list[str]:
    return [r[0] for r in df.select(F.col(col).cast("string")).distinct().orderBy(1).collect()]


def one_hot_sparse(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """N6 for columns with very many categories: ``col_onehot`` holds (index,
    size) in place of ``size`` columns; nothing comes to the driver but the
    number of categories."""
    src = fit_on if fit_on is not None else df
    out = label_encode(df, cols, src)
    for c in cols:
        size = src.select(F.col(c).cast("string")).distinct().count()
        out = out.withColumn(f"{c}_onehot", F.struct(F.col(f"{c}_label").alias("index"), F.lit(size).cast("long").alias("size")))
        out = out.drop(c, f"{c}_label")
    return out


def one_hot(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Sorted categories, one 0/1 column ``col_value`` each; the input
    columns are replaced.  The names of the columns are the output's schema;
    ``one_hot_sparse`` is the form for more categories than columns should be."""
    src = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        cats = _sorted_categories(src, c)
        out = out.withColumns(
            {f"{c}_{v}": F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0) for v in cats}
        ).drop(c)
    return out


def label_encode(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Index 0.. by sorted value; the dictionary is a distributed rank of
    the distinct values, joined back behind a size check."""
    src = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        values = src.select(F.col(c).cast("string").alias("_val")).distinct()
        codes = global_rank(values, [F.col("_val")], name="_code").select("_val", (F.col("_code") - 1).alias(f"{c}_label"))
        out = lookup_join(out.withColumn("_val", F.col(c).cast("string")), codes, ["_val"], "left").drop("_val")
    return out


def _binary_name(col: str, value: str) -> str:
    return col + "_" + value.lower().replace(", ", "_").replace(" ", "_")


def binary_encode(df: DataFrame, cols: list[str], id_col: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Classes in first-seen order (lowest id); one class -> one zero
    column; two -> ``col_binary`` (1 = the class seen second); more -> one
    column per class named lower-case with blanks as '_'."""
    src = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        firsts = (
            src.groupBy(F.col(c).cast("string").alias("v"))
            .agg(F.min(id_col).alias("first"))
            .orderBy("first")
            .collect()
        )
        classes = [r["v"] for r in firsts]
        val = F.col(c).cast("string")
        if len(classes) == 1:
            out = out.withColumn(f"{c}_binary", F.lit(0))
        elif len(classes) == 2:
            out = out.withColumn(f"{c}_binary", F.when(val == F.lit(classes[1]), 1).otherwise(0))
        else:
            out = out.withColumns({_binary_name(c, v): F.when(val == F.lit(v), 1).otherwise(0) for v in classes})
        out = out.drop(c)
    return out


def encode(df, cols, method, id_col=None, fit_on=None):
    """Dispatch of the loader's ``categorical_encode_type``."""
    if method in (None, "none"):
        return df
    if method == "ohe":
        return one_hot(df, cols, fit_on)
    if method == "label":
        return label_encode(df, cols, fit_on)
    if method == "binary":
        return binary_encode(df, cols, id_col, fit_on)
    raise ValueError(f"unknown categorical encoding {method}")


def fit_on_all_splits(splits: dict[str, DataFrame | None], cols, method="ohe", id_col=None) -> DataFrame:
    """Union the splits (val may be absent) with a ``split`` column,
    encode with a dictionary fitted on all of them, keep the split column to
    cut them apart again (keyed, not positional)."""
    parts = [d.withColumn("split", F.lit(name)) for name, d in splits.items() if d is not None]
    allx = reduce(lambda a, b: a.unionByName(b), parts)
    return encode(allx, cols, method, id_col=id_col)


def combine_text_only(df: DataFrame, text_vec: str = "mean_vec", out: str = "combined") -> DataFrame:
    """N14 (text only): m = x."""
    return df.withColumn(out, F.col(text_vec).cast("array<double>"))


def combine_concat(
    df: DataFrame, text_vec: str, cat_cols: list[str], num_cols: list[str], out="combined", keyword_vec: str | None = None
):
    """N14 (concat): m = x ++ cat ++ num, and ++ keyword where ``keyword_vec`` is
    given (a row without keyword vectors has an empty block)."""
    parts = [F.col(text_vec).cast("array<double>")]
    if cat_cols:
        parts.append(F.array(*[F.col(c).cast("double") for c in cat_cols]))
    if num_cols:
        parts.append(F.array(*[F.col(c).cast("double") for c in num_cols]))
    if keyword_vec:
        parts.append(F.coalesce(F.col(keyword_vec), F.array()).cast("array<double>"))
    return df.withColumn(out, F.concat(*parts))


def assemble_row(
    df: DataFrame,
    label_col: str,
    cat_cols: list[str],
    num_cols: list[str],
    token_col: str | None = None,
    mask_col: str | None = None,
    text_col: str | None = None,
    extra: list[str] | None = None,
    key_token_col: str | None = None,
    key_mask_col: str | None = None,
) -> DataFrame:
    """The model-ready row; missing categorical/numeric parts become
    empty arrays.  The keyword columns hold one padded sequence per phrase."""
    cat = F.array(*[F.col(c).cast("double") for c in cat_cols]) if cat_cols else F.array().cast("array<double>")
    num = F.array(*[F.col(c).cast("double") for c in num_cols]) if num_cols else F.array().cast("array<double>")
    cols = [F.col(label_col).alias("labels"), cat.alias("cat_feats"), num.alias("numerical_feats")]
    if token_col:
        cols.append(F.col(token_col).alias("input_ids"))
    if mask_col:
        cols.append(F.col(mask_col).alias("attention_mask"))
    if key_token_col:
        cols.append(F.col(key_token_col).alias("key_input_ids"))
    if key_mask_col:
        cols.append(F.col(key_mask_col).alias("key_attention_mask"))
    if text_col:
        cols.append(F.col(text_col).alias("text"))
    return df.select(*(extra or []), *cols)
