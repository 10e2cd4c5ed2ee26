"""Numeric preparation: median imputation, power transforms, quantile-normal
transform, batch normalisation (N1-N4, N12).

Exact order statistics (medians, percentiles) come from a few histogram passes
over the bits of the values; for very many groups from the distributed global
rank, where only the rows at the wanted positions are picked by an equi-join.
Spark's exact ``percentile`` keeps a value->count map per group, unbounded for a
continuous column at scale.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.plans.joins import lookup_join
from gradeflow.plans.radix import radix_positions
from gradeflow.plans.rank import global_running_sum

# ---------------------------------------------------------------- order statistics


def exact_percentiles(
    df: DataFrame, col: str, probs: list[float] | None = None, by: str | None = None, grid: int | None = None
) -> DataFrame:
    """Exact linear-interpolated percentiles (SQL ``percentile_cont``) of the
    non-null values of ``col``, per group ``by`` (optional).  Either fixed
    ``probs``, or ``grid``: per group the probabilities i/(q-1), q =
    min(grid, n) (the quantile transform's references).

    Returns ``(by?, p_idx, value, n)``: one row per group and probability.

    A few histogram passes over the bits of the values find them where they are
    (``plans/radix.py``).  With more groups and probabilities than the driver
    should hold the values are ranked instead.
    """
    found = _counted_percentiles(df, col, probs, by, grid)
    if found is None:
        return ranked_percentiles(df, col, probs, by, grid)
    rows = [(group, i, float(v), n) for group, (n, values) in found.items() for i, v in enumerate(values)]
    out = df.sparkSession.createDataFrame(rows, "g string, p_idx int, value double, n long")
    keys = [F.col("g").cast(df.schema[by].dataType).alias(by)] if by else []
    return out.select(*keys, "p_idx", "value", "n")


def percentile_arrays(df: DataFrame, col: str, by: str, probs: list[float] | None = None, grid: int | None = None) -> dict:
    """``exact_percentiles`` for use on the driver: ``{group: (n, values)}``, the
    group as a string and its values as one array.  A group comes to the driver as one
    row, so that a thousand values cost it 8 KB and not a thousand rows."""
    found = _counted_percentiles(df, col, probs, by, grid)
    if found is not None:
        return found
    ranked = ranked_percentiles(df, col, probs, by, grid)
    lists = ranked.groupBy(F.col(by).cast("string").alias("g")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("p_idx", "value"))).alias("_v"))
    table = lists.select("g", "n", F.col("_v.value").alias("values")).toArrow()
    held = (x for chunk in table["values"].chunks for x in chunk)
    return {g: (n, v.values.to_numpy().copy()) for g, n, v in zip(table["g"].to_pylist(), table["n"].to_pylist(), held)}


def _counted_percentiles(df: DataFrame, col: str, probs: list[float] | None, by: str | None, grid: int | None) -> dict | None:
    """``{group: (n, values)}`` from histogram passes, or None where these would be too
    much for the driver."""
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    values = df.filter(F.col(col).isNotNull()).select(key.alias("g"), F.col(col).cast("double").alias("v")).persist()
    want = (lambda n: [i / max(1, min(grid, n) - 1) for i in range(min(grid, n))]) if grid is not None else (lambda n: probs)

    def places(n):
        at = np.asarray(want(n), dtype="float64") * (n - 1)
        return np.r_[np.floor(at), np.ceil(at)].astype("int64")

    found = radix_positions(values, places)
    values.unpersist()
    if found is None:
        return None
    out = {}
    for group, (n, at, held) in found.items():
        p = np.asarray(want(n), dtype="float64") * (n - 1)
        low, high = (held[np.searchsorted(at, f(p).astype("int64"))] for f in (np.floor, np.ceil))
        out[group[1:] if group else None] = (n, low + (p - np.floor(p)) * (high - low))
    return out


def ranked_percentiles(
    df: DataFrame, col: str, probs: list[float] | None = None, by: str | None = None, grid: int | None = None
) -> DataFrame:
    """``exact_percentiles`` by a global rank, for any number of groups.

    Values are counted first, so a value held by a third of all rows is one
    row; the distinct values (unique order keys, so range partitioning can
    split them evenly) get distributed running counts, i.e. each covers the
    positions ``[_cum - _c + 1, _cum]`` of the total order.  A wanted position
    finds its value by an equi-join on a position bucket.
    """
    keys = [by] if by else []
    nn = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    counts = nn.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    cum = global_running_sum(counts, [*(F.col(k) for k in keys), F.col("_v")], {"_cum": F.col("_cnt")})
    # read by the size checks, the bucket spans and the final join: written once
    cum = cum.withColumn("_first", F.col("_cum") - F.col("_cnt") + 1).checkpoint(eager=True)
    # per group: first global position and size (one row per group)
    sizes = cum.groupBy(*keys).agg(F.min("_first").alias("_start"), F.sum("_cnt").alias("_n"))
    # wanted positions per group: lower and upper neighbour of p*(n-1); each
    # group row expands into its probabilities with a generator (groups x
    # probabilities is small: probabilities are at most ~1000)
    if grid is not None:
        q = F.least(F.lit(grid).cast("long"), F.col("_n"))
        pairs = sizes.select(*keys, "_start", "_n", F.explode(F.sequence(F.lit(0).cast("long"), q - 1)).alias("p_idx"))
        q = F.least(F.lit(grid).cast("long"), F.col("_n"))
        pairs = pairs.withColumn(
            "p", F.when(q > 1, F.col("p_idx").cast("double") / (q - 1).cast("double")).otherwise(F.lit(0.0))
        )
    else:
        pairs = sizes.select(
            *keys, "_start", "_n",
            F.explode(F.arrays_zip(
                F.sequence(F.lit(0), F.lit(len(probs) - 1)).alias("i"),
                F.array(*[F.lit(float(p)) for p in probs]).alias("p"),
            )).alias("_ip"),
        ).select(*keys, "_start", "_n", F.col("_ip.i").alias("p_idx"), F.col("_ip.p").alias("p"))
    pairs = pairs.withColumn("_pos", F.col("p") * (F.col("_n") - 1))
    pairs = pairs.withColumns({
        "_lo": F.floor("_pos").cast("long") + F.col("_start"),
        "_hi": F.ceil("_pos").cast("long") + F.col("_start"),
        "_frac": F.col("_pos") - F.floor("_pos"),
    })
    need = pairs.select(F.col("_lo").alias("_r")).union(pairs.select(F.col("_hi").alias("_r"))).distinct()
    # bucket width: value rows expand into the buckets their range touches,
    # at most (#distinct values + 100k) rows in total
    total = cum.select(F.max("_cum_total")).first()[0] or 0
    width = max(1, -(-total // 100_000))
    spans = cum.select(
        "_v", "_first", "_cum",
        F.explode(F.sequence(F.floor((F.col("_first") - 1) / width), F.floor((F.col("_cum") - 1) / width))).alias("_b"),
    )
    need_b = need.withColumn("_b", F.floor((F.col("_r") - 1) / width))
    hit = lookup_join(spans, need_b, ["_b"], "inner")
    picked = hit.filter((F.col("_r") >= F.col("_first")) & (F.col("_r") <= F.col("_cum"))).select("_r", "_v")
    lo = picked.select(F.col("_r").alias("_lo"), F.col("_v").alias("_vlo"))
    hi = picked.select(F.col("_r").alias("_hi"), F.col("_v").alias("_vhi"))
    out = lookup_join(lookup_join(pairs, lo, ["_lo"]), hi, ["_hi"])
    value = F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))
    return out.select(*keys, F.col("p_idx").cast("int").alias("p_idx"), value.alias("value"), F.col("_n").alias("n"))


def medians(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """``_med_<column>`` of each column, a row per group (or one row), all
    columns in the same passes."""
    named = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)]))
    group = F.col(by).cast("string") if by else F.lit("")
    cells = df.filter(F.col(by).isNotNull() if by else F.lit(True)).select(group.alias("_g"), named.alias("_s"))
    found = exact_percentiles(cells.select(F.concat_ws(":", "_s.c", "_g").alias("_k"), F.col("_s.x").alias("_x")), "_x", [0.5], by="_k")
    parts = found.select(F.split("_k", ":", 2).alias("_p"), "value").select(F.col("_p")[0].alias("_c"), F.col("_p")[1].alias("_g"), "value")
    wide = parts.groupBy("_g").agg(*[F.max(F.when(F.col("_c") == str(i), F.col("value"))).alias(f"_med_{c}") for i, c in enumerate(cols)])
    return wide.withColumn(by, F.col("_g").cast(df.schema[by].dataType)).drop("_g") if by else wide.drop("_g")


def impute_median(df: DataFrame, cols: list[str], by: str | None = "split") -> DataFrame:
    """Cast to double; null -> exact median of the same split (each split
    its own, as the reference does)."""
    med = medians(df, cols, by)
    if by:
        out = lookup_join(df, med, [by], "left")
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in cols}
    else:
        got = med.first()
        out = df
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(got[f"_med_{c}"] if got else None).cast("double")) for c in cols}
    return out.withColumns(filled).select(*df.columns)


# ---------------------------------------------------------------- power transforms

LAMBDA_GRID = [x / 4 for x in range(-8, 9)]  # -2, -1.75, ..., 2


def yeo_johnson_expr(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def box_cox_expr(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam


def fit_power(df: DataFrame, col: str, method: str = "yeo-johnson", grid=LAMBDA_GRID) -> dict:
    """Lambda by the log-likelihood on a grid (one aggregation for the whole
    grid), ties -> the smallest; then the mean and population deviation of
    the transformed values (a second aggregation).  Returns driver scalars."""
    x = F.col(col).cast("double")
    nn = df.filter(x.isNotNull()).select(x.alias("x"))
    if method == "box-cox":
        bad = nn.filter(F.col("x") <= 0).limit(1).count()
        if bad:
            raise ValueError("box-cox needs strictly positive values")
        tr, jac = box_cox_expr, F.log(F.col("x"))
    else:
        tr, jac = yeo_johnson_expr, F.signum(F.col("x")) * F.log1p(F.abs(F.col("x")))
    aggs = [F.var_pop(tr(F.col("x"), lam)).alias(f"v{i}") for i, lam in enumerate(grid)]
    row = nn.agg(F.count(F.lit(1)).alias("n"), F.sum(jac).alias("j"), *aggs).first()
    n, j = row["n"], row["j"]
    best, best_ll = None, -math.inf
    for i, lam in enumerate(grid):
        v = row[f"v{i}"]
        if v is None or v <= 0:
            continue
        ll = -n / 2 * math.log(v) + (lam - 1) * j
        if ll > best_ll:
            best, best_ll = lam, ll
    if best is None:
        best = 1.0
    stats = nn.agg(F.avg(tr(F.col("x"), best)).alias("m"), F.stddev_pop(tr(F.col("x"), best)).alias("s")).first()
    s = stats["s"] if stats["s"] else 1.0
    return {"lambda": best, "mean": stats["m"], "std": s, "method": method}


def apply_power(df: DataFrame, col: str, fit: dict, out: str | None = None) -> DataFrame:
    tr = box_cox_expr if fit["method"] == "box-cox" else yeo_johnson_expr
    y = (tr(F.col(col).cast("double"), fit["lambda"]) - F.lit(fit["mean"])) / F.lit(fit["std"])
    return df.withColumn(out or col, y)


def power_transform(df: DataFrame, cols: list[str], method="yeo-johnson", fit_on: DataFrame | None = None):
    """Fit on ``fit_on`` (the train split), transform ``df``."""
    src = fit_on if fit_on is not None else df
    out = df
    for c in cols:
        out = apply_power(out, c, fit_power(src, c, method))
    return out


# ---------------------------------------------------------------- quantile -> normal

# Acklam's rational approximation of the normal inverse CDF
# (public; relative error about 1.15e-9).
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
            -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
            -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
            4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
P_LOW = 0.02425
BOUND = 1e-7


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def probit(p: Column) -> Column:
    q_lo = F.sqrt(-2 * F.log(p))
    q_hi = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    low = _horner(ACKLAM_C, q_lo) / (_horner(ACKLAM_D, q_lo) * q_lo + 1)
    high = -_horner(ACKLAM_C, q_hi) / (_horner(ACKLAM_D, q_hi) * q_hi + 1)
    mid = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + 1)
    return F.when(p < P_LOW, low).when(p > 1 - P_LOW, high).otherwise(mid)


def quantile_probs(n_train: int, n_quantiles: int = 1000) -> list[float]:
    nq = min(n_quantiles, n_train)
    if nq <= 1:
        return [0.0]
    return [i / (nq - 1) for i in range(nq)]


def fit_quantiles(df: DataFrame, col: str, n_quantiles: int = 1000) -> tuple[list[float], list[float]]:
    """References: exact percentiles at i/(n_q-1), n_q = min(n_quantiles, n).
    At most n_quantiles numbers reach the driver (the fitted model)."""
    rows = exact_percentiles(df, col, grid=n_quantiles).collect()
    if not rows:
        return [], []
    refs = [v for _, v in sorted((r["p_idx"], r["value"]) for r in rows)]
    return quantile_probs(rows[0]["n"], n_quantiles), refs


def _np_horner(coefs, x):
    acc = np.full_like(x, coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def np_probit(p):
    """Acklam's approximation on a numpy array (same branches as ``probit``)."""
    out = np.empty_like(p)
    lo, hi = p < P_LOW, p > 1 - P_LOW
    mid = ~(lo | hi)
    q = np.sqrt(-2 * np.log(p[lo]))
    out[lo] = _np_horner(ACKLAM_C, q) / (_np_horner(ACKLAM_D, q) * q + 1)
    q = np.sqrt(-2 * np.log(1 - p[hi]))
    out[hi] = -_np_horner(ACKLAM_C, q) / (_np_horner(ACKLAM_D, q) * q + 1)
    q = p[mid] - 0.5
    r = q * q
    out[mid] = _np_horner(ACKLAM_A, r) * q / (_np_horner(ACKLAM_B, r) * r + 1)
    return out


def np_quantile_normal(x, probs, refs):
    """Empirical CDF (mid-plateau on ties, linear between references, 0/1
    within 1e-7 of the ends) then the normal inverse CDF, clipped."""
    R, Q = np.asarray(refs, dtype="float64"), np.asarray(probs, dtype="float64")
    m = len(R)
    lt = np.searchsorted(R, x, side="left")
    le = np.searchsorted(R, x, side="right")
    i_a = np.clip(lt - 1, 0, m - 1)
    i_b = np.clip(lt, 0, m - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = Q[i_a] + (x - R[i_a]) / (R[i_b] - R[i_a]) * (Q[i_b] - Q[i_a])
    eq = (Q[np.clip(lt, 0, m - 1)] + Q[np.clip(le - 1, 0, m - 1)]) / 2
    u = np.where(le > lt, eq, between)
    u = np.where(x + BOUND > R[-1], 1.0, u)
    u = np.where(x - BOUND < R[0], 0.0, u)
    eps = BOUND - 2.0**-52
    u = np.clip(u, eps, 1 - eps)
    with np.errstate(invalid="ignore"):
        return np_probit(np.nan_to_num(u, nan=0.5))


def quantile_normal_expr(x: Column, probs: list[float], refs: list[float]) -> Column:
    """The transform as an Arrow-batched pandas UDF: a binary search over the
    (at most 1000) fitted references per batch, vectorised in numpy.  Array
    scans in SQL higher-order functions would cost 2000 interpreted lambda
    calls per row."""
    probs_t, refs_t = np.asarray(probs, dtype="float64"), np.asarray(refs, dtype="float64")

    @F.pandas_udf("double")
    def _qn(s: pd.Series) -> pd.Series:
        v = s.to_numpy(dtype="float64", na_value=np.nan)
        out = np_quantile_normal(v, probs_t, refs_t)
        out[np.isnan(v)] = np.nan
        return pd.Series(out).where(~np.isnan(v), None)

    return _qn(x)


def fit_quantile_normal(src: DataFrame, cols: list[str], n_quantiles: int = 1000) -> dict:
    """References for several columns from one ranked pass: the columns are
    stacked in long form (column, value) and ranked once by (column, value)."""
    stacked = src.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_s")
    ).select("_s._c", "_s._x")
    # each column gets its own grid min(n_quantiles, n) inside the same pass
    rows = exact_percentiles(stacked, "_x", by="_c", grid=n_quantiles).collect()
    fitted = {}
    for c in cols:
        mine = sorted((r["p_idx"], r["value"], r["n"]) for r in rows if r["_c"] == c)
        if mine:  # an all-null column has no references and stays null
            fitted[c] = (quantile_probs(mine[0][2], n_quantiles), [v for _, v, _ in mine])
    return fitted


def quantile_normal(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, n_quantiles=1000, fitted=None):
    """Fit on ``fit_on`` (train), transform ``df``."""
    src = fit_on if fit_on is not None else df
    fitted = fitted if fitted is not None else fit_quantile_normal(src, cols, n_quantiles)
    out = df
    for c in cols:
        if c in fitted:
            probs, refs = fitted[c]
            out = out.withColumn(c, quantile_normal_expr(F.col(c).cast("double"), probs, refs))
    return out


def fit_numeric(src: DataFrame, cols: list[str], method: str = "quantile_normal"):
    """Fit the loader's ``numerical_transformer_method`` once (on train)."""
    if method in (None, "none"):
        return {"method": "none"}
    if method in ("yeo_johnson", "box_cox"):
        name = "yeo-johnson" if method == "yeo_johnson" else "box-cox"
        return {"method": method, "fits": {c: fit_power(src, c, name) for c in cols}}
    if method == "quantile_normal":
        return {"method": method, "fits": fit_quantile_normal(src, cols)}
    raise ValueError(f"unknown numerical transform {method}")


def apply_numeric(df: DataFrame, fitted: dict) -> DataFrame:
    if fitted["method"] == "none":
        return df
    out = df
    for c, fit in fitted["fits"].items():
        if fitted["method"] == "quantile_normal":
            out = out.withColumn(c, quantile_normal_expr(F.col(c).cast("double"), *fit))
        else:
            out = apply_power(out, c, fit)
    return out


def numeric_transform(df, cols, method="quantile_normal", fit_on=None):
    """Dispatch of the loader's ``numerical_transformer_method``."""
    return apply_numeric(df, fit_numeric(fit_on if fit_on is not None else df, cols, method))


# ---------------------------------------------------------------- batch norm


def batch_normalise(df: DataFrame, cols: list[str], eps: float = 1e-5) -> DataFrame:
    """(x - mean) / sqrt(var_pop + eps), statistics over the whole batch
    (one aggregation, two scalars per column)."""
    row = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(math.sqrt((row[f"v_{c}"] or 0.0) + eps)) for c in cols}
    )
