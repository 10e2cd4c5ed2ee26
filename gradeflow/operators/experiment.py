"""Experiment composition (X2, X3).  Preparation runs once for all folds on a
table keyed by (fold, split).  X2 fits the models of all sets and folds
together; X3, whose heads are Spark ML models, fits fold after fold."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.operators import categorical as CT
from gradeflow.operators import metrics as M
from gradeflow.operators import models as MD
from gradeflow.operators import numeric as NU
from gradeflow.operators import shared_fit as SF
from gradeflow.operators import splits as D
from gradeflow.operators.attention import KeywordBlock
from gradeflow.operators.features import FEATURE_COLUMNS
from gradeflow.plans.joins import lookup_join
from gradeflow.plans.rank import global_rank
from gradeflow.sources import io as IO

REPORT = {"acc": "eval_acc", "f1": "eval_f1", "acc_and_f1": "eval_acc_and_f1", "mcc": "eval_mcc", "qwk": "eval_QWK"}


def _long(report: DataFrame, by: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(k).alias("value")) for k, v in REPORT.items()])
    return report.select(*by, F.explode(pairs).alias("x")).select(*by, "x.metric", "x.value")


@dataclass
class Prepared:
    """Fitted preparation of every fold: medians by (fold, split, column) and
    the train split's quantile references by (fold, column)."""

    medians: dict
    references: dict


def _key(*parts):
    return F.concat_ws("\x1f", *[F.col(p) if isinstance(p, str) else p for p in parts])


def prepare(rows: DataFrame, num_cols: list[str], transform: str = "quantile_normal") -> Prepared:
    """Fit N1 and N4 for all folds in two ranked passes.  ``rows`` has
    ``fold``, ``split`` and the columns; medians are those of the same split,
    references those of the imputed train split.  What comes to the driver is
    a median per fold, split and column and at most 1000 references per fold
    and column, these as one array."""
    cells = rows.select(_key("fold", "split").alias("_fs"), "fold", "split", F.explode(F.array(
        *[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in num_cols])).alias("_s"))
    cells = cells.select(_key("_fs", "_s._c").alias("_k"), _key("fold", "_s._c").alias("_f"), "split", "_s._x").checkpoint()
    found = NU.percentile_arrays(cells.filter(F.col("_x").isNotNull()), "_x", "_k", [0.5])
    medians = {k: float(value[0]) for k, (_, value) in found.items()}
    if transform != "quantile_normal":
        return Prepared(medians, {})
    filler = rows.sparkSession.createDataFrame(list(medians.items()), "_k string, _median double")
    train = lookup_join(cells.filter(F.col("split") == "train"), filler, ["_k"], "left")
    train = train.withColumn("_x", F.coalesce("_x", "_median")).filter(F.col("_x").isNotNull())
    found = NU.percentile_arrays(train, "_x", "_f", grid=1000)
    probs = {q: np.array(NU.quantile_probs(q, 1000)) for q in {min(n, 1000) for n, _ in found.values()}}
    fitted = {k: (probs[min(n, 1000)], value) for k, (n, value) in found.items()}
    return Prepared(medians, fitted)


def apply_prepared(rows: DataFrame, fold: str, splits: list[str], num_cols: list[str], fitted: Prepared) -> DataFrame:
    """Impute and transform the rows of one fold; a column without any value
    in its split becomes 0."""
    out = {}
    for c in num_cols:
        fill = F.lit(None).cast("double")
        for s in splits:
            fill = F.when(F.col("split") == s, F.lit(fitted.medians.get("\x1f".join((fold, s, c))))).otherwise(fill)
        x = F.coalesce(F.col(c).cast("double"), fill)
        reference = fitted.references.get("\x1f".join((fold, c)))
        out[c] = F.coalesce(NU.quantile_normal_expr(x, *reference) if reference else x, F.lit(0.0))
    return rows.withColumns(out)


def prepared_arrays(rows: DataFrame, num_cols: list[str], fitted: Prepared) -> DataFrame:
    """``rows`` with ``narrow``, the imputed and transformed columns of each
    row's fold and split (0 where a split has no value at all).  The fitted
    numbers are a median per fold, split and column and at most 1000 references
    per fold and column."""
    shared = rows.sparkSession.sparkContext.broadcast((fitted.medians, fitted.references))

    @F.arrow_udf("array<double>")
    def fill(fold: pa.Array, split: pa.Array, cells: pa.Array) -> pa.Array:
        medians, references = shared.value
        x = cells.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(fold), -1).copy()
        names = np.array([f"{f}\x1f{s}" for f, s in zip(fold.to_pylist(), split.to_pylist())], dtype=object)
        for name in set(names.tolist()):
            mine = np.flatnonzero(names == name)
            for i, c in enumerate(num_cols):
                v = x[mine, i]
                v[np.isnan(v)] = medians.get(f"{name}\x1f{c}", np.nan)
                reference = references.get(f"{name.rsplit(chr(31), 1)[0]}\x1f{c}")
                some = ~np.isnan(v)
                if reference and some.any():
                    v[some] = NU.np_quantile_normal(v[some], *reference)
                x[mine, i] = np.where(some, v, 0.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype="int32")), pa.array(x.ravel()))

    cells = F.array(*[F.col(c).cast("double") for c in num_cols])
    return rows.withColumn("narrow", fill(F.col("fold"), F.col("split"), cells))


def train_weights(rows: DataFrame, share: float, multiple: int | None, seed: int, id_col: str) -> DataFrame:
    """``rows`` (fold, split, label, id) with ``weight``, how often a row counts
    in its fold's fit: 0 if it is held out or dropped to keep ``share`` of the
    train rows (D5), 2 if it is repeated to reach a ``multiple`` (D6, table form).
    All folds are ranked in one pass."""
    train = rows.filter(F.col("split") == "train")
    kept = train
    if share < 1.0:
        counts: dict = {}
        for r in train.groupBy("fold", "label").count().collect():  # a row per fold and class
            counts.setdefault(r["fold"], {})[r["label"]] = r["count"]
        quota = {_cell(f, c): n for f, held in counts.items() for c, n in D.drop_quotas(held, 1.0 - share).items()}
        named = train.withColumn("_cell", _key("fold", F.col("label").cast("string")))
        ranked = D._rank_in_class(named, "_cell", id_col, seed)
        table = rows.sparkSession.createDataFrame(list(quota.items()), "_cell string, _quota long")
        kept = lookup_join(ranked, table, ["_cell"]).filter(F.col("_pos") > F.col("_quota"))
    kept = kept.select("fold", id_col)
    if multiple:
        ranked = global_rank(kept, [F.col("fold"), F.col(id_col)], name="_r")
        sizes = ranked.groupBy("fold").agg(F.min("_r").alias("_start"), F.count(F.lit(1)).alias("_n"))
        missing = F.pmod(F.lit(multiple) - F.pmod("_n", F.lit(multiple)), F.lit(multiple))
        copies = F.when(F.col("_r") - F.col("_start") < missing, 2.0).otherwise(1.0)
        kept = lookup_join(ranked, sizes, ["fold"]).select("fold", id_col, copies.alias("weight"))
    else:
        kept = kept.withColumn("weight", F.lit(1.0))
    return rows.join(kept, ["fold", id_col], "left").fillna(0.0, subset=["weight"])


def _cell(fold, label):
    return f"{fold}\x1f{label}"


def run_folds(
    features: DataFrame,
    k: int = 5,
    label_col: str = "domain1_score",
    id_col: str = "essay_id",
    set_col: str = "essay_set",
    keyword_features: DataFrame | KeywordBlock | None = None,
    train_share: float = 1.0,
    multiple: int | None = None,
    seed: int = 42,
    max_passes: int = 50,
) -> DataFrame:
    """For each essay set and fold (D2 rotation) impute (N1), downsample
    the train split to ``train_share`` (D5) and pad it to a ``multiple`` (D6)
    if asked, normalise numeric features by quantiles fitted on train (N4),
    fit, and score the dev and the test split.  The linear heads of all sets and
    folds are fitted together (``shared_fit``).  Returns (essay_set, fold, split,
    metric, value), with the fold of the best test QWK (E15) of each set as
    metric ``best_fold``.  Labels are whole numbers from 0.  The vectors of a
    ``KeywordBlock`` are worked out where the blocks of the fit are packed and are
    stored nowhere else."""
    num_cols = list(FEATURE_COLUMNS)
    data = features.select(id_col, F.col(set_col).alias("name"), F.col(label_col).cast("int").alias("label"), *num_cols).filter(
        F.col(set_col).isNotNull() & F.col("label").isNotNull())
    wide = data.select(id_col).withColumn("wide", F.array().cast("array<double>"))
    if isinstance(keyword_features, KeywordBlock):
        data = data.join(keyword_features.ids, id_col, "left_semi").checkpoint()  # read for the roles, the rows and the blocks
    elif keyword_features is not None:
        # the keyword block stays one array (2 * dim * phrases of the set), stored once an essay
        wide = data.select(id_col).join(keyword_features.select(id_col, F.col("keyword_features").alias("wide")), id_col)
        data = data.join(wide.select(id_col), id_col, "left_semi")
    roles = D.rotate_folds(data.select(id_col), k, id_col).withColumnRenamed("fold", "_fold")
    rows = data.join(roles, id_col).withColumn("fold", F.concat_ws("/", "name", F.concat(F.lit("fold_"), F.col("_fold"))))
    rows = rows.drop("_fold").checkpoint()  # prepared once for all sets and folds
    schema = "essay_set string, fold string, split string, metric string, value double"
    top = rows.agg(F.max("label").alias("m")).first()["m"]
    if top is None:
        return rows.sparkSession.createDataFrame([], schema)
    ready = train_weights(prepared_arrays(rows, num_cols, prepare(rows, num_cols)), train_share, multiple, seed, id_col)
    per_fold = F.struct("fold", "split", "weight", "narrow")
    essays = ready.groupBy(id_col, "name", "label").agg(F.collect_list(per_fold).alias("folds"))
    if isinstance(keyword_features, KeywordBlock):
        essays = keyword_features.beside(essays.join(data.select(id_col), id_col)).withColumnRenamed("keyword_features", "wide")
    else:
        essays = essays.join(wide, id_col)
    blocks = SF.build_blocks(essays, len(num_cols))
    fit = SF.fit_all(blocks, len(num_cols), top + 1, max_passes)
    pred = SF.predict_held_out(blocks, len(num_cols), fit).withColumnRenamed("name", "essay_set")
    by = ["essay_set", "fold", "split"]
    out = _long(M.benchmark_report(pred, "label", "pred", by), by).withColumn("fold", F.element_at(F.split("fold", "/"), -1)).checkpoint()
    place = Window.partitionBy("essay_set").orderBy(F.col("value").desc_nulls_last(), F.col("fold").desc())
    best = out.filter((F.col("split") == "test") & (F.col("metric") == "eval_QWK")).withColumn("_r", F.row_number().over(place))
    best = best.filter(F.col("_r") == 1).withColumn("metric", F.lit("best_fold")).drop("_r")
    return out.unionByName(best)


@dataclass
class RunConfig:
    """X3 configuration (the reference's JSON/argparse options that shape
    table work)."""

    mode: str = "kfold"  # or "folder"
    task: str = "classification"  # or "regression"
    k: int = 5
    holdout_ratio: float = 0.2
    numerical_transformer: str = "quantile_normal"
    categorical_encode_type: str = "ohe"
    cat_cols: list[str] = field(default_factory=list)
    num_cols: list[str] = field(default_factory=list)
    label_col: str = "label"
    id_col: str = "essay_id"
    head: str = "linear"
    seed: int = 42
    output_dir: str | None = None  # when set: predictions (S8), metrics (S9), summary JSON


def _runs(cfg: RunConfig, data: DataFrame | None, splits: dict | None) -> DataFrame:
    """All rows of all runs with ``fold`` and ``split``: folder mode has one
    run, k-fold mode the same held-out validation rows in every fold (D4)."""
    if cfg.mode == "folder":
        parts = [df.withColumn("split", F.lit(s)) for s, df in splits.items() if df is not None]
        return reduce(lambda a, b: a.unionByName(b), parts).withColumn("fold", F.lit("folder"))
    assigned = D.holdout_then_kfold(data, cfg.holdout_ratio, cfg.k, cfg.seed, cfg.id_col)
    rows = assigned.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(cfg.k - 1))))
    split = F.when(F.col("role") == "val", "val").when(F.col("fold") == F.col("_f"), "test").otherwise("train")
    return rows.withColumn("split", split).withColumn("fold", F.concat(F.lit("fold_"), F.col("_f"))).drop("role", "_f")


def run_config(cfg: RunConfig, data: DataFrame | None = None, splits: dict | None = None) -> DataFrame:
    """Encode categories on all splits, impute (N1) and transform numeric
    columns fitted on train, fit per fold, score the validation and the test
    split; returns (fold, split, metric, value) and the E14 aggregate rows
    (fold = 'mean' / 'stdev').  With ``output_dir``, predictions and metrics
    of each fold and split are written."""
    runs = _runs(cfg, data, splits)
    plain = set(runs.columns)
    rows = CT.encode(runs, cfg.cat_cols, cfg.categorical_encode_type, cfg.id_col).checkpoint()
    codes = [c for c in rows.columns if c not in plain]
    feats = codes + cfg.num_cols
    fitted = prepare(rows, cfg.num_cols, cfg.numerical_transformer)
    held = ["val", "test"]
    scored = []
    for name in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        part = apply_prepared(rows.filter(F.col("fold") == name), name, ["train", *held], cfg.num_cols, fitted)
        if cfg.numerical_transformer != "quantile_normal":
            power = NU.fit_numeric(part.filter(F.col("split") == "train"), cfg.num_cols, cfg.numerical_transformer)
            part = NU.apply_numeric(part, power)
        part = part.fillna(0.0, subset=feats)
        train, rest = part.filter(F.col("split") == "train"), part.filter(F.col("split").isin(held))
        if cfg.task == "regression":
            model = MD.train_score_regressor(train, feats, cfg.label_col)
            scored.append(model.transform(rest).select(
                "fold", "split", cfg.id_col, F.col("prediction").alias("pred"), F.col(cfg.label_col).alias("label")))
        else:
            model = MD.train_score_classifier(train, feats, cfg.label_col, head=cfg.head, seed=cfg.seed)
            scored.append(MD.predict(model, rest, ["fold", "split", cfg.id_col, F.col(cfg.label_col).cast("int").alias("label")]).drop("probability"))
    pred = reduce(DataFrame.unionByName, scored).checkpoint()
    by = ["fold", "split"]
    if cfg.task == "regression":
        rep = M.regression_metrics(pred, by=by)
        pairs = F.array(*[F.struct(F.lit(f"eval_{c}").alias("metric"), F.col(c).alias("value")) for c in rep.columns if c not in by])
        out = rep.select(*by, F.explode(pairs).alias("x")).select(*by, "x.metric", "x.value")
    else:
        out = _long(M.benchmark_report(pred, "label", "pred", by), by)
    out = out.checkpoint()
    agg = out.groupBy("split", "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"))
    summary = reduce(DataFrame.unionByName, [
        agg.select(F.lit(n).alias("fold"), "split", "metric", F.col(n).alias("value")) for n in ("mean", "stdev")])
    if cfg.output_dir:
        for r in out.select(*by).distinct().collect():  # one folder per fold and split
            mine = (F.col("fold") == r["fold"]) & (F.col("split") == r["split"])
            place = f"{cfg.output_dir}/{r['fold']}/{r['split']}"
            IO.write_predictions(pred.filter(mine), f"{place}/predictions", cfg.task, cfg.id_col, "pred", "label", few_files=True)
            IO.write_metrics(out.filter(mine).select("metric", "value"), f"{place}/metrics")
        named = summary.select(F.concat_ws("_", "fold", "split", "metric").alias("metric"), "value")
        IO.write_metrics(named, f"{cfg.output_dir}/summary", as_json=True)
    return out.unionByName(summary)
