"""All linear heads of a run of folds fitted on one shared scan.

A run has a model for each essay set and fold.  Instead of a fit after the
other, every pass over the data works out loss and gradient of all models at
once: an essay is stored once, with one block of numeric columns and one weight
for each fold, and its keyword vector meets the weights of all folds in one
product.  Tasks, one a core, send one sum per set; the sums are added in two steps,
so no task reads the sums of all others.  Each model has its own L-BFGS on the driver,
which holds models x classes x columns numbers.  A model asks for one evaluation
a pass, so the number of passes is the number of evaluations of the slowest
model, at most ``max_passes``.

The models are multinomial logistic regressions on columns that are standardised
with the mean and deviation of the fold's train rows; standardisation is folded
into the weights, so the data stay as they are.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "dev", "test")
BLOCK_BYTES = 8 << 20
MEMORY = 10

_BLOCK = "name string, n int, labels binary, wide binary, folds array<string>, weights binary, narrow binary, splits binary"
_BLOCK_ARROW = pa.schema([("name", pa.string()), ("n", pa.int32()), ("labels", pa.binary()), ("wide", pa.binary()), ("folds", pa.list_(pa.string())),
                          ("weights", pa.binary()), ("narrow", pa.binary()), ("splits", pa.binary())])
_SUMS = "name string, task int, sums binary"


def build_blocks(rows: DataFrame, n_narrow: int) -> DataFrame:
    """``rows`` (name, label, wide array<double>, folds array<struct<fold,
    split, weight, narrow array<double>>> with the same folds in every row of a
    name) as matrices of about ``BLOCK_BYTES``, checkpointed."""

    def pack(name, part):
        wide = np.array([r["wide"] for r in part], dtype="float64").reshape(len(part), -1)
        held = [sorted(r["folds"], key=lambda f: f["fold"]) for r in part]
        weights = np.array([[f["weight"] for f in h] for h in held], dtype="float64")
        narrow = np.array([[f["narrow"] for f in h] for h in held], dtype="float64").reshape(len(part), -1, n_narrow)
        splits = np.array([[SPLITS.index(f["split"]) for f in h] for h in held], dtype="int8")
        row = {"name": name, "n": len(part), "labels": np.array([r["label"] for r in part], dtype="int64").tobytes(), "wide": wide.tobytes(),
               "folds": [f["fold"] for f in held[0]], "weights": weights.tobytes(), "narrow": narrow.tobytes(), "splits": splits.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            wide = batch.column("wide")
            numbers, ends = wide.values.to_numpy(zero_copy_only=False), wide.offsets.to_numpy()
            for i, r in enumerate(batch.drop_columns(["wide"]).to_pylist()):
                r["wide"] = numbers[ends[i] : ends[i + 1]]
                part = held.setdefault(r["name"], [])
                part.append(r)
                if len(part) * 8 * (len(r["wide"]) + len(r["folds"]) * n_narrow) >= BLOCK_BYTES:
                    yield pack(r["name"], held.pop(r["name"]))
        for name, part in held.items():
            yield pack(name, part)

    return rows.select("name", "label", "wide", "folds").mapInArrow(run, _BLOCK).checkpoint()


def _blocks(batches, n_narrow):
    for batch in batches:
        for r in batch.to_pylist():
            n, k = r["n"], len(r["folds"])
            yield {"name": r["name"], "folds": r["folds"], "labels": np.frombuffer(r["labels"], dtype="int64"),
                   "wide": np.frombuffer(r["wide"]).reshape(n, -1), "weights": np.frombuffer(r["weights"]).reshape(n, k),
                   "narrow": np.frombuffer(r["narrow"]).reshape(n, k, n_narrow), "splits": np.frombuffer(r["splits"], dtype="int8").reshape(n, k)}


def _by_core(blocks: DataFrame) -> DataFrame:
    """``blocks`` in as many partitions as there are cores, if in more: a pass shuffles a
    sum for each task and name, which must not grow with the blocks."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks if blocks.rdd.getNumPartitions() <= cores else blocks.coalesce(cores)


def _summed(blocks: DataFrame, n_narrow: int, one) -> dict[str, np.ndarray]:
    """The sum over all blocks of a name of the vectors ``one(block)``."""
    blocks = _by_core(blocks)
    fan = max(1, math.isqrt(blocks.rdd.getNumPartitions()))

    def per_task(batches):
        from pyspark import TaskContext

        task, total = TaskContext.get().partitionId(), {}
        for block in _blocks(batches, n_narrow):
            total[block["name"]] = total.get(block["name"], 0.0) + one(block)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["name", "task", "sums"])

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t["task"].to_numpy(), kind="stable")
        parts = t["sums"].to_pylist()
        total = np.zeros(len(parts[0]) // 8)
        for i in order:
            total += np.frombuffer(parts[i])
        return pa.table([t["name"].slice(0, 1), t["task"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["name", "task", "sums"])

    sums = blocks.mapInArrow(per_task, _SUMS)
    if fan > 1:
        sums = sums.groupBy("name", F.pmod("task", F.lit(fan))).applyInArrow(add, _SUMS)
    sums = sums.groupBy("name").applyInArrow(add, _SUMS)
    return {r["name"]: np.frombuffer(r["sums"]) for r in sums.collect()}


class Lbfgs:
    """Minimises one model's loss; ``ask`` gives the next point to evaluate,
    ``tell`` takes loss and gradient there."""

    def __init__(self, size: int, tol: float = 1e-6):
        self.x, self.trial, self.f, self.tol = np.zeros(size), np.zeros(size), None, tol
        self.pairs, self.step, self.done = deque(maxlen=MEMORY), 1.0, False

    def ask(self) -> np.ndarray:
        return self.trial

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.done:
            return
        if self.f is not None and f > self.f + 1e-4 * self.step * self.slope:
            self.step /= 2  # too far: the same direction, half as far
            self.done = self.step < 1e-10
        else:
            if self.f is not None:
                s, y = self.trial - self.x, g - self.g
                if s @ y > 1e-10 * (y @ y):
                    self.pairs.append((s, y))
                self.done = abs(self.f - f) <= self.tol * max(abs(self.f), abs(f), 1e-12)
            self.x, self.f, self.g = self.trial, f, g
            self.done = self.done or np.abs(g).max(initial=0.0) < 1e-10
            self.direction = self._direction()
            self.slope = self.g @ self.direction
            self.step = 1.0 if self.pairs else 1.0 / max(1.0, np.linalg.norm(g))
        self.trial = self.x if self.done else self.x + self.step * self.direction

    def _direction(self) -> np.ndarray:
        q, kept = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        return -q


def _column_sums(block, classes: int) -> np.ndarray:
    """Per fold: weight, weight of each class, sums and square sums of the columns."""
    w, wide, narrow = block["weights"], block["wide"], block["narrow"]
    hot = np.eye(classes)[block["labels"]]
    out = [w.sum(axis=0)[:, None], w.T @ hot, w.T @ wide, np.einsum("nk,nkd->kd", w, narrow), w.T @ (wide * wide), np.einsum("nk,nkd->kd", w, narrow * narrow)]
    return np.concatenate(out, axis=1).ravel()


def _scores(block, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(rows, folds, classes) for weights (folds, columns, classes)."""
    k, _, c = weight.shape
    d = block["wide"].shape[1]
    z = (block["wide"] @ weight[:, :d].transpose(1, 0, 2).reshape(d, k * c)).reshape(-1, k, c)
    return z + np.einsum("nkd,kdc->nkc", block["narrow"], weight[:, d:]) + bias


def _gradient(block, weight, bias) -> np.ndarray:
    """Per fold: loss, sum of the residuals, gradient by the columns as stored."""
    z = _scores(block, weight, bias)
    z -= z.max(axis=2, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=2)
    n, k, c = z.shape
    label = block["labels"]
    picked = np.take_along_axis(z, np.broadcast_to(label[:, None, None], (n, k, 1)), axis=2)[..., 0]
    loss = ((np.log(total) - picked) * block["weights"]).sum(axis=0)
    r = e / total[..., None]
    r[np.arange(n), :, label] -= 1.0
    r *= block["weights"][..., None]
    d = block["wide"].shape[1]
    g_wide = (block["wide"].T @ r.reshape(n, k * c)).reshape(d, k, c).transpose(1, 0, 2)
    g = np.concatenate([g_wide, np.einsum("nkd,nkc->kdc", block["narrow"], r)], axis=1)
    return np.concatenate([loss[:, None], r.sum(axis=0), g.reshape(k, -1)], axis=1).ravel()


class Fit:
    """Weights of all models: per name (folds, columns, classes) and bias
    (folds, classes), for columns as stored; ``usable`` marks the folds whose
    train rows hold at least two classes."""

    def __init__(self):
        self.weight, self.bias, self.usable, self.loss, self.passes = {}, {}, {}, {}, 0


def fit_all(blocks: DataFrame, n_narrow: int, classes: int, max_passes: int = 50, tol: float = 1e-6) -> Fit:
    """Fit the models of all names and folds of ``blocks`` together."""
    out = Fit()
    sums = _summed(blocks, n_narrow, lambda b: np.r_[float(b["weights"].shape[1]) * len(b["labels"]), float(len(b["labels"])), _column_sums(b, classes)])
    scale, models = {}, {}
    for name, v in sums.items():
        k = round(v[0] / v[1])  # folds times rows over rows
        v = v[2:].reshape(k, -1)
        n, held, cols = np.maximum(v[:, :1], 1e-300), v[:, 1 : 1 + classes], v[:, 1 + classes :]
        mean, square = np.split(cols, 2, axis=1)
        mean = mean / n
        var = np.maximum(square / n - mean * mean, 0.0)
        inverse = np.where(var > 1e-12 * np.maximum(square / n, 1e-300), 1.0 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)
        scale[name] = (n[:, 0], mean, inverse)
        out.usable[name] = (held > 0).sum(axis=1) >= 2
        models[name] = [Lbfgs((mean.shape[1] + 1) * classes, tol) for _ in range(k)]
        for m, fine in zip(models[name], out.usable[name]):
            m.done = not fine

    def as_stored(name):
        _, mean, inverse = scale[name]
        x = np.stack([m.ask() if not final else m.x for m in models[name]]).reshape(len(mean), -1, classes)
        weight = x[:, :-1] * inverse[..., None]
        return weight, x[:, -1] - np.einsum("kd,kdc->kc", mean, weight)

    final = False
    while out.passes < max_passes and any(not m.done for ms in models.values() for m in ms):
        now = {name: as_stored(name) for name in models}
        shared = blocks.sparkSession.sparkContext.broadcast(now)
        got = _summed(blocks, n_narrow, lambda b: _gradient(b, *shared.value[b["name"]]))
        out.passes += 1
        for name, v in got.items():
            n, mean, inverse = scale[name]
            v = v.reshape(len(mean), -1)
            residual, g = v[:, 1 : 1 + classes], v[:, 1 + classes :].reshape(len(mean), -1, classes)
            g = (g - mean[..., None] * residual[:, None]) * inverse[..., None]
            for i, m in enumerate(models[name]):
                m.tell(v[i, 0] / n[i], np.r_[g[i].ravel(), residual[i]] / n[i])
        shared.destroy()
    final = True
    for name in models:
        out.weight[name], out.bias[name] = as_stored(name)
        out.loss[name] = [m.f for m in models[name]]
    return out


def predict_held_out(blocks: DataFrame, n_narrow: int, fit: Fit) -> DataFrame:
    """(name, fold, split, label, pred) of the dev and test rows of every fold
    that has a model."""
    shared = blocks.sparkSession.sparkContext.broadcast((fit.weight, fit.bias, fit.usable))

    def run(batches):
        weight, bias, usable = shared.value
        for b in _blocks(batches, n_narrow):
            name = b["name"]
            pred = _scores(b, weight[name], bias[name]).argmax(axis=2)
            row, fold = np.nonzero((b["splits"] > 0) & usable[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(row), pa.string()), pa.array(np.array(b["folds"], dtype=object)[fold], pa.string()),
                 pa.array(np.array(SPLITS, dtype=object)[b["splits"][row, fold]], pa.string()),
                 pa.array(b["labels"][row].astype("int32")), pa.array(pred[row, fold].astype("int32"))], ["name", "fold", "split", "label", "pred"])

    return blocks.mapInArrow(run, "name string, fold string, split string, label int, pred int")
