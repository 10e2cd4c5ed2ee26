"""Operator 5, quality classifier: random Fourier features, ridge, isotonic
calibration.

Statistics of a text (``STATISTICS``: its size, the share of its bytes in each
character class, its words and lines) are standardised and mapped to ``width``
cosines of random projections, whose inner products approximate a Gaussian
kernel.  Ridge regression on the label is fitted from normal equations that
each partition sums for its rows.  Raw scores are calibrated by isotonic
regression on the training rows, with the raw scores counted on a grid of
``1 / GRID``; between the middles of its steps the calibration is linear.

Bounds.  At most ``max_train`` labelled rows are used (a hash of the id picks
them when there are more).  The driver holds the model: ``width ** 2`` sums and
at most a few times ``GRID`` counts, whatever the size of the input.

Cases.  Null or empty text has statistics of 0 and gets a score like any other.
Labels that are null, or whose id has no document, are not used; repeated
labels count as often as they occur.  Without labels, or with one class only,
every score is the mean label (0.5 without any).  Rows with a null id are
scored and never held out.  Other columns are kept or not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradeflow.llm.words import Words, slices

MAX_TRAIN = 200_000
WIDTH = 200
BANDWIDTH = 4.0
RIDGE = 1e-4
GRID = 1000
KEEP = 0.3
FOLDS = 5

#: Byte classes; the rest of ASCII is a class of its own, bytes above 127 are one.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:?'\"()-", "!", "|",
           "#$%&*@^~=+<>_/\\`{}[]")
STATISTICS = (["log_bytes"] + [f"share_{i}" for i in range(len(CLASSES) + 2)]
              + ["log_words", "mean_word", "long_words", "distinct_words", "log_lines", "upper_words", "marked_words"])


def statistics(column) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    words = Words(column)
    n = len(words.offsets) - 1
    kind = np.full(256, len(CLASSES), dtype=np.uint8)
    kind[128:] = len(CLASSES) + 1
    for i, members in enumerate(CLASSES):
        kind[list(members.encode())] = i
    kinds = kind[words.data]
    size = np.diff(words.offsets)
    row = np.repeat(np.arange(n), size)
    width = len(CLASSES) + 2
    counts = np.bincount(row * width + kinds, minlength=n * width).reshape(n, width)
    some = np.maximum(size, 1)[:, None]
    n_words = np.diff(words.first)
    per_word = np.maximum(n_words, 1)
    length = words.end - words.start
    by_row = lambda w: np.bincount(words.doc, weights=w, minlength=n) / per_word
    distinct = np.array([len(np.unique(words.hash[s:e])) for s, e in zip(words.first[:-1], words.first[1:])], dtype=float)
    upper = kinds[words.start] == 0
    upper &= kinds[np.minimum(words.start + 1, words.end - 1)] == 0
    last = kinds[words.end - 1]
    marked = (last == 6) | (last == 7) | (last == 8)
    lines = counts[:, 4] + 1
    return np.column_stack([
        np.log1p(size), counts / some, np.log1p(n_words), by_row(length), by_row(length > 15), distinct / per_word,
        np.log(np.maximum(n_words, 1) / lines + 1), by_row(upper), by_row(marked)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    weight: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.sqrt(2.0 / len(self.shift)) * np.cos(z @ self.project + self.shift)
        return np.column_stack([waves, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), float(self.values[0]))
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns the steps' middles and levels."""
    steps: list[list[float]] = []
    for xi, wi, mi in zip(x, weight, mean):
        steps.append([xi * wi, wi, mi * wi])
        while len(steps) > 1 and steps[-2][2] / steps[-2][1] >= steps[-1][2] / steps[-1][1]:
            top = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], top)]
    table = np.array(steps)
    return table[:, 0] / table[:, 1], table[:, 2] / table[:, 1]


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def _statistics_rows(labelled: DataFrame) -> DataFrame:
    """``y`` and the statistics of the texts."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["y", *STATISTICS])

    return labelled.select("y", "text").mapInArrow(run, "y double, " + ", ".join(f"{s} double" for s in STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_train: int = MAX_TRAIN, width: int = WIDTH, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = 5) -> Model:
    """Fit on the labelled rows outside the held-out fold."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter(
        F.col("y").isNotNull() & ~F.isnan("y") & F.col("id").isNotNull() & ~held_out("id"))
    n = marked.count()
    if n > max_train:
        marked = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    # at most about ``max_train`` rows, so they can meet the texts before anything is computed
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")
    train = _statistics_rows(labelled).checkpoint()
    shape = train.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(s).alias(f"m_{s}") for s in STATISTICS],
                      *[F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS]).first()
    rng = np.random.default_rng(seed)
    d = len(STATISTICS)
    project, shift = rng.normal(0, 1 / bandwidth, (d, width)), rng.uniform(0, 2 * np.pi, width)
    if not shape["n"] or shape["y"] in (0.0, 1.0):
        level = shape["y"] if shape["n"] else 0.5
        return Model(np.zeros(d), np.ones(d), project, shift, None, None, np.array([level]))
    mean = np.array([shape[f"m_{s}"] for s in STATISTICS])
    scale = np.maximum(np.array([shape[f"s_{s}"] for s in STATISTICS]), 1e-6)
    model = Model(mean, scale, project, shift)
    k = width + 1

    def matrix(batch):
        return np.column_stack([batch.column(s).to_numpy() for s in STATISTICS]), batch.column("y").to_numpy()

    def sums(batches):
        a, b, seen = np.zeros((k, k)), np.zeros(k), False
        for batch in batches:
            x, y = matrix(batch)
            z = model.features(x)
            a, b, seen = a + z.T @ z, b + z.T @ y, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    def merged(batches):
        a, b = np.zeros(k * k), np.zeros(k)
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = a + np.frombuffer(x), b + np.frombuffer(y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    parts = train.mapInArrow(sums, "a binary, b binary").repartition(4).mapInArrow(merged, "a binary, b binary").collect()
    a = sum(np.frombuffer(bytes(r["a"])) for r in parts).reshape(k, k)
    b = sum(np.frombuffer(bytes(r["b"])) for r in parts)
    model.weight = np.linalg.solve(a + ridge * shape["n"] * np.eye(k), b)

    def grid(batches):
        for batch in batches:
            x, y = matrix(batch)
            at = np.round(np.clip(model.raw(x), -1, 2) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], ["at", "y"])

    steps = train.mapInArrow(grid, "at long, y double").groupBy("at").agg(
        F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("at").collect()
    model.knots, model.values = isotonic(
        np.array([r["at"] / GRID for r in steps]), np.array([float(r["n"]) for r in steps]), np.array([r["y"] for r in steps]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` added (it replaces one of that name)."""
    rest = docs.drop(name)
    schema = StructType([*rest.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            value = model.score(statistics(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, name])

    return rest.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, **kw) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``."""
    scored = score(docs.select(id_col, text_col), fit(docs, labels, id_col, text_col, **kw), text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, **kw) -> DataFrame:
    """The rows that score at least ``keep``, with the columns of ``docs``."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels, id_col, text_col, **kw), text_col, name).filter(F.col(name) >= keep).drop(name)
