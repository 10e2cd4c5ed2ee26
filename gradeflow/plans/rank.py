"""Global order statistics without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition pulls every row into
one task.  Here the rows are range-partitioned on the order key, sorted inside
each partition and numbered there; the per-partition sizes (one row per
partition) give each partition its offset.  The numbered data is written to
the reliable checkpoint folder first, so a lost executor recomputes the same
numbering instead of a different one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _numbered(df: DataFrame, order: list[Column], n_parts: int | None) -> DataFrame:
    """Range-partition, sort inside partitions, number.  Without an explicit
    count the range shuffle is coalescable by AQE: it merges only contiguous
    ranges, and the sort runs after the merge, so the order holds while small
    inputs avoid hundreds of tiny tasks."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(n_parts, *order) if n_parts else df.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return out.checkpoint(eager=True)


def _offsets(numbered: DataFrame, value: Column, name: str) -> DataFrame:
    """Per partition: sum of ``value`` over all earlier partitions, plus the total."""
    per_part = numbered.groupBy(F.shiftright("_mid", _LOCAL_BITS).alias("_pid")).agg(
        F.sum(value).alias("_part_sum")
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per partition: a few thousand rows at most, so one task is fine
    return per_part.select(
        "_pid",
        F.coalesce(F.sum("_part_sum").over(before), F.lit(0)).alias(f"_{name}_before"),
        F.sum("_part_sum").over(everything).alias(f"_{name}_total"),
    )


def global_rank(
    df: DataFrame,
    order: list[Column],
    name: str = "rank",
    with_total: bool = False,
    n_parts: int | None = None,
) -> DataFrame:
    """Add a 1-based position in the total order ``order`` (make it total:
    append a unique column).  ``with_total`` also adds ``{name}_n``, the row count."""
    numbered = _numbered(df, order, n_parts)
    offsets = _offsets(numbered, F.lit(1).cast("long"), name)
    pid = F.shiftright("_mid", _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    joined = numbered.join(F.broadcast(offsets), pid == F.col("_pid"))
    out = joined.withColumn(name, (F.col(f"_{name}_before") + local + 1).cast("long"))
    if with_total:
        out = out.withColumn(f"{name}_n", F.col(f"_{name}_total").cast("long"))
    return out.drop("_mid", "_pid", f"_{name}_before", f"_{name}_total")


def global_running_sum(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    n_parts: int | None = None,
) -> DataFrame:
    """Inclusive running sums in the total order ``order``.  Each output column
    ``name`` holds the sum of ``sums[name]`` over all rows up to this one;
    ``{name}_total`` holds the grand total."""
    staged = df
    for name, value in sums.items():
        staged = staged.withColumn(f"_v_{name}", value)
    numbered = _numbered(staged, order, n_parts)
    pid = F.shiftright("_mid", _LOCAL_BITS)
    # the checkpointed partitions hold their rows in order: the running sum
    # inside a partition is a narrow scan (no second shuffle)
    out = _within_partition_cumsum(numbered, list(sums))
    for name in sums:
        offsets = _offsets(numbered, F.col(f"_v_{name}"), name)
        out = out.join(F.broadcast(offsets), pid == F.col("_pid")).drop("_pid")
        out = out.withColumn(name, F.col(f"_{name}_before") + F.col(f"_w_{name}"))
        out = out.withColumnRenamed(f"_{name}_total", f"{name}_total").drop(
            f"_{name}_before", f"_v_{name}", f"_w_{name}"
        )
    return out.drop("_mid")


def _within_partition_cumsum(numbered: DataFrame, names: list[str]) -> DataFrame:
    """``_w_{name}``: inclusive cumulative sum of ``_v_{name}`` inside each
    partition, in row order (Arrow batches, numpy cumsum)."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    fields = list(numbered.schema.fields)
    integral = {}
    for n in names:
        t = numbered.schema[f"_v_{n}"].dataType.typeName()
        integral[n] = t in ("long", "integer", "short", "byte")
        fields.append(StructField(f"_w_{n}", LongType() if integral[n] else DoubleType()))
    schema = StructType(fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        acc = {n: 0 for n in names}
        for rb in batches:
            cols = list(rb.columns)
            for n in names:
                v = rb.column(f"_v_{n}").fill_null(0).to_numpy(zero_copy_only=False)
                c = np.cumsum(v.astype("int64" if integral[n] else "float64")) + acc[n]
                if len(c):
                    acc[n] = c[-1]
                cols.append(pa.array(c))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                list(rb.schema) + [pa.field(f"_w_{n}", pa.int64() if integral[n] else pa.float64()) for n in names]
            ))

    return numbered.mapInArrow(run, schema)


def global_ntile(df: DataFrame, order: list[Column], k: int, name: str = "tile") -> DataFrame:
    """``ntile(k) OVER (ORDER BY order)`` computed from H1 ranks: the first
    ``n mod k`` tiles hold one row more, as SQL's ntile does."""
    ranked = global_rank(df, order, name="_r", with_total=True)
    n, r = F.col("_r_n"), F.col("_r")
    q = F.floor(n / k)
    m = n - q * k
    big = m * (q + 1)
    tile = F.when(r <= big, F.floor((r - 1) / (q + 1))).otherwise(m + F.floor((r - 1 - big) / q)) + 1
    return ranked.withColumn(name, tile.cast("int")).drop("_r", "_r_n")
