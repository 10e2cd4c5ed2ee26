"""Lookup joins that broadcast only a table of measured size.

A lookup table (lexicon, dictionary, vocabulary, phrase list) is broadcast
when its measured size in bytes is under a bound; beyond it the join
shuffles, with the large side salted so a hot key (a word like "the" that
sits in a third of all rows) spreads over ``salt`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

DEFAULT_MAX_BROADCAST_BYTES = 32 << 20
DEFAULT_SALT = 16


def max_broadcast_bytes(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("gradeflow.broadcast.maxBytes", None)
    return int(conf) if conf else DEFAULT_MAX_BROADCAST_BYTES


def _cell_bytes(col: Column, kind: DataType) -> Column:
    """Bytes of one value, about as Spark holds it."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            each = F.transform(col, lambda x: _cell_bytes(x, kind.elementType).cast("long"))
            return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) + 24
        return F.coalesce(8 * F.size(col), F.lit(0)) + 24
    if isinstance(kind, StructType):
        total = F.lit(16)
        for f in kind.fields:
            total = total + _cell_bytes(col[f.name], f.dataType)
        return total
    return F.lit(8)


def fits_broadcast(small: DataFrame, max_bytes: int | None = None) -> bool:
    """True when the rows of ``small`` take at most ``max_bytes``: one
    aggregate with a partial sum per partition."""
    bound = max_bytes if max_bytes is not None else max_broadcast_bytes(small)
    width = F.lit(16)
    for f in small.schema.fields:
        width = width + _cell_bytes(F.col(f"`{f.name}`"), f.dataType)
    return (small.agg(F.sum(width.cast("long")).alias("b")).first()["b"] or 0) <= bound


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: list[Column] | None = None,
    salt: int = DEFAULT_SALT,
    max_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` to the lookup table ``small`` on equal ``on`` columns.

    ``how`` is one of inner, left, left_semi, left_anti.  ``salt_by`` are
    columns of ``big`` that spread a hot key (e.g. document id and position).
    """
    if fits_broadcast(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    if not salt_by:
        return big.join(small, on, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salt)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return salted_big.join(salted_small, on + ["_salt"], how).drop("_salt")
