"""Blocks of documents that ask a distributed index.

An operator that needs, for every word run of a document, something that is
known only from the whole corpus works in three steps.

1. ``blocked`` deals the documents into blocks of about ``block_bytes`` of
   text.  One shuffle, which later steps in the same plan reuse.
2. ``ask``: each block sends every distinct key once, with a partial value
   (a count, a smallest id).  That is the pre-aggregation: a key that sits in
   a third of all rows is one entry per block.  Keys go to the index shard
   named by their high bits; a shard merges the entries of all blocks and
   sends each block its answers in the order of its keys.
3. ``with_answers`` hands each block its documents and its answers.

Arrays travel as binary columns.  A task holds one block or one shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20

ASKED = "block long, shard long, kind int, keys binary, a binary, b binary"
ANSWERED = "block long, shard long, kind int, answer binary"
_ASKED = pa.schema(
    [("block", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32())]
    + [(c, pa.binary()) for c in ("keys", "a", "b")]
)
_ANSWERED = pa.schema(
    [("block", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()), ("answer", pa.binary())]
)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_bits(df: DataFrame) -> int:
    """Enough shards for four per shuffle partition."""
    return max(4, math.ceil(math.log2(4 * partitions(df))))


def blocked(df: DataFrame, text: str, spread: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``block`` and shuffle by it.  The number of blocks follows the
    total size of the texts, a block's expected size stays the same."""
    total = df.agg(F.sum(F.octet_length(F.col(text))).alias("t")).first()["t"] or 0
    n = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(n)).cast("long")
    return df.withColumn("block", block).repartition(partitions(df), "block")


def ask_rows(block: int, kind: int, bits: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None = None):
    """Messages for ``keys`` (uint64, ascending): one per shard that has keys."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
    if not len(keys):
        return pa.Table.from_pylist([], schema=_ASKED)
    size = len(starts)
    part = lambda x: [x[s:e].tobytes() for s, e in zip(starts, ends)] if x is not None else [b""] * size
    return pa.table(
        [pa.array(np.full(size, block)), pa.array(shard[starts]), pa.array(np.full(size, kind, dtype=np.int32)),
         pa.array(part(keys), pa.binary()), pa.array(part(a), pa.binary()), pa.array(part(b), pa.binary())],
        schema=_ASKED,
    )


def ask(blocks: DataFrame, send: Callable, merge: Callable, summary: bool = False) -> DataFrame:
    """``send(block, table) -> pa.Table`` of messages; ``merge(keys, a, b)``
    gets bytes objects of all messages of one shard, a list for each column,
    and returns a list of answer arrays, one for each message.  With
    ``summary`` it returns one array more, which is kept with block -1."""
    asked = blocks.groupBy("block").applyInArrow(lambda t: send(t["block"][0].as_py(), t), ASKED)
    return answers(asked, merge, summary)


def answers(asked: DataFrame, merge: Callable, summary: bool = False) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        out = merge(*(table[c].to_pylist() for c in ("keys", "a", "b")))
        cols = [table[c].to_pylist() for c in ("block", "shard", "kind")]
        if summary:
            cols = [x + [y] for x, y in zip(cols, (-1, cols[1][0], -1))]
        return pa.table([*map(pa.array, cols), pa.array([x.tobytes() for x in out], pa.binary())], names=_ANSWERED.names).cast(_ANSWERED)

    return asked.groupBy("shard").applyInArrow(run, ANSWERED)


def with_answers(blocks: DataFrame, answered: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(block, documents, answers)`` for each block; ``answers`` maps a
    kind to the bytes of its answers in the order of the keys asked."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[int, bytes] = {}
        order = np.argsort(right["shard"].to_numpy(), kind="stable") if len(right) else []
        kinds, parts = right["kind"].to_pylist(), right["answer"].to_pylist()
        for k in set(kinds):
            got[k] = b"".join(parts[i] for i in order if kinds[i] == k)
        return run(left["block"][0].as_py() if len(left) else -1, left, got)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(both, schema)


def joined(parts: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    """One array from the messages of a shard, and the messages' bounds."""
    arrays = [np.frombuffer(p, dtype=dtype) for p in parts]
    bounds = np.r_[0, np.cumsum([len(x) for x in arrays])]
    return (np.concatenate(arrays) if arrays else np.empty(0, dtype=dtype)), bounds


def split(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [values[s:e] for s, e in zip(bounds[:-1], bounds[1:])]


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Indices at which a new group begins in columns sorted together."""
    n = len(sorted_columns[0])
    if not n:
        return np.empty(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def stream_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one key each, from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != k[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
