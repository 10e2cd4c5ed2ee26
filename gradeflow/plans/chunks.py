"""Facts about words for texts, from word tables of any size.

Joining every token of a corpus to a word table shuffles the whole corpus word by
word.  Here texts are dealt to chunks of some MB by a hash; a chunk asks once
for each of its distinct words, the questions are joined to the table on the word,
and the answers meet the chunk's texts again in one task.  A word is asked for at
most once a chunk, so no word is hot, and what is shuffled is the texts (once for
both uses, under the same exchange), the distinct words of the chunks and the answers,
one for each of these words that the table holds.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import scan

CHUNK_BYTES = 32 << 20
LEAST_BYTES = 1 << 20  # below that, more chunks only ask for the same words again


def chunk_count(df: DataFrame, low_col: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Enough chunks for all cores and for none to hold much over ``chunk_bytes``."""
    total = df.agg(F.sum(F.octet_length(low_col).cast("long")).alias("b")).first()["b"] or 0
    spread = min(2 * df.sparkSession.sparkContext.defaultParallelism, total // LEAST_BYTES)
    return max(1, spread, math.ceil(total / chunk_bytes))


def with_word_facts(df: DataFrame, low_col: str, deal_by: list[Column], table: DataFrame, kinds: tuple, use, schema, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``use(texts, facts)`` of every chunk of ``df``: an Arrow table of its rows
    and one of the rows of ``table`` (word, ...) for the words of its
    lower-cased texts.  ``kinds`` are the token streams (``scan.streams``) that ask;
    rows that are equal in ``deal_by`` share a chunk."""
    n = chunk_count(df, low_col, chunk_bytes)
    chunked = df.withColumn("_chunk", F.pmod(F.xxhash64(*deal_by), F.lit(n)).cast("int"))

    def ask(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        low, seen = texts.column(low_col).combine_chunks(), []
        for at, rows in scan.slices(low):
            lists = scan.streams(low.slice(at, rows))
            seen.append(pa.concat_arrays([lists[k][0] for k in kinds]).unique())
        words = pa.concat_arrays(seen).unique().cast(pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(words), pa.int32()), words], names=["_chunk", "word"])

    def answer(key: tuple[pa.Scalar, ...], texts: pa.Table, facts: pa.Table) -> pa.Table:
        return use(texts.drop_columns(["_chunk"]), facts)

    asked = chunked.groupBy("_chunk").applyInArrow(ask, "_chunk int, word string")
    found = asked.join(table, "word").select("_chunk", *table.columns)  # a chunk without any is still met
    return chunked.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(answer, schema)
