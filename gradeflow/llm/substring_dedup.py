"""Operator 4, substring dedup: exact repeats from an anchored window index.

The index covers the whole corpus in shards keyed by content.  It stands in for
a relative Lempel-Ziv parse: no factor with a source position is made, but a
word is found to be a duplicate just when a match of at least ``window`` words
covers it.

*Anchors.*  Of the ``window - gram + 1`` word n-grams in a window the one with
the smallest hash is its anchor.  Equal windows have equal anchors, so a match
lies in the block of its anchor and other blocks need not be asked.
Consecutive windows with one anchor form a segment, a word range of at most
``2 * window - gram`` words unless the text is periodic.

*Whole segments.*  A shard indexes the distinct segments under each anchor.
A segment that occurs twice is a match as a whole, so a span grows over all
consecutive segments that match.

*Ends of matches.*  Where a match ends the segment as a whole occurs only
once but its anchor occurs elsewhere too; its matching windows are found by
asking for each window by itself.  The same holds for periodic text, where a
window may recur inside its own segment.

A span may run over matches with different sources.  The result is exact for
64-bit hashes: a word is in a span if and only if a window that covers it also
starts somewhere else.

Cases.  Null or empty text, or fewer than ``window`` words: no spans.
Repeated rows count as occurrences of each other.  A null id is kept as a null
id.  Columns other than the id and the text are not read and may have any
name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from gradeflow.llm import blocks as B
from gradeflow.llm.words import Ranges, Words

WINDOW = 35
GRAM = 16

REPEATED, SEND = 1, 2  # bits of an answer about a segment
_NULL = "text was null"


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values."""
    done, out = 1, x
    while done * 2 <= span:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < span:
        shift = span - done
        out = np.minimum(out[: len(out) - shift], out[shift:])
    return out


class Segments:
    """Segments of a block: first and last window (``a``, ``b``), ``anchor``,
    ``content`` hash and whether the text around is periodic."""

    def __init__(self, words: Words, window: int, gram: int):
        self.words, self.window = words, window
        n, span = len(words.hash), window - gram + 1
        empty = np.empty(0, dtype=np.int64)
        self.a = self.b = empty
        self.anchor = self.content = np.empty(0, dtype=np.uint64)
        self.periodic = np.empty(0, dtype=bool)
        self.ranges = Ranges(words.hash)
        if n < window:
            return
        grams = self.ranges.grams(gram)
        low = sliding_min(grams, span)  # of each window
        inside = words.doc[window - 1 :] == words.doc[: n - window + 1]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | ~inside[:-1] | (words.doc[1 : len(low)] != words.doc[: len(low) - 1])
        a = np.flatnonzero(new & inside)
        last = np.ones(len(low), dtype=bool)
        last[:-1] = new[1:] | ~inside[1:]
        b = np.flatnonzero(last & inside)
        again = np.zeros(len(grams) + 1, dtype=np.int64)
        near = np.zeros(len(grams), dtype=bool)
        for d in range(1, span + 1):  # occurrences of an anchor in one segment are at most ``span`` apart
            near[d:] |= grams[d:] == grams[:-d]
        np.cumsum(near, out=again[1:])
        self.a, self.b, self.anchor = a, b, low[a]
        self.content = self.ranges.of(a, b + window)
        self.periodic = again[b + span] > again[a]

    def distinct(self):
        """Order by anchor and content, and where each distinct pair starts."""
        order = np.lexsort((self.content, self.anchor))
        return order, B.group_starts(self.anchor[order], self.content[order])

    def windows(self, which: np.ndarray) -> np.ndarray:
        """All windows of the segments ``which``."""
        count = (self.b - self.a + 1)[which]
        if not count.sum():
            return np.empty(0, dtype=np.int64)
        ends = np.cumsum(count)
        return np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(self.a[which], count)


def _segment_verdicts(answer: bytes, seg: Segments) -> np.ndarray:
    order, starts = seg.distinct()
    out = np.zeros(len(seg.a), dtype=np.uint8)
    if len(order):
        code = np.frombuffer(answer, dtype=np.uint8)
        out[order] = np.repeat(code, np.diff(np.r_[starts, len(order)]))
    return out


def _merge_segments(keys, contents, marks):
    """Index of one reference block: which segments match as a whole, and
    which must be sent window by window."""
    anchor, bounds = B.joined(keys, np.uint64)
    content, _ = B.joined(contents, np.uint64)
    mark, _ = B.joined(marks, np.uint8)  # 1: twice or more in its block of documents; 2: periodic
    order = np.lexsort((content, anchor))  # stable: messages come in the order of their blocks
    sa, sc, sm = anchor[order], content[order], mark[order]
    starts = B.group_starts(sa, sc)
    size = np.diff(np.r_[starts, len(order)])
    if not len(order):
        return B.split(np.empty(0, dtype=np.uint8), bounds)
    twice = (size > 1) | (np.maximum.reduceat(sm & 1, starts) > 0)
    periodic = np.maximum.reduceat(sm & 2, starts) > 0
    at = B.group_starts(sa[starts])
    kinds = np.repeat(np.diff(np.r_[at, len(starts)]), np.diff(np.r_[at, len(starts)]))
    code = np.zeros(len(starts), dtype=np.uint8)
    code[twice] |= REPEATED
    alone = ~twice & ((kinds > 1) | periodic)
    code[alone] |= SEND
    per_row = np.repeat(code, size)
    per_row[starts[twice & (kinds > 1)]] |= SEND  # one document block speaks for all copies
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = per_row
    return B.split(out, bounds)


def _merge_windows(keys, counts, _):
    key, bounds = B.joined(keys, np.uint64)
    count, _ = B.joined(counts, np.uint8)
    order = np.argsort(key, kind="stable")
    starts = B.group_starts(key[order])
    out = np.empty(len(order), dtype=np.uint8)
    if len(order):
        total = np.add.reduceat(count[order].astype(np.int64), starts)
        out[order] = np.repeat((total > 1).astype(np.uint8), np.diff(np.r_[starts, len(order)]))
    return B.split(out, bounds)


def _sent_windows(seg: Segments, verdict: np.ndarray):
    """Distinct windows to ask for, their counts (2 stands for more), and for
    each window sent its place among the distinct ones."""
    which = np.flatnonzero(verdict & SEND)
    at = seg.windows(which)
    twice = np.repeat((verdict[which] & REPEATED) > 0, (seg.b - seg.a + 1)[which])
    keys, place, n = np.unique(seg.ranges.of(at, at + seg.window), return_inverse=True, return_counts=True)
    count = np.minimum(n, 2).astype(np.uint8)
    count[place[twice]] = 2
    return at, keys, place, count


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Per document: ``id_col``, the text without its duplicate words joined by
    one space (``kept``), ``n_words``, ``n_removed`` and the ``spans`` as
    (start, length) in words."""
    return _parse(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                  window, gram, block_bytes, None, "kept").withColumnRenamed("id", id_col)


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                      gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """The same rows and columns; a text that holds duplicate words becomes its
    kept words joined by one space, other texts stay as they are."""
    cols = docs.columns
    rest = F.struct(F.col(text_col).isNull().alias(_NULL), *[F.col(c) for c in cols if c != text_col])
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    out = _parse(packed, window, gram, block_bytes, "rest", "text")
    text = F.when(~F.col("rest")[_NULL], F.col("text"))
    return out.select(*[text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in cols])


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``duplicate_spans`` with the SHA-256 of the kept text in its place."""
    out = _parse(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                 window, gram, block_bytes, None, "kept_sha256")
    return out.withColumnRenamed("id", id_col)


def _parse(docs, window, gram, block_bytes, carry, kept_as):
    bits = B.shard_bits(docs)
    spread = ["id", "text"]
    dealt = B.blocked(docs, "text", spread, block_bytes)

    def send_segments(block, table):
        seg = Segments(Words(table["text"]), window, gram)
        order, starts = seg.distinct()
        size = np.diff(np.r_[starts, len(order)])
        mark = (size > 1).astype(np.uint8)
        if len(order):
            mark |= np.maximum.reduceat(seg.periodic[order].astype(np.uint8), starts) * np.uint8(2)
        first = order[starts]
        return B.ask_rows(block, 1, bits, seg.anchor[first], seg.content[first], mark)

    def send_windows(block, table, got):
        seg = Segments(Words(table["text"]), window, gram)
        _, keys, _, count = _sent_windows(seg, _segment_verdicts(got.get(1, b""), seg))
        return B.ask_rows(block, 2, bits, keys, count)

    def finish(block, table, got):
        words = Words(table["text"])
        seg = Segments(words, window, gram)
        verdict = _segment_verdicts(got.get(1, b""), seg)
        at, _, place, _ = _sent_windows(seg, verdict)
        cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
        whole = (verdict & REPEATED) > 0
        np.add.at(cover, seg.a[whole], 1)
        np.add.at(cover, seg.b[whole] + window, -1)
        if len(at):
            hit = at[np.frombuffer(got.get(2, b""), dtype=np.uint8)[place] > 0]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        return _result(table, words, removed, carry, kept_as)

    # every step reads the same columns of ``dealt``, so its shuffle is run once
    first = B.ask(dealt, send_segments, _merge_segments)
    asked = B.with_answers(dealt, first, send_windows, B.ASKED)
    second = B.answers(asked, _merge_windows)
    span = StructType([StructField("start", LongType()), StructField("length", LongType())])
    schema = StructType([StructField("id", docs.schema["id"].dataType), StructField("n_words", LongType()),
                         StructField("n_removed", LongType()), StructField(kept_as, StringType()), StructField("spans", ArrayType(span))])
    if carry:  # as it is, down to what may be null in it
        schema = schema.add(carry, docs.schema[carry].dataType)
    return B.with_answers(dealt, first.unionAll(second), finish, schema)


def _result(table, words, removed, carry, kept_as):
    n = table.num_rows
    total = np.diff(words.first)
    gone = np.zeros(len(removed) + 1, dtype=np.int64)
    np.cumsum(removed, out=gone[1:])
    n_removed = gone[words.first[1:]] - gone[words.first[:-1]]
    new = removed.copy()
    if len(removed):
        new[1:] &= ~removed[:-1] | (words.doc[1:] != words.doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(removed)])
    if len(begin):
        length = np.add.reduceat(removed, begin, dtype=np.int64)
    owner = words.doc[begin]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    raw, left = words.data.tobytes(), (~removed).tolist()
    kept = []
    for i in range(n):
        text = raw[words.offsets[i] : words.offsets[i + 1]]
        if n_removed[i] or kept_as != "text":
            parts = text.split()
            if n_removed[i]:
                parts = list(compress(parts, left[words.first[i] : words.first[i + 1]]))
            text = b" ".join(parts)
        kept.append(hashlib.sha256(text).hexdigest() if kept_as == "kept_sha256" else text.decode("utf-8"))
    spans = pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()),
        pa.StructArray.from_arrays([pa.array(begin - words.first[owner], pa.int64()), pa.array(length, pa.int64())], ["start", "length"]),
    )
    cols = {"id": table["id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            kept_as: pa.array(kept, pa.string()), "spans": spans}
    if carry:
        cols[carry] = table[carry]
    return pa.table(cols)
