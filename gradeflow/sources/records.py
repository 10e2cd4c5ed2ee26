"""Delimited records with quoted line breaks, read by byte ranges.

Spark's own reader makes a whole file one task as soon as a quoted field may hold
a line break.  Here Spark reads lines, split by byte ranges as any text, in two
passes:

1. Each range says what it does to a reader that enters it outside of a quoted
   field, and to one that enters it inside.  Chained along a file, that tells which
   ranges start inside of a quoted field, and where the record that covers their
   start began.  One entry for each range reaches the driver, as in Spark's own list
   of ranges.
2. Each range joins its lines into records.  A record that ends in a later range
   travels as fragments, which meet by the range where it began.

A quote opens a field only right behind a separator or a record's start; two quotes
inside a quoted field stand for one.  Records end with LF or CRLF; line breaks inside
a quoted field stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII")


class Quotes:
    """Whether a line ends inside of a quoted field."""

    def __init__(self, sep: bytes):
        s = re.escape(sep)
        inside = b'[^"]*+(?:""[^"]*+)*+"'  # up to the closing quote
        rest = b"[^" + s + b"]*+"  # what stands between it and the separator
        fields = b"(?:" + s + b'(?:"' + inside + rest + b'|(?!")' + rest + b"))*+"
        self.from_outside = re.compile(b'(?:"' + inside + rest + b'|(?!")' + rest + b")" + fields, re.S)
        self.from_inside = re.compile(inside + rest + fields, re.S)

    def after(self, line: bytes, inside: bool) -> bool:
        return (self.from_inside if inside else self.from_outside).fullmatch(line) is None

    def starts(self, lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
        """For each line whether it starts inside, and whether the last one ends so."""
        out = np.empty(len(lines), dtype=bool)
        done = 0
        quoted = pc.match_substring(lines, b'"')
        for i, line in zip(np.flatnonzero(quoted.to_numpy(zero_copy_only=False)), lines.filter(quoted).to_pylist()):
            out[done : i + 1] = inside
            inside = self.after(line, inside)
            done = i + 1
        out[done:] = inside
        return out, inside


def _runs(batch):
    """(file, start of the range, its lines) in the order of the batch."""
    files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = files.indices.to_numpy()
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (starts[1:] != starts[:-1])]) if len(code) else []
    for a, b in zip(new, np.r_[new[1:], len(code)] if len(code) else []):
        yield files.dictionary[code[a]].as_py(), int(starts[a]), batch.column("line").slice(a, int(b - a))


def _joined(lines: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The records that begin at ``cuts`` (the first at 0), each with its line ends:
    one buffer of all lines under the offsets of the records."""
    ended = pc.binary_join_element_wise(lines, b"", b"\n")
    ends = np.frombuffer(ended.buffers()[1], dtype="int32")[ended.offset : ended.offset + len(ended) + 1]
    offsets = np.ascontiguousarray(np.r_[ends[cuts], ends[-1]], dtype="int32")
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), ended.buffers()[2]])


def _effects(lines: DataFrame, sep: bytes) -> list:
    """Of each range, for a reader that enters it outside and one inside: is it
    inside at the end, and is the last record open there begun in this range."""

    def run(batches):
        quotes, held = Quotes(sep), {}
        for batch in batches:
            for file, start, part in _runs(batch):
                state = held.setdefault((file, start), [False, True, True, False])
                for enter in (0, 1):
                    begins, state[enter] = quotes.starts(part, state[enter])
                    state[2 + enter] = bool(state[2 + enter] or not begins.all())
        rows = [(file, start, *s) for (file, start), s in held.items()]
        names = ["file", "start", "outside_ends", "inside_ends", "outside_begins", "inside_begins"]
        kinds = [pa.string(), pa.int64()] + [pa.bool_()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "file string, start long, outside_ends boolean, inside_ends boolean, outside_begins boolean, inside_begins boolean"
    return lines.mapInArrow(run, schema).collect()


def _entries(effects: list) -> tuple[dict, set]:
    """(file, start of the range) -> where the record began that covers the start
    of the range, or None if a record begins there; and the ranges that hold a
    fragment of a record that crosses a range's end."""
    out, fragments, owner, file = {}, set(), None, None
    for r in sorted(effects, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, owner = r["file"], None
        out[file, r["start"]] = owner
        inside = owner is not None
        if inside or r["outside_ends"]:
            fragments.add((file, r["start"]))
        if not r["inside_ends" if inside else "outside_ends"]:
            owner = None
        elif r["inside_begins" if inside else "outside_begins"]:
            owner = r["start"]
    return out, fragments


def _records(lines: DataFrame, sep: bytes, known, crossing: bool) -> DataFrame:
    """(file, owner, start, header, record): the records that lie in one range, or
    the fragments of those that are ``crossing`` its end.  ``known`` is the broadcast
    pair of the entries and the ranges that hold a fragment."""
    names = ["file", "owner", "start", "header", "record"]

    def run(batches):
        quotes = Quotes(sep)
        entries, fragments = known.value
        at, inside, owner, open_lines, first = None, False, None, [], False

        def batch_of(owner, header, records):
            n = len(records)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(at[0]), n), pa.repeat(pa.scalar(owner, pa.int64()), n),
                                               pa.repeat(pa.scalar(at[1], pa.int64()), n), pa.array(header, pa.bool_()), records], names)

        def open_record(cut):
            """The lines held; ``cut``: the range ends inside of the record."""
            if open_lines and (cut or owner is not None) == crossing:
                yield batch_of(at[1] if owner is None else owner, [first], pa.array([b"\n".join(open_lines)], pa.binary()))

        for batch in batches:
            for file, start, part in _runs(batch):
                if (file, start) != at:
                    yield from open_record(inside)
                    if (file, start) not in entries:
                        raise RuntimeError(f"the byte ranges of {file} changed between two passes")
                    at, owner, open_lines = (file, start), entries[file, start], []
                    inside, first = owner is not None, start == 0
                if crossing and at not in fragments:
                    continue
                begins, inside = quotes.starts(part, inside)
                cuts = np.flatnonzero(~begins)
                if not len(cuts):
                    open_lines += part.to_pylist()
                    continue
                open_lines += part.slice(0, cuts[0]).to_pylist()
                yield from open_record(False)
                if open_lines:
                    first, owner = first and open_lines in ([b""], [b"\r"]), None
                if len(cuts) > 1 and (first or not crossing):
                    records = _joined(part.slice(cuts[0], cuts[-1] - cuts[0]), cuts[:-1] - cuts[0])
                    header, names_at = np.zeros(len(records), dtype=bool), 0
                    if first:  # empty lines may stand before the names
                        while names_at < len(records) and records[names_at].as_py() in (b"\n", b"\r\n"):
                            names_at += 1
                        header[: names_at + 1] = True
                        first = names_at == len(records)
                    if not crossing:
                        yield batch_of(at[1], header, records)
                open_lines = part.slice(cuts[-1]).to_pylist()
        yield from open_record(inside)

    return lines.mapInArrow(run, "file string, owner long, start long, header boolean, record binary")


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", encoding: str = "UTF-8", header: bool = True
) -> DataFrame:
    """The records of the files under ``path`` with the columns of ``schema``, by
    position.  ``header``: each file's first record holds names and is left out.
    Blanks are kept, an empty field is null, ``""`` is the empty text, empty lines
    are skipped, a record with fewer fields ends in nulls.  ``encoding`` is one of
    ``ENCODINGS``, which write quotes, separators and line ends as ASCII does.  A
    missing path raises ``AnalysisException``."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # its default, the number of cores, may change with the executors between the passes, and the ranges with it
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    mark = sep.encode()
    entries, fragments = _entries(_effects(lines, mark))
    known = spark.sparkContext.broadcast((entries, fragments))
    records = _records(lines, mark, known, crossing=False).select("header", "record")
    if fragments:
        # one row for each range that a record crosses
        pieces = F.sort_array(F.collect_list(F.struct("start", F.hex("record").alias("r"))))
        met = _records(lines, mark, known, crossing=True).groupBy("file", "owner").agg(F.max("header").alias("header"), pieces.alias("p"))
        records = records.unionByName(met.select("header", F.unhex(F.array_join(F.col("p.r"), "0A")).alias("record")))
    if header:
        records = records.filter(~F.col("header"))
    text = F.make_valid_utf8(F.col("record").cast("string")) if encoding.upper() == "UTF-8" else F.decode("record", encoding)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    # a record ends as its lines do, or bare at the end of a range
    t = F.col("t")
    cut = F.when(t.endswith("\r\n"), 2).when(t.endswith("\n") | t.endswith("\r"), 1).otherwise(0)
    texts = records.select(text.alias("t")).select(F.left(t, F.length(t) - cut).alias("t")).filter(t != "")
    parsed = texts.select(F.from_csv("t", columns, options).alias("r"))
    return parsed.select("r.*")
