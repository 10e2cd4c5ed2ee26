"""Exact order statistics from a few histogram passes, without moving values.

The bits of a double, its sign folded in, order like the number.  A pass counts
the values by their leading bits; the count tells which prefix holds each wanted
position, and the next pass counts only the values under those prefixes, some
bits deeper.  A prefix with one distinct value is settled.  What is shuffled is a
count, a minimum and a maximum for each prefix and task, what reaches the driver
at most ``HELD_ROWS`` of them a pass; callers with more groups or positions sort
instead (``radix_positions`` returns None).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_ROWS = 1 << 20
FIRST_BITS = 16


def sortable(v: np.ndarray) -> np.ndarray:
    """Signed integers that order like the doubles ``v``."""
    bits = np.ascontiguousarray(v, dtype="float64").view("int64")
    return bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


def double_of(s: np.ndarray) -> np.ndarray:
    return (s ^ (s >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))).view("float64")


def _pass(values: DataFrame, known: int, take: int, wanted: dict | None) -> list | None:
    """(group, prefix, n, low, high) for the prefixes of ``known + take`` bits
    below the ``wanted`` ones of ``known`` bits, or None if they are too many."""
    shared = values.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            coded = batch.column("g").dictionary_encode()
            code = coded.indices.to_numpy()
            s = sortable(batch.column("v").to_numpy())
            for i, group in enumerate(coded.dictionary.to_pylist()):
                mine = s[code == i]
                if shared.value is not None:
                    prefixes = shared.value.get(group)
                    if prefixes is None:
                        continue
                    at = mine >> (64 - known)
                    place = np.minimum(np.searchsorted(prefixes, at), len(prefixes) - 1)
                    mine = mine[prefixes[place] == at]
                if not len(mine):
                    continue
                mine = np.sort(mine)
                prefix = mine >> (64 - known - take)
                first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
                ends = np.r_[first[1:], len(mine)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(first), pa.string()), pa.array(prefix[first]), pa.array(ends - first), pa.array(mine[first]), pa.array(mine[ends - 1])],
                    ["g", "prefix", "n", "low", "high"])

    counted = values.mapInArrow(run, "g string, prefix long, n long, low long, high long")
    found = counted.groupBy("g", "prefix").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    table = found.limit(HELD_ROWS + 1).toArrow()
    if table.num_rows > HELD_ROWS:
        return None
    code = table["g"].combine_chunks().dictionary_encode()
    cols = [table[c].to_numpy() for c in ("prefix", "n", "low", "high")]
    order = np.lexsort((cols[0], code.indices.to_numpy()))
    names, groups = code.dictionary.to_pylist(), code.indices.to_numpy()[order]
    cols = [c[order] for c in cols]  # once: the parts of the groups are views
    cuts = np.searchsorted(groups, np.arange(len(names) + 1))
    return [(names[i], *(c[a:b] for c in cols)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]


def radix_positions(values: DataFrame, positions) -> dict | None:
    """``values`` (g string, v double, both not null); ``positions(n)`` gives the
    wanted places (from 0, ascending) among n values.  Returns for each group
    (n, places, values at the places), or None where that would be too much for
    the driver."""
    first = _pass(values, 0, FIRST_BITS, None)
    if first is None:
        return None
    state = {}
    for group, prefix, n, low, high in first:
        total = int(n.sum())
        places = np.unique(np.asarray(positions(total), dtype="int64"))
        state[group] = {"n": total, "places": places, "value": np.zeros(len(places), dtype="int64"), "open": np.arange(len(places)),
                        "under": np.zeros(len(places), dtype="int64"), "before": np.zeros(len(places), dtype="int64")}
    if sum(len(s["places"]) for s in state.values()) * 16 > HELD_ROWS:
        return None
    known, rows = FIRST_BITS, first
    start = True
    while True:
        for group, prefix, n, low, high in rows:
            s = state[group]
            ahead = np.cumsum(n) - n  # values of this pass ahead of each prefix
            if not start:
                parent = prefix >> take
                lead = np.searchsorted(parent, s["under"])  # first row below a place's prefix
                local = s["places"][s["open"]] - s["before"] + ahead[lead]
            else:
                local = s["places"][s["open"]]
            at = np.searchsorted(ahead, local, side="right") - 1
            base = s["places"][s["open"]] - (local - ahead[at])
            done = low[at] == high[at]
            s["value"][s["open"][done]] = low[at[done]]
            s["open"], s["under"], s["before"] = s["open"][~done], prefix[at[~done]], base[~done]
        wanted = {g: np.unique(s["under"]) for g, s in state.items() if len(s["open"])}
        if not wanted:
            return {g: (s["n"], s["places"], double_of(s["value"])) for g, s in state.items()}
        spare = 19 - math.ceil(math.log2(sum(map(len, wanted.values())) + 1))
        take = min(64 - known, max(4, spare))
        rows, start = _pass(values, known, take, wanted), False
        if rows is None:
            return None
        known += take
