"""Places in a hash order, found by counting, without sorting the rows.

A row's key is its hex digest and then its id.  Digests spread evenly, so the
rows counted by their leading hex digits show which prefix holds a wanted place.
Only the rows under those prefixes are counted again, some digits deeper, until
few enough are left to be read and sorted.  What reaches the driver is at most
``HELD_ROWS`` counts a pass and then at most ``READ_ROWS`` keys.  The input is
scanned a few times, reading the id and the group alone, so it must give the
same rows each time.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_ROWS = 1 << 18
READ_ROWS = 10_000
MOST_CUTS = 64  # a cut is a comparison in the expression of every row
FIRST_DIGITS = 3
DIGITS = 32


def _under(prefixes: dict, known: int) -> Column:
    """Is the row under one of its group's ``prefixes`` (of ``known`` digits)?"""
    out = F.lit(False)
    for group, found in prefixes.items():
        out = out | (F.col("g").eqNullSafe(F.lit(group)) & F.substring("h", 1, known).isin(sorted(found)))
    return out


def hash_cuts(df: DataFrame, key: Column, id_col: str, positions, group_col: str | None = None) -> dict | None:
    """``positions(counts)`` takes the number of rows of every group and gives the
    wanted places of each (from 0, below that number).  Returns for every group its
    places and the (digest, id) found there, as ``{group: {place: (digest, id)}}``;
    without ``group_col`` the one group is ''.

    None where no key says where to cut, so that the caller has to number the rows:
    there are more than ``MOST_CUTS`` places, or more groups than the driver should
    hold, or a place inside a run of rows with the same id."""
    keys = df.select(
        (F.col(group_col) if group_col else F.lit("")).alias("g"), F.coalesce(key, F.lit("")).alias("h"), F.col(id_col).alias("i"))
    known = FIRST_DIGITS

    def count(rows, digits):
        return rows.groupBy("g", F.substring("h", 1, digits).alias("p")).agg(F.count("*").alias("n"))

    seen = count(keys, known).limit(HELD_ROWS + 1).collect()
    if len(seen) > HELD_ROWS:
        return None
    counts = {} if group_col else {"": 0}
    for r in seen:
        counts[r["g"]] = counts.get(r["g"], 0) + r["n"]
    wanted = {g: sorted({p for p in places if 0 <= p < counts[g]}) for g, places in positions(counts).items()}
    wanted = {g: places for g, places in wanted.items() if places}
    if sum(map(len, wanted.values())) > MOST_CUTS:
        return None
    if not wanted:
        return {}
    # of every place: the prefix that holds it and the rows ahead of that prefix
    ahead = {(g, p): ("", 0) for g, places in wanted.items() for p in places}
    upper = 0
    while True:
        below = {}
        for r in sorted(seen, key=lambda r: r["p"]):
            names, ends = below.setdefault((r["g"], r["p"][:upper]), ([], []))
            names.append(r["p"])
            ends.append(r["n"] + (ends[-1] if ends else 0))
        held = {}
        for (g, place), (prefix, before) in ahead.items():
            names, ends = below[g, prefix]
            at = bisect_right(ends, place - before)
            passed = ends[at - 1] if at else 0
            ahead[g, place] = (names[at], before + passed)
            held[g, names[at]] = ends[at] - passed
        prefixes = {}
        for g, p in held:
            prefixes.setdefault(g, set()).add(p)
        inside = keys.filter(_under(prefixes, known))
        if sum(held.values()) <= READ_ROWS or known >= DIGITS:
            break
        upper = known
        known = min(DIGITS, known + max(1, int(math.log(max(HELD_ROWS / len(held), 1), 16))))
        seen = count(inside, known).collect()
    # equal digests are equal ids, or else few: counted by key, the rows are bounded whatever repeats
    lines = inside.groupBy("g", "h", "i").agg(F.count("*").alias("n")).collect()
    found = {}
    for (g, place), (prefix, before) in ahead.items():
        mine = sorted((r for r in lines if r["g"] == g and r["h"].startswith(prefix)), key=lambda r: (r["h"], r["i"] is not None, r["i"]))
        for r in mine:
            if place < before + r["n"]:
                if place != before:
                    return None
                found.setdefault(g, {})[place] = (r["h"], r["i"])
                break
            before += r["n"]
    return found


def at_or_after(key: Column, id_col: str, cut: tuple) -> Column:
    """Does the row stand at ``cut`` (digest, id) or behind it?"""
    digest, row_id = cut
    h = F.coalesce(key, F.lit(""))
    same = F.lit(True) if row_id is None else F.coalesce(F.col(id_col) >= F.lit(row_id), F.lit(False))
    return (h > F.lit(digest)) | ((h == F.lit(digest)) & same)
