"""Operator 2, n-gram Jaccard join: a size-aware heavy-light set join.

A document's set holds the hashes of its distinct word shingles.  Two sets of
n and m shingles link when their overlap is at least
``c(n, m) = ceil((n + m) * t / (1 + t))``, which is the same as a Jaccard
similarity of at least t.  Equal sets form one class; classes are joined.

*Light sets* (n <= x).  For every size m that a partner can have, a set lists
all its subsets of c(n, m) shingles.  Sets of sizes n and m that list the same
subset are linked, and linked sets list a common one, so nothing needs to be
checked.  A partner larger than x lists its subsets for the sizes up to x too.

*Large sets* (n > x) go through inverted lists in three scans.

1. Every set posts the ``n - ceil(t n) + e`` shingles with the smallest
   hashes, where e = ceil(n / 12).  Linked sets share at least
   ``k = e(ceil(t n))`` of them.  The lists return their lengths.
2. A set with fewer than k posted shingles in lists of two or more has no
   link and drops out.  The others post their rarest shingles, all but the
   last k - 1 of the first step; linked sets share at least one of these.
   The lists return their smallest class, the pivot, and their length.
3. A set goes to each of its pivots, where all sets of a pivot are joined
   exactly with a local inverted index.  A list with more than ``group_sets``
   sets is cut into chunks, and every pair of chunks is a task of its own.

The boundary x is the size at which listing subsets stops being cheaper than
the scans, summed over the sizes that occur (``boundary``).

Lists are asked for by blocks of documents (``blocks``), one entry per block
and shingle, so a shingle in a third of all documents is a few entries.  Pairs
are never written: a task returns a spanning forest of the links it finds.

Cases.  Null or empty text: an empty set that links with nothing.  Fewer words
than ``size``: the whole sequence is the one shingle.  Repeated rows share
their class.  A null id takes part, but is never a component's id unless all
ids in the component are null.  Other columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import gc
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm import blocks as B
from gradeflow.llm.components import components
from gradeflow.llm.words import Ranges, Words, mix, slices
from gradeflow.session import ensure_checkpoint_dir

SHINGLE = 5
PERCENT = 75
LARGEST_LIGHT = 12  # subsets of larger sets are never cheaper
GROUP_SETS = 4096

_POSTED = np.dtype([("low", "<u8"), ("high", "<u8"), ("n", "<u4")])
_PIVOT = np.dtype([("pivot", "<u8"), ("n", "<u4")])


def overlap(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m elements."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a set of n elements can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


class Sets:
    """Sets of a batch of texts: row i has ``items[first[i]:first[i+1]]``,
    ascending; ``key`` stands for a row's whole set."""

    def __init__(self, column, size: int):
        words = Words(column, lower=True)
        ranges = Ranges(words.hash)
        count = np.diff(words.first)
        grams = ranges.grams(size)
        inside = words.doc[size - 1 :] == words.doc[: len(grams)] if len(grams) else np.empty(0, dtype=bool)
        short = np.flatnonzero((count > 0) & (count < size))
        items = np.concatenate([grams[inside], ranges.of(words.first[short], words.first[short + 1])])
        rows = np.concatenate([words.doc[: len(grams)][inside], short])
        order = np.argsort(rows, kind="stable")
        items, rows = items[order], rows[order]
        cut = np.searchsorted(rows, np.arange(len(count) + 1))
        for s, e in zip(cut[:-1], cut[1:]):
            items[s:e].sort()
        fresh = np.ones(len(items), dtype=bool)
        fresh[1:] = (items[1:] != items[:-1]) | (rows[1:] != rows[:-1])
        self.items, rows = items[fresh], rows[fresh]
        self.first = np.searchsorted(rows, np.arange(len(count) + 1))
        self.n = np.diff(self.first)
        sums = np.zeros(len(self.items) + 1, dtype=np.uint64)
        np.cumsum(mix(self.items ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        self.key = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64))

    def distinct(self, above: int) -> np.ndarray:
        """A row of each class with more than ``above`` elements."""
        rows = np.flatnonzero(self.n > above)
        return rows[np.unique(self.key[rows], return_index=True)[1]]


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each run."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start, length)


class Lists:
    """What the large classes of a block post."""

    def __init__(self, column, size: int, percent: int, light: int):
        self.sets = Sets(column, size)
        self.rows = self.sets.distinct(light)
        self.n = self.sets.n[self.rows]
        need = -(-percent * self.n // 100)
        self.k = -(-need // 12)
        self.posted = self.n - need + -(-self.n // 12)
        self.owner = np.repeat(np.arange(len(self.rows)), self.posted)
        self.item = self.sets.items[runs(self.sets.first[self.rows], self.posted)]
        self.keys, self.place, self.count = np.unique(self.item, return_inverse=True, return_counts=True)

    def rare(self, answer: bytes):
        """(owner, item) of the second posting."""
        length = np.frombuffer(answer, dtype=np.int32)[self.place] if len(self.place) else np.empty(0, np.int32)
        shared = np.flatnonzero(length > 1)
        order = shared[np.lexsort((self.item[shared], length[shared], self.owner[shared]))]
        owner = self.owner[order]
        have = np.bincount(owner, minlength=len(self.rows))
        first = np.cumsum(have) - have
        keep = np.arange(len(order)) - first[owner] < (have - self.k + 1)[owner]
        return owner[keep], self.item[order[keep]]


def _merge_lengths(keys, counts, _):
    key, bounds = B.joined(keys, np.uint64)
    count, _ = B.joined(counts, np.int32)
    order = np.argsort(key, kind="stable")
    starts = B.group_starts(key[order])
    out = np.empty(len(order), dtype=np.int32)
    if len(order):
        total = np.minimum(np.add.reduceat(count[order].astype(np.int64), starts), 2**31 - 1)
        out[order] = np.repeat(total, np.diff(np.r_[starts, len(order)]))
    return B.split(out, bounds)


def _merge_pivots(keys, posted, _):
    key, bounds = B.joined(keys, np.uint64)
    post, _ = B.joined(posted, _POSTED)
    order = np.argsort(key, kind="stable")
    starts = B.group_starts(key[order])
    out = np.empty(len(order), dtype=_PIVOT)
    if len(order):
        low = np.minimum.reduceat(post["low"][order], starts)
        high = np.maximum.reduceat(post["high"][order], starts)
        n = np.minimum(np.add.reduceat(post["n"][order].astype(np.int64), starts), 2**32 - 1)
        merged = np.empty(len(starts), dtype=_PIVOT)
        merged["pivot"], merged["n"] = low, np.where(low == high, 0, n)
        out[order] = np.repeat(merged, np.diff(np.r_[starts, len(order)]))
    return B.split(out, bounds)


def boundary(counts: dict[int, int], percent: int) -> int:
    """The size x with the least total cost.  A light set costs its subsets,
    a large one its postings in both scans and the copies of its elements that
    go to pivots; all are entries that are sent once."""
    subsets = lambda n, sizes: sum(math.comb(n, overlap(n, m, percent)) for m in sizes if overlap(n, m, percent) <= min(n, m))
    best, least = 0, None
    for x in range(LARGEST_LIGHT + 1):
        cost = 0.0
        for n, number in counts.items():
            light = [m for m in partners(n, percent) if min(m, n) <= x]
            scans = 0 if n <= x else 2 * (n - -(-percent * n // 100) + -(-n // 12)) + n
            cost += number * (subsets(n, light) + scans)
        if least is None or cost < least:
            best, least = x, cost
    return best


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, small: int) -> DataFrame:
    """Per row: ``id``, ``row_key`` (hash of id and text), ``n``, ``class`` (null
    for an empty set) and the ``items`` of sets of up to ``small`` elements."""
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = Sets(batch.column("text"), size)
            little = np.where((sets.n > 0) & (sets.n <= small), sets.n, 0)
            bounds = np.r_[0, np.cumsum(little)]
            items = sets.items[runs(sets.first[:-1], little)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(items))
            key = pa.array(sets.key.view(np.int64), mask=sets.n == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row_key"), pa.array(sets.n, pa.int64()), key, lists],
                ["id", "row_key", "n", "class", "items"])

    return thin.mapInArrow(run, f"id {id_type}, row_key long, n long, class long, items array<long>")


def light_links(classes: DataFrame, light: int, percent: int) -> DataFrame:
    """Edges between light classes, and from them to larger partners.  A key
    is a subset together with the two sizes n <= m that it stands for."""
    pairs = [(n, m, overlap(n, m, percent)) for n in range(1, light + 1) for m in partners(n, percent)
             if m >= n and overlap(n, m, percent) <= n]

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            items = batch.column("items").flatten().to_numpy().view(np.uint64)
            first = np.cumsum(n) - n
            keys, owners, same = [], [], []
            for a, b, c in pairs:
                for side in {a, b}:
                    rows = np.flatnonzero(n == side)
                    picks = np.array(list(combinations(range(side), c)))
                    for part in np.array_split(rows, max(1, len(rows) * picks.size >> 22)):
                        held = mix(items[first[part][:, None] + np.arange(side)])
                        keys.append(mix(held[:, picks].sum(axis=2, dtype=np.uint64) + np.uint64(a * 1000 + b)).ravel())
                        owners.append(np.repeat(part, len(picks)))
                        same.append(np.full(len(keys[-1]), a == b))
            if keys:
                owner = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), batch.column("class").take(owner),
                     batch.column("n").take(owner), pa.array(np.concatenate(same))], ["key", "class", "n", "same"])

    listed = classes.select("class", "n", "items").mapInArrow(run, "key long, class long, n long, same boolean")
    groups = listed.groupBy("key").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max("same").alias("same"))
    # a key of two sizes links its members only if sets of both sizes list it
    linked = groups.filter((F.col("low") != F.col("high")) & (F.col("same") | (F.col("least") != F.col("most"))))
    return listed.select("key", "class").join(linked.select("key", "low"), "key").select(
        F.col("class").alias("a"), F.col("low").alias("b"))


def heavy_links(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, light: int,
                group_sets: int, block_bytes: int) -> DataFrame:
    """A spanning forest of the links between large classes, as edges."""
    bits = B.shard_bits(docs)
    dealt = B.blocked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id", "text"], block_bytes)

    def send_posted(block, table):
        own = Lists(table["text"], size, percent, light)
        return B.ask_rows(block, 1, bits, own.keys, own.count.astype(np.int32))

    def rare_keys(own, got):
        owner, item = own.rare(got.get(1, b""))
        keys, place = np.unique(item, return_inverse=True)
        return owner, keys, place

    def send_rare(block, table, got):
        own = Lists(table["text"], size, percent, light)
        owner, keys, place = rare_keys(own, got)
        post = np.empty(len(keys), dtype=_POSTED)
        cls = own.sets.key[own.rows][owner]
        order = np.lexsort((cls, place))
        starts = B.group_starts(place[order])
        if len(order):
            post["low"] = cls[order][starts]
            ends = np.r_[starts[1:], len(order)]
            post["high"] = cls[order][ends - 1]
            post["n"] = ends - starts
        return B.ask_rows(block, 2, bits, keys, post)

    def send_sets(block, table, got):
        own = Lists(table["text"], size, percent, light)
        owner, _, place = rare_keys(own, got)
        pivots = np.frombuffer(got.get(2, b""), dtype=_PIVOT)[place] if len(place) else np.empty(0, dtype=_PIVOT)
        some = pivots["n"] > 0
        owner, pivot, n = owner[some], pivots["pivot"][some], pivots["n"][some].astype(np.float64)
        chunks = (1 << np.ceil(np.log2(np.maximum(n / group_sets, 1))).astype(np.int64)).astype(np.int64)
        order = np.lexsort((chunks, pivot, owner))
        at = order[B.group_starts(owner[order], pivot[order], chunks[order])]
        owner, pivot, chunks = owner[at], pivot[at], chunks[at]
        cls = own.sets.key[own.rows][owner]
        mine = (cls % chunks.astype(np.uint64)).astype(np.int64)
        which = np.repeat(np.arange(len(owner)), chunks)
        other = runs(np.zeros(len(owner), dtype=np.int64), chunks)
        low, high = np.minimum(mine[which], other), np.maximum(mine[which], other)
        group = mix(mix(pivot[which] + chunks[which].astype(np.uint64)) + (low * 1_000_003 + high).astype(np.uint64))
        group = np.where(chunks[which] == 1, pivot[which], group)
        rows = own.rows[owner[which]]
        data = own.sets.items
        first = own.sets.first
        return pa.table([pa.array(group.view(np.int64)), pa.array(cls[which].view(np.int64)),
                         pa.array([data[first[r] : first[r + 1]].tobytes() for r in rows], pa.binary())],
                        names=["grp", "class", "items"])

    posted = B.ask(dealt, send_posted, _merge_lengths)
    rare = B.with_answers(dealt, posted, send_rare, B.ASKED)
    pivots = B.answers(rare, _merge_pivots)
    sent = B.with_answers(dealt, posted.unionAll(pivots), send_sets, "grp long, class long, items binary")

    def join_groups(batches):
        for group in B.stream_groups(batches, "grp"):
            a, b = forest(group["class"].to_numpy(), group["items"].to_pylist(), percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return sent.repartition(B.partitions(docs), "grp").sortWithinPartitions("grp").mapInArrow(join_groups, "a long, b long")


def forest(classes: np.ndarray, packed: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly the classes that links connect.  Each class
    scans the inverted lists of the classes not reached so far."""
    classes, at = np.unique(classes, return_index=True)
    sets = [np.frombuffer(packed[i], dtype=np.uint64) for i in at]
    m = len(sets)
    size = np.array([len(s) for s in sets])
    a, b = [], []
    open_ = np.ones(m, dtype=bool)
    index_size = 0
    items = owners = None
    left = m
    seed = 0
    while left:
        while not open_[seed]:
            seed += 1
        open_[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            x = queue.pop()
            if items is None or left * 2 < index_size:
                rest = np.flatnonzero(open_)
                items = np.concatenate([sets[i] for i in rest])
                owners = np.repeat(rest, size[rest])
                order = np.argsort(items, kind="stable")
                items, owners = items[order], owners[order]
                index_size = left
            low = np.searchsorted(items, sets[x], side="left")
            high = np.searchsorted(items, sets[x], side="right")
            shared = np.bincount(owners[runs(low, high - low)], minlength=m)
            hit = np.flatnonzero(open_ & (shared * (100 + percent) >= percent * (size + size[x])))
            if len(hit):
                open_[hit] = False
                left -= len(hit)
                a.append(classes[hit])
                b.append(np.full(len(hit), classes[x]))
                queue.extend(hit.tolist())
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def release_shuffles(spark) -> None:
    """Spark deletes the shuffle files of finished jobs once the driver has
    collected the objects that stood for them; the scans leave three times the
    input behind, so that is asked for here and not left to chance."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                       percent: int = PERCENT, group_sets: int = GROUP_SETS, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``row_key`` (hash of id and text),
    ``n_shingles``, ``class`` (equal for equal sets, null if empty) and
    ``component_id``, the smallest id that links reach."""
    ensure_checkpoint_dir(docs.sparkSession)
    largest = 100 * LARGEST_LIGHT // percent
    rows = shingle_sets(docs, id_col, text_col, size, largest).checkpoint()
    classes = rows.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.min("items").alias("items"))
    little = classes.filter(F.col("n") <= largest)
    light = boundary({r["n"]: r["count"] for r in little.groupBy("n").count().collect()}, percent)
    edges = heavy_links(docs, id_col, text_col, size, percent, light, group_sets, block_bytes)
    if light:
        reach = 100 * light // percent
        edges = edges.unionAll(light_links(little.filter(F.col("n") <= reach), light, percent))
    rooted = components(edges)
    del edges
    release_shuffles(docs.sparkSession)
    joined = classes.select("class", "rep").join(rooted, F.col("class") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "class"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = joined.join(least, "root").select("class", "component_id")
    out = rows.join(label, "class", "left")
    return out.select(
        F.col("id").alias(id_col), "row_key", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows whose id is their component's id, with the columns of ``docs``.
    Of rows that repeat such an id with the same text one stays; rows without
    words all stay."""
    found = jaccard_components(docs, id_col, text_col, **kw)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("row_key").agg(
        F.max(F.col("class").isNull()).alias("empty"))
    whole = docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.struct("*").alias("whole"))
    copy = F.when(F.col("empty"), F.monotonically_increasing_id())
    kept = whole.join(keep, "row_key").withColumn("copy", copy).dropDuplicates(["row_key", "copy"])
    return kept.select(*[F.col("whole")[c].alias(c) for c in docs.columns])
