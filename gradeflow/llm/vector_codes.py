"""Operator 13, vector code compression: product codes learned by Lloyd's rounds
with two trees.

A vector of integers floor(``SCALE`` * x) is cut into ``PARTS`` equal
consecutive parts.  Each part position has a codebook of ``ENTRIES`` entries.  A
round assigns every part to its nearest entry (squared distance, ties to the
lower index) and moves each entry to the floored mean of its parts; an entry
without parts stays.  The codebooks start as the parts of the rows with the
smallest ids.

Rows are dealt to blocks once.  In a block every part position has a tree: the
parts are ordered so that each node of a level is a run of them, split at the
median of its widest component; the block keeps each node's bounding box and the
sum and count of its parts.  The entries of a codebook get such a tree in every
round.  A round descends both trees together with the pairs (node of parts, node
of entries) that are left.  A pair is pruned if the least distance between its
boxes is larger than the smallest of the largest distances of the same node of
parts to any pair's node of entries.  Where a node of parts keeps one entry, the
whole node is assigned by its cached sum and count.  What is left at the leaves
is decided by the integer distances of the parts to the entries left.  All
arithmetic is on integers, so the results do not depend on how rows are dealt.

A round sends at most one sum and count per entry and task; the codebooks (at
most ``PARTS * ENTRIES`` entries) are all that the driver holds.

Cases.  Rows whose vector is null, empty, holds null or non-finite components or
has a length that ``PARTS`` does not divide are left out.  Vectors of different
lengths have codebooks of their own.  Null ids come last in the order of ids,
rows with one id are ordered by their vector; repeated rows are coded each.  Fewer
rows than ``ENTRIES`` give fewer entries.  A component so large that a squared
distance could pass 2**62 raises a ValueError.  Null labels count as one label.  A
sum that does not fit a long is null.  Other columns are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.plans.joins import lookup_join
from gradeflow.session import ensure_checkpoint_dir

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAF = 16
BLOCK_ROWS = 2048
PAIRS = 1 << 16  # distances worked out at a time

BLOCK = "ids array<long>, labels array<string>, place binary, points binary, lows binary, highs binary, sums binary, counts binary"
CODES = "vec_id long, label string, code string, error long"
SUMS = "part int, entry int, n long, total array<long>"
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))]
                   + [(c, pa.binary()) for c in ("place", "points", "lows", "highs", "sums", "counts")])


def usable(vec: Column, parts: int = PARTS) -> Column:
    real = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return (F.size(vec) > 0) & (F.size(vec) % parts == 0) & real


def integers(column, width: int) -> np.ndarray:
    """Integer components of the vectors of an Arrow list column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    value = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, width)
    bound = math.isqrt((1 << 62) // width) // 2
    if len(value) and max(value.max(), -value.min()) > bound:
        raise ValueError(f"a component is beyond +-{bound / SCALE:g}: squared distances would not fit a long")
    return value.astype(np.int64)


class Tree:
    """Levels of nodes over points; level l has 2**l nodes of equal size.
    ``place`` is the order of the points; ``real`` marks those that do not only
    fill up the last nodes (copies of the last point)."""

    def __init__(self, points: np.ndarray, levels: int):
        n, width = points.shape
        self.levels, self.size = levels, math.ceil(n / (1 << levels))
        place = np.arange(self.size << levels)
        for level in range(levels):
            each = points[np.minimum(place, n - 1)].reshape(1 << level, -1, width)
            wide = (each.max(axis=1) - each.min(axis=1)).argmax(axis=1)
            key = np.take_along_axis(each, wide[:, None, None], axis=2)[..., 0]
            order = key.argsort(axis=1, kind="stable") + (np.arange(1 << level) * each.shape[1])[:, None]
            place = place[order.ravel()]
        self.real, self.place = place < n, np.minimum(place, n - 1)
        self.points = points[self.place]

    def _up(self, leaf: np.ndarray, join) -> np.ndarray:
        """Values of the nodes of all levels, the root first."""
        levels = [leaf]
        for _ in range(self.levels):
            levels.append(join(levels[-1][0::2], levels[-1][1::2]))
        return np.concatenate(levels[::-1])

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        each = self.points.reshape(1 << self.levels, self.size, -1)
        return self._up(each.min(axis=1), np.minimum), self._up(each.max(axis=1), np.maximum)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        each = (self.points * self.real[:, None]).reshape(1 << self.levels, self.size, -1)
        return self._up(each.sum(axis=1), np.add), self._up(self.real.reshape(1 << self.levels, -1).sum(axis=1), np.add)


class Book:
    """A codebook and its tree, whose leaves are single entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        tree = Tree(entries, max(0, len(entries) - 1).bit_length())
        self.levels, self.entry, self.real = tree.levels, tree.place, tree.real
        self.low, self.high = tree.boxes()


def _first(node: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, node[1:] != node[:-1]])


def _narrow(low: np.ndarray, high: np.ndarray, width: int) -> type:
    """The smallest integers that hold every squared distance in this range."""
    reach = max(int(high.max()) - int(low.min()), 1)
    return np.int32 if width * reach * reach < 1 << 31 else np.int64


def _prune(node, entry, low, high, e_low, e_high):
    """The pairs whose boxes may hold a part and its nearest entry.  Boxes are
    (component, node)."""
    apart, across = np.empty(len(node), dtype=low.dtype), np.empty(len(node), dtype=low.dtype)
    for s in range(0, len(node), PAIRS):
        part = slice(s, s + PAIRS)
        near, far = np.zeros(len(node[part]), dtype=low.dtype), np.zeros(len(node[part]), dtype=low.dtype)
        for d in range(len(low)):
            up, down = e_high[d, entry[part]] - low[d, node[part]], high[d, node[part]] - e_low[d, entry[part]]
            gap = np.minimum(np.minimum(up, down), 0)
            reach = np.maximum(up, down)
            near += gap * gap
            far += reach * reach
        apart[part], across[part] = near, far
    first = _first(node)
    bound = np.repeat(np.minimum.reduceat(across, first), np.diff(np.r_[first, len(node)]))
    left = apart <= bound
    return node[left], entry[left]


def _leaves(points, node, entry, size, entries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, nearest entries) for leaves and the entries left for each;
    ``points`` is (component, place) and ``entries`` (component, entry)."""
    first = _first(node)
    ends = np.r_[first[1:], len(node)]
    step = max(1, PAIRS // size)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, first[i] + step, side="right")))
        a, b = first[i], ends[j - 1]
        at = node[first[i:j], None] * size + np.arange(size)
        place = node[a:b]
        far = np.zeros((b - a, size), dtype=points.dtype)
        for x, c in zip(points, entries):
            diff = x.reshape(-1, size)[place] - c[entry[a:b], None]
            diff *= diff
            far += diff
        runs, many = first[i:j] - a, ends[i:j] - first[i:j]
        best = np.repeat(np.minimum.reduceat(far, runs, axis=0), many, axis=0)
        winner = np.minimum.reduceat(np.where(far == best, entry[a:b, None], entries.shape[1]), runs, axis=0)
        yield at.ravel(), winner.ravel()
        i = j


def assign(tree: dict, book: Book, codes: np.ndarray | None = None):
    """Sums and counts of each entry's parts, by a joint descent of the tree of
    a block's parts and that of ``book``.  ``codes``, if given, is filled with
    the entry of each place.  Also returns how many parts whole nodes settled."""
    points, low, high, total, count, real = (tree[c] for c in ("points", "low", "high", "total", "count", "real"))
    levels = len(count).bit_length() - 1
    size = len(points) >> levels
    sums, counts = np.zeros_like(book.entries), np.zeros(len(book.entries), dtype=np.int64)
    kind = _narrow(np.minimum(low[0], book.low[0]), np.maximum(high[0], book.high[0]), low.shape[1])
    turned = lambda x: np.ascontiguousarray(x.T, dtype=kind)
    low, high, e_low, e_high = map(turned, (low, high, book.low, book.high))
    node = entry = np.zeros(1, dtype=np.int64)  # numbers inside their levels; pairs are ordered by node
    level = e_level = whole = 0
    while len(node):
        if e_level == book.levels:
            first = _first(node)
            many = np.diff(np.r_[first, len(node)])
            sure = first[many == 1]
            winner, at = book.entry[entry[sure]], (1 << level) - 1 + node[sure]
            np.add.at(sums, winner, total[at])
            np.add.at(counts, winner, count[at])
            whole += int(count[at].sum())
            if codes is not None:
                codes.reshape(1 << level, -1)[node[sure]] = winner[:, None]
            left = np.repeat(many > 1, many)
            node, entry = node[left], entry[left]
            if level == levels:
                break
        if level < levels:
            level += 1
            first = _first(node) if len(node) else node
            many = np.diff(np.r_[first, len(node)])
            # both children of a node take over its entries
            pick = np.concatenate([np.tile(np.arange(f, f + m), 2) for f, m in zip(first, many)]) if len(node) else node
            child = np.repeat(np.arange(2 * len(first)) % 2, np.repeat(many, 2)) if len(node) else node
            node, entry = node[pick] * 2 + child, entry[pick]
        for _ in range(2):  # entries go down two levels for each level of parts
            if e_level < book.levels:
                e_level += 1
                node, entry = np.repeat(node, 2), (entry[:, None] * 2 + [0, 1]).ravel()
        if e_level == book.levels:
            fine = book.real[entry]
            node, entry = node[fine], entry[fine]
        if len(node):
            box, e_box = slice((1 << level) - 1, (2 << level) - 1), slice((1 << e_level) - 1, (2 << e_level) - 1)
            node, entry = _prune(node, entry, low[:, box], high[:, box], e_low[:, e_box], e_high[:, e_box])
    if len(node):
        for at, winner in _leaves(turned(points), node, book.entry[entry], size, turned(book.entries)):
            if codes is not None:
                codes[at] = winner
            at, winner = at[real[at]], winner[real[at]]
            np.add.at(sums, winner, points[at])
            np.add.at(counts, winner, 1)
    return sums, counts, whole


def _pack(ids: list, labels: list, vectors: np.ndarray, parts: int) -> pa.RecordBatch:
    n, width = vectors.shape
    levels = max(0, (n // LEAF).bit_length() - 1)
    trees = [Tree(np.ascontiguousarray(p), levels) for p in np.split(vectors, parts, axis=1)]
    boxes, totals = [t.boxes() for t in trees], [t.totals() for t in trees]
    cells = [np.concatenate([np.where(t.real, t.place, -1 - t.place) for t in trees]).astype(np.int32), np.concatenate([t.points for t in trees]).astype(np.int32),
             np.concatenate([b[0] for b in boxes]).astype(np.int32), np.concatenate([b[1] for b in boxes]).astype(np.int32),
             np.concatenate([x[0] for x in totals]), np.concatenate([x[1] for x in totals]).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string()))]
                                      + [pa.array([c.tobytes()], pa.binary()) for c in cells], schema=_BLOCK)


def _unpack(row: dict, parts: int, width: int) -> list[dict]:
    """The trees of a block, one for each part position."""
    whole = lambda c, kind, shape: np.frombuffer(row[c], dtype=kind).astype(np.int64).reshape(shape)
    place = whole("place", np.int32, (parts, -1))
    each = {c: whole(k, kind, (parts, -1, width)) for c, k, kind in (("points", "points", np.int32), ("low", "lows", np.int32), ("high", "highs", np.int32), ("total", "sums", np.int64))}
    count = whole("counts", np.int64, (parts, -1))
    return [{"place": np.where(place[p] < 0, -1 - place[p], place[p]), "real": place[p] >= 0, "count": count[p], **{c: x[p] for c, x in each.items()}} for p in range(parts)]


def build_blocks(rows: DataFrame, width: int, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``block_rows`` rows (id, label, vec of ``width``
    components) with the trees of their parts, checkpointed."""

    def run(batches):
        ids, labels, held = [], [], []
        for batch in batches:
            for s in range(0, batch.num_rows, block_rows):
                part = batch.slice(s, block_rows)
                ids += part.column("id").to_pylist()
                labels += part.column("label").to_pylist()
                held.append(integers(part.column("vec"), width))
                if len(ids) >= block_rows:
                    vectors = np.concatenate(held)
                    yield _pack(ids[:block_rows], labels[:block_rows], vectors[:block_rows], parts)
                    ids, labels, held = ids[block_rows:], labels[block_rows:], [vectors[block_rows:]]
        if ids:
            yield _pack(ids, labels, np.concatenate(held), parts)

    return rows.select("id", "label", "vec").mapInArrow(run, BLOCK).checkpoint()


def _block_rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def lloyd(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, an array (part, entry, component), after ``rounds``."""
    parts, k, width = books.shape
    for _ in range(rounds):
        held = [Book(b) for b in books]

        def run(batches):
            sums, counts = np.zeros((parts, k, width), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
            for row in _block_rows(batches):
                for p, tree in enumerate(_unpack(row, parts, width)):
                    s, n, _ = assign(tree, held[p])
                    sums[p] += s
                    counts[p] += n
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
                 pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        moved = blocks.select("points", "place", "lows", "highs", "sums", "counts").mapInArrow(run, SUMS).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
        books = books.copy()
        for r in moved.collect():
            books[r.part, r.entry] = np.array(r.total, dtype=np.int64) // r.n
    return books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row of the blocks."""
    parts, k, width = books.shape
    held = [Book(b) for b in books]

    def run(batches):
        digits = np.array([f"{i:02x}" for i in range(k)], dtype=object)
        for row in _block_rows(batches):
            n = len(row["ids"])
            code, error = np.full(n, "", dtype=object), np.zeros(n, dtype=np.int64)
            for p, tree in enumerate(_unpack(row, parts, width)):
                found = np.empty(len(tree["points"]), dtype=np.int64)
                assign(tree, held[p], found)
                diff = tree["points"] - books[p][found]
                at = tree["place"][tree["real"]]
                far, mine = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
                far[at], mine[at] = (diff * diff).sum(axis=1)[tree["real"]], found[tree["real"]]
                error += far
                code = code + digits[mine]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(code, pa.string()),
                                              pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, CODES)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def first_books(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest ids."""
    order = [F.col("id").asc_nulls_last(), F.col("vec").asc()]
    start = rows.select("id", "vec").orderBy(*order).limit(entries).collect()
    vectors = integers(pa.array([r.vec for r in start], pa.list_(pa.float64())), width)
    return np.stack(np.split(vectors, parts, axis=1))


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vec_id, label, code, error, codebooks_sha256) of every usable row, and
    the codebooks of each length of vectors.  At most 256 ``entries``."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.filter(usable(F.col("vec"), parts))
    lengths = sorted(r.d for r in rows.select(F.size("vec").alias("d")).distinct().collect())
    out, books = spark.createDataFrame([], f"{CODES}, codebooks_sha256 string"), {}
    for length in lengths:
        mine = rows.filter(F.size("vec") == length)
        blocks = build_blocks(mine, length, parts, block_rows)
        books[length] = lloyd(blocks, first_books(mine, length, parts, entries), rounds)
        out = out.unionByName(encode(blocks, books[length]).withColumn("codebooks_sha256", F.lit(books_digest(books[length]))))
    return out, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the sum of the errors of all rows of a label."""
    codes = codes.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit(""))).checkpoint()
    sums = codes.groupBy("_none", "_label").agg(F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long").alias("label_error"))
    return lookup_join(codes, sums, ["_none", "_label"], "left", [F.col("vec_id"), F.col("code")]).drop("_none", "_label")


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) t(p)
), c0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM x WHERE r < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, x, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT * {entries} + e) AS m
  FROM x JOIN c{i} USING (p) GROUP BY r, p, x
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT p, m % {entries} AS e, j, floor(sum(x[j]) / count(*)) AS y FROM a{i}, range(1, len(x) + 1) t(j) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT p, e, list(y ORDER BY j) AS c FROM m{i} GROUP BY p, e) n USING (p, e)
)""")
    return "WITH " + ", ".join(steps) + f""", d AS (
  SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r
), h AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM d JOIN v USING (r), h"""
