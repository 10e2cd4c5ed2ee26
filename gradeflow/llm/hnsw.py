"""Operator 1, approximate nearest neighbours: a hierarchical navigable
small-world graph per shard.

Equal vectors are one node that keeps its smallest ids, so copies neither clog
the graph nor a task; each batch merges its own copies before the shuffle.
Nodes are dealt to shards of about ``shard_rows`` by a hash of the vector.  A
shard's graph is a row of flat arrays: the vectors, the ids, and for each layer
its nodes and a neighbour matrix padded with -1.

Graphs are built in batches.  The nodes of a batch search the graph so far and
each other, choose diverse neighbours (a candidate is passed over while a
chosen neighbour is nearer to it than the node is) and are linked back; lists
that overflow are chosen anew.  All nodes or queries of a batch advance
together in numpy.

A search reads query blocks against every shard: queries and shards meet by an
equi-join on the shard, one block and one graph at a time.  Cosines of the
nodes found are computed again in double precision from the original vectors,
and the shards' results are merged by cosine, then id.

Cases.  Vectors that are null, zero, or hold a null or non-finite component
take no part.  Vectors of different lengths are never compared.  A row with a
null id is no query and no candidate.  Repeated ids count once among the
results of a query.  Fewer than ``k`` candidates: all that were found.  Other
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.session import ensure_checkpoint_dir

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 128
BATCH = 256

GRAPH = "dim int, shard long, nodes int, vectors binary, ids binary, layers int, members array<binary>, links array<binary>"


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 4):
    """Best-first search of one layer for all queries at once.  ``entry`` has a
    row of start nodes per query.  Returns nodes and similarities, best first
    (-1 and -inf where there are fewer than ``ef``)."""
    n_q = len(q)
    seen = np.zeros((n_q, len(v)), dtype=bool)
    rows = np.arange(n_q)[:, None]
    ef = max(ef, entry.shape[1])
    node = np.full((n_q, ef), -1, dtype=np.int64)
    near = np.full((n_q, ef), -np.inf, dtype=np.float32)
    opened = np.zeros((n_q, ef), dtype=bool)
    width = entry.shape[1]
    node[:, :width] = entry
    near[:, :width] = np.einsum("qed,qd->qe", v[entry], q)
    near[:, :width][entry < 0] = -np.inf
    seen[rows, np.maximum(entry, 0)] = True
    step = min(step, ef)
    live = np.arange(n_q)
    while len(live):
        waiting = np.where(opened[live] | (node[live] < 0), -np.inf, near[live])
        pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        fine = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        keep = fine.any(axis=1)
        live, pick, fine = live[keep], pick[keep], fine[keep]
        if not len(live):
            break
        at = live[:, None]
        opened[at, pick] = True
        out = links[node[at, pick]]
        out[~fine] = -1
        out = np.sort(out.reshape(len(live), -1), axis=1)
        ok = out >= 0
        ok[:, 1:] &= out[:, 1:] != out[:, :-1]
        safe = np.where(ok, out, 0)
        ok &= ~seen[at, safe]
        seen[np.broadcast_to(at, out.shape)[ok], out[ok]] = True
        used = int(ok.sum(axis=1).max())
        if not used:
            continue
        first = np.argsort(~ok, axis=1, kind="stable")[:, :used]
        safe, ok = np.take_along_axis(safe, first, axis=1), np.take_along_axis(ok, first, axis=1)
        sims = np.matmul(v[safe], q[live][:, :, None])[:, :, 0]
        sims[~ok] = -np.inf
        all_near = np.concatenate([near[live], sims], axis=1)
        all_node = np.concatenate([node[live], np.where(ok, safe, -1)], axis=1)
        all_open = np.concatenate([opened[live], np.zeros(sims.shape, dtype=bool)], axis=1)
        best = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
        near[live] = np.take_along_axis(all_near, best, axis=1)
        node[live] = np.take_along_axis(all_node, best, axis=1)
        opened[live] = np.take_along_axis(all_open, best, axis=1)
    order = np.argsort(-near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, axis=1)
    return np.where(np.isneginf(near), -1, np.take_along_axis(node, order, axis=1)), near


def diverse(v: np.ndarray, base: np.ndarray, cand: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` neighbours for each node of ``base`` from its candidates
    (best first).  Places left over go to the nearest ones passed over."""
    n, c = cand.shape
    safe = np.maximum(cand, 0)
    among = np.matmul(v[safe], v[safe].transpose(0, 2, 1))
    taken = np.zeros((n, c), dtype=bool)
    closest = np.full((n, c), -np.inf, dtype=np.float32)
    count = np.zeros(n, dtype=np.int64)
    valid = cand >= 0
    for j in range(c):
        yes = valid[:, j] & (count < m) & (closest[:, j] < near[:, j])
        taken[:, j] = yes
        count += yes
        closest[yes] = np.maximum(closest[yes], among[yes, j])
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.where(np.take_along_axis(valid, order, axis=1), np.take_along_axis(cand, order, axis=1), -1)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """``links[l]`` is the neighbour matrix of layer l, a row for every node."""

    def __init__(self, v: np.ndarray, m: int = LINKS, ef: int = EF_BUILD, seed: int = 11):
        n = len(v)
        self.v = v
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(m)).astype(int)
        order = np.argsort(-level, kind="stable")  # a layer's nodes come before those that lack it
        self.level = level
        self.links = [np.full((n, 2 * m if lay == 0 else m), -1, dtype=np.int64) for lay in range(level.max() + 1)]
        self.top = int(order[0])
        at = 1
        while at < n:
            batch = order[at : at + max(1, min(BATCH, at))]
            # nodes of one batch share their highest layer
            batch = batch[level[batch] == level[batch[0]]]
            self._insert(batch, m, ef)
            at += len(batch)

    def _insert(self, batch: np.ndarray, m: int, ef: int):
        q = self.v[batch]
        entry = np.full((len(batch), 1), self.top)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        for lay in range(len(self.links) - 1, -1, -1):
            links = self.links[lay]
            if lay > self.level[batch[0]]:
                entry = beam(self.v, links, q, entry, 1, 1)[0]
                continue
            node, near = beam(self.v, links, q, entry, ef)
            entry = node[:, :1].copy()
            k = min(m, len(batch) - 1)
            if k:
                mates = np.argpartition(-own, k - 1, axis=1)[:, :k]
                node = np.concatenate([node, batch[mates]], axis=1)
                near = np.concatenate([near, np.take_along_axis(own, mates, axis=1)], axis=1)
                best = np.argsort(-near, axis=1, kind="stable")[:, :ef]
                node, near = np.take_along_axis(node, best, axis=1), np.take_along_axis(near, best, axis=1)
            chosen = diverse(self.v, batch, node, near, m)
            links[batch, :m] = chosen
            self._link_back(links, np.repeat(batch, m), chosen.ravel())

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray):
        fine = target >= 0
        source, target = source[fine], target[fine]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        cand = np.sort(np.concatenate([links[nodes], extra], axis=1), axis=1)[:, ::-1]
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == nodes[:, None]] = -1
        near = np.matmul(self.v[np.maximum(cand, 0)], self.v[nodes][:, :, None])[:, :, 0]
        near[cand < 0] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, best, axis=1), np.take_along_axis(near, best, axis=1)
        width = links.shape[1]
        full = (cand >= 0).sum(axis=1) > width
        links[nodes[~full]] = cand[~full][:, :width] if cand.shape[1] >= width else np.pad(
            cand[~full], ((0, 0), (0, width - cand.shape[1])), constant_values=-1)
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) >> 8)):
            if len(part):
                used = int((cand[part] >= 0).sum(axis=1).max())
                links[nodes[part]] = diverse(self.v, nodes[part], cand[part, :used], near[part, :used], width)

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        return search(self.v, self.links, self.top, q, ef)


def search(v, links, top, q, ef):
    entry = np.full((len(q), 1), top)
    for layer in links[:0:-1]:
        entry = beam(v, layer, q, entry, 1, 1)[0]
    return beam(v, links[0], q, entry, ef)[0]


def usable(vec: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _merge_copies(v: np.ndarray, ids: np.ndarray, keep: int):
    """Distinct rows of ``v`` with the ``keep`` smallest of their ids (-1 is none)."""
    raw = np.ascontiguousarray(v).view([("", v.dtype)] * v.shape[1]).ravel()
    _, first, place = np.unique(raw, return_index=True, return_inverse=True)
    flat, owner = ids.ravel(), np.repeat(place, ids.shape[1])
    none = np.iinfo(np.int64).max
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    fresh &= flat != none
    flat, owner = flat[fresh], owner[fresh]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.full((len(first), keep), none, dtype=np.int64)
    some = rank < keep
    out[owner[some], rank[some]] = flat[some]
    return v[first], out


def build_index(table: DataFrame, id_col: str, vec_col: str, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length, as in ``GRAPH``, checkpointed."""
    ensure_checkpoint_dir(table.sparkSession)
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("shard"), "id", "vec")

    def merge_batches(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                shard = part["shard"].to_numpy()
                v, ids = _merge_copies(np.column_stack([_matrix(part["vec"], dim), shard.view(np.float64)]),
                                       part["id"].to_numpy().reshape(-1, 1), keep)
                # the shard travels as a last component, bit by bit
                where = np.ascontiguousarray(v[:, -1]).view(np.int64)
                for s in np.unique(where).tolist():
                    mine = where == s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([s], pa.int64()), pa.array([v[mine, :-1].tobytes()], pa.binary()),
                         pa.array([ids[mine].tobytes()], pa.binary())], ["dim", "shard", "vectors", "ids"])

    def build(part: pa.Table) -> pa.Table:
        dim, shard = part["dim"][0].as_py(), part["shard"][0].as_py()
        v = np.concatenate([np.frombuffer(b).reshape(-1, dim) for b in part["vectors"].to_pylist()])
        ids = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(-1, keep) for b in part["ids"].to_pylist()])
        v, ids = _merge_copies(v, ids, keep)
        graph = Graph(unit(v))
        members = [np.flatnonzero((x >= 0).any(axis=1) | (np.arange(len(v)) == graph.top)) for x in graph.links]
        row = {"dim": dim, "shard": shard, "nodes": len(v), "vectors": v.tobytes(), "ids": ids.tobytes(), "layers": len(graph.links),
               "members": [np.r_[graph.top, x].astype(np.int32).tobytes() for x in members],
               "links": [x[y].astype(np.int32).tobytes() for x, y in zip(graph.links, members)]}
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("dim", pa.int32()), ("shard", pa.int64()), ("nodes", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()),
            ("layers", pa.int32()), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    merged = dealt.mapInArrow(merge_batches, "dim int, shard long, vectors binary, ids binary")
    return merged.groupBy("dim", "shard").applyInArrow(build, GRAPH).checkpoint()


def nearest(queries: DataFrame, index: DataFrame, id_col: str, vec_col: str, k: int, ef: int = EF_SEARCH,
            block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query,
    without the row of its own id.  ``index`` keeps at least k + 1 ids a node."""
    vec = F.col(vec_col).cast("array<double>")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    blocks = max(1, math.ceil(asked.count() / block_queries))
    dealt = asked.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "vec")

    def pack(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        return pa.table([pa.array([dim], pa.int32()), pa.array([_matrix(part["vec"], dim).tobytes()], pa.binary()),
                         pa.array([part["id"].to_numpy().tobytes()], pa.binary())], names=["dim", "asked", "asked_ids"])

    packed = dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, asked binary, asked_ids binary")
    # each block asks every shard; a pair meets its shard by both keys, so the pairs are spread over all tasks.
    # Spark's estimate leaves out that a block is repeated for every shard, so without the hint it sends the pairs through the driver
    last = index.agg(F.max("shard").alias("s")).first()["s"]
    every = F.sequence(F.lit(0).cast("long"), F.lit(last if last is not None else 0).cast("long"))
    pairs = packed.withColumn("shard", F.explode(every)).hint("merge").join(index, ["dim", "shard"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = _search_shard(row, k, ef)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_shard(row: dict, k: int, ef: int):
    dim, n = row["dim"], row["nodes"]
    v = np.frombuffer(row["vectors"]).reshape(n, dim)
    ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(n, -1)
    links, top = [], 0
    for m, x in zip(row["members"], row["links"]):
        m = np.frombuffer(m, dtype=np.int32)
        top, m = int(m[0]), m[1:]
        x = np.frombuffer(x, dtype=np.int32).reshape(len(m), -1)
        full = np.full((n, x.shape[1]), -1, dtype=np.int64)
        full[m] = x
        links.append(full)
    q = np.frombuffer(row["asked"]).reshape(-1, dim)
    q_id = np.frombuffer(row["asked_ids"], dtype=np.int64)
    node = search(unit(v), links, top, unit(q), ef)
    some = node >= 0
    at = np.repeat(np.arange(len(q)), some.sum(axis=1))
    node = node[some]
    score = cosine(q[at], v[node])
    none = np.iinfo(np.int64).max
    each = ids[node]
    at, score, vec = (np.repeat(x, each.shape[1]) for x in (at, score, np.zeros(len(node))))
    vec = each.ravel()
    fine = (vec != none) & (vec != q_id[at])
    at, score, vec = at[fine], score[fine], vec[fine]
    order = np.lexsort((vec, -score, at))
    at, score, vec = at[order], score[order], vec[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return q_id[at[first]], vec[first], score[first]


def self_search(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``, candidates all rows."""
    index = build_index(table, id_col, vec_col, k + 1, shard_rows)
    return nearest(table.filter(F.col(id_col) % every == 0), index, id_col, vec_col, k, ef)
