"""Word-level attention between answers and rubric phrases (K7-K9).

Per (answer, phrase): ``z_ij = k_i . a_j`` (``dp``; ``cos`` divides by the
norms floored at sqrt(1e-7); ``sdp`` by sqrt(dim)); ``U_i = sum_j
softmax_j(z_ij) a_j`` and ``V_j = sum_i softmax_i(z_ij) k_i``; optional
``beta`` gates ``sigmoid(5 * max cos)``; pooled (mean / sum / max) over key
words for ``u`` and answer words for ``v``; merged (concat / mean / ans /
key).  Words without a vector are zero vectors and take part in the
softmax; an answer or phrase with no token gives a zero vector.

Plan: a rubric belongs to an essay set.  Its phrases are packed into blocks
of token-id lists, and an answer meets the blocks of its own set in its task
(blocks of a measured size are broadcast, larger ones joined with a salt).
Answers travel as their capped token-id sequence (V3), never as vectors; the
vector table has at most ``num_words`` rows.

Scores depend on a pair of words alone, so a task works out one ``ScoreTable``
for each block it meets: the scores of every word with a vector (and of one
word without) against every distinct word of the block's phrases.  A block
holds so many phrase words that its table stays under ``TABLE_BYTES``.  What an
answer adds is sparse: the table's rows of its distinct words, weighted with
their counts, in a few small products.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from gradeflow.plans.joins import fits_broadcast, lookup_join

MASK_FLOOR = np.sqrt(1e-7)
TABLE_BYTES = 16 << 20  # one of the (words x phrase words) arrays of a block
HELD_TABLES = 2
TOKENS_HELD = 4 << 20  # of answers that wait for the blocks of their sets
WIDEST_RANGE = 600.0  # scores further apart than this share no common shift of exp
ROWS_PER_BATCH = 20_000  # output rows per Arrow batch
FEATURE_BYTES = 128 << 20  # vectors of the answers that share the tables of their blocks
BATCH_BYTES = 16 << 20  # vectors per Arrow batch


def vector_matrix(vocab: DataFrame, vectors: DataFrame, dim: int, num_words: int) -> np.ndarray:
    """Row i = vector of the word with index i (zero when none), i < num_words."""
    rows = vocab.filter(F.col("index") < num_words).join(vectors, "word").select("index", "vec").collect()
    mat = np.zeros((num_words, dim), dtype="float64")
    for r in rows:
        mat[int(r["index"])] = np.asarray(r["vec"], dtype="float64")
    return mat


def block_tokens(words: int) -> int:
    """Phrase tokens a block may hold for a table over ``words`` words."""
    return max(64, TABLE_BYTES // (8 * max(1, words)))


def phrase_blocks(phrase_seqs: DataFrame, tokens: int, set_col: str = "essay_set") -> DataFrame:
    """``phrase_seqs`` (set, key_id, seq) as (set, block, rubric): phrases of
    one set in key order, about ``tokens`` token ids a block (a longer phrase is
    a block of its own)."""
    ahead = Window.partitionBy(set_col).orderBy("key_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size("seq").cast("long")).over(ahead), F.lit(0))
    placed = phrase_seqs.select(set_col, "key_id", "seq").withColumn("block", F.floor(before / tokens).cast("int"))
    return placed.groupBy(set_col, "block").agg(F.sort_array(F.collect_list(F.struct("key_id", "seq"))).alias("rubric"))


def _with_blocks(answer_seqs: DataFrame, phrase_seqs: DataFrame, words: int, id_col: str, set_col: str):
    """Answers, and the blocks of each set as a broadcast.  Blocks beyond the
    broadcast bound are joined to the answers instead (no broadcast)."""
    answers = answer_seqs.select(id_col, set_col, "seq")
    blocks = phrase_blocks(phrase_seqs, block_tokens(words), set_col).persist()  # measured, then sent or joined
    if not fits_broadcast(blocks):
        return lookup_join(answers, blocks, [set_col], "inner", salt_by=[F.col(id_col)]), None
    held: dict = {}
    for r in blocks.filter(F.col(set_col).isNotNull()).collect():
        held.setdefault(r[set_col], []).append((r["block"], [x.asDict() for x in r["rubric"]]))
    blocks.unpersist()
    return answers, answers.sparkSession.sparkContext.broadcast({k: sorted(v, key=lambda x: x[0]) for k, v in held.items()})


class Words:
    """The words that differ in their scores: those with a vector, in id order,
    and as the last row one word that stands for all without."""

    def __init__(self, emb: np.ndarray):
        has = emb.any(axis=1)
        self.emb = emb
        self.vec = np.vstack([emb[has], np.zeros((1, emb.shape[1]))])
        self.row = np.full(len(emb), has.sum(), dtype="int64")
        self.row[has] = np.arange(has.sum())

    def counted(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a sequence's distinct words and their counts."""
        n = np.bincount(self.row[seq], minlength=0)
        rows = np.flatnonzero(n)
        return rows, n[rows].astype("float64")

    def first(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a sequence's distinct words and their first places."""
        rows, at = np.unique(self.row[seq], return_index=True)
        return rows, at


class ScoreTable:
    """All scores of one block of phrases.  ``z`` is (words, distinct phrase
    words); ``count`` tells how often each phrase holds each of the latter."""

    def __init__(self, words: Words, rubric: list, op: str):
        self.words, self.op = words, op
        self.keys = np.array([r["key_id"] for r in rubric], dtype="int64")
        self.ids = [np.asarray(r["seq"] or [], dtype="int64") for r in rubric]
        self.size = np.array([len(x) for x in self.ids], dtype="int64")
        flat = np.concatenate(self.ids) if len(self.ids) else np.empty(0, "int64")
        self.key_words, place = np.unique(flat, return_inverse=True)
        self.place = np.split(place, np.cumsum(self.size)[:-1])  # each phrase's columns of ``z``
        self.vec = words.emb[self.key_words]
        self.z = _scores(self.vec, words.vec, op) if len(flat) else np.zeros((len(words.vec), 0))
        self.count = np.zeros((len(self.ids), len(self.key_words)))
        np.add.at(self.count, (np.repeat(np.arange(len(self.ids)), self.size), place), 1.0)

    @cached_property
    def weight(self) -> np.ndarray | None:
        """``exp`` of the scores under one shift, or None where their range is
        too wide for that."""
        if not self.z.size or self.z.max() - self.z.min() > WIDEST_RANGE:
            return None
        return np.exp(self.z - self.z.max())

    @cached_property
    def per_phrase(self) -> np.ndarray:
        """(words, phrases): one over the sum of the weights of a phrase's words."""
        total = self.weight @ self.count.T
        return np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)

    @cached_property
    def cosine(self) -> np.ndarray:
        return self.z if self.op == "cos" else _scores(self.vec, self.words.vec, "cos")

    @cached_property
    def phrase_gate(self) -> np.ndarray:
        """(words, phrases): the gate of a word by its nearest word of a phrase."""
        out = np.zeros((len(self.words.vec), len(self.ids)))
        for p, place in enumerate(self.place):
            if len(place):
                out[:, p] = _gate(self.cosine[:, place].max(axis=1))
        return out

    def attend(self, seq: np.ndarray, pool: str, merge: str, beta: bool = False) -> np.ndarray:
        """``f`` of all phrases for one answer, from the distinct words of both."""
        n, dim = len(self.ids), self.vec.shape[1]
        rows, c = self.words.counted(seq)
        if not len(rows) or not self.z.size:
            u = v = np.zeros((n, dim))
        elif self.weight is None:
            plain = self.words.emb
            return np.array([attend(plain[seq], plain[x], self.op, pool, merge, beta)[0] for x in self.ids])
        else:
            e = self.weight[rows]  # (answer words, phrase words)
            toward_answer = 1.0 / (c @ e)  # of each phrase word
            toward_phrase = self.per_phrase[rows]
            if beta:
                toward_answer = toward_answer * _gate(self.cosine[rows].max(axis=0))
                toward_phrase = toward_phrase * self.phrase_gate[rows]
            if pool == "max":
                u, v = self._greatest(e, toward_answer, toward_phrase, rows, c)
            else:
                share = self.count * toward_answer
                if pool == "mean":
                    share = share / np.maximum(self.size, 1)[:, None]
                u = ((share @ e.T) * c) @ self.words.vec[rows]
                over_phrase = toward_phrase * (c / c.sum() if pool == "mean" else c)[:, None]
                v = ((over_phrase.T @ e) * self.count) @ self.vec
        if merge == "concat":
            return np.concatenate([u, v], axis=1)
        if merge == "mean":
            return (u + v) / 2
        return u if merge == "ans" else v

    def _greatest(self, e, toward_answer, toward_phrase, rows, c):
        """Max pooling: what each phrase word sees is worked out once and shared by
        the phrases that hold the word."""
        seen = (e * toward_answer * c[:, None]).T @ self.words.vec[rows]  # (phrase words, dim)
        u, v = np.zeros((2, len(self.ids), self.vec.shape[1]))
        for p, place in enumerate(self.place):
            if len(place):
                u[p] = seen[place].max(axis=0)
                v[p] = ((e[:, place] * toward_phrase[:, p, None]) @ self.vec[place]).max(axis=0)
        return u, v

    @cached_property
    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase word the words by falling score, and whether a word
        shares its score with the next or the one before."""
        order = np.argsort(-self.z, axis=0, kind="stable").T.copy()
        score = np.take_along_axis(self.z.T, order, axis=1)
        same = score[:, 1:] == score[:, :-1]
        tied = np.zeros(order.shape, dtype=bool)
        tied[:, 1:] |= same
        tied[:, :-1] |= same
        return order, tied

    @cached_property
    def flat(self) -> np.ndarray:
        """Phrase words (those without a vector) to which all words score alike."""
        return self.z.max(axis=0) == self.z.min(axis=0)

    def best(self, seq: np.ndarray) -> np.ndarray:
        """For each distinct phrase word the first place of the answer's word
        with the highest score.  Each phrase word goes down its own order of
        the words and stops at the first that the answer holds."""
        rows, first = self.words.first(seq)
        place = np.full(len(self.words.vec), -1, dtype="int64")
        place[rows] = first
        order, tied = self.order
        out = np.where(self.flat, first.min(), -1)
        open_, start, width = np.flatnonzero(~self.flat), 0, 16
        while len(open_):
            at = place[order[open_, start : start + width]]
            hit = at >= 0
            where = hit.argmax(axis=1)
            found = hit[np.arange(len(open_)), where]
            done, w = open_[found], where[found]
            out[done] = at[found, w]
            for i in done[tied[done, start + w]]:
                column = self.z[rows, i]
                out[i] = first[column == column.max()].min()
            open_, start, width = open_[~found], start + width, width * 4
        return out


class _Tables:
    """The tables of the blocks that a task met last."""

    def __init__(self, emb: np.ndarray, op: str):
        self.words, self.op, self.held = Words(emb), op, {}

    def table(self, name, rubric) -> ScoreTable:
        if name not in self.held:
            if len(self.held) >= HELD_TABLES:
                del self.held[next(iter(self.held))]
            self.held[name] = ScoreTable(self.words, rubric, self.op)
        return self.held[name]

    def rows(self, batch, set_col: str):
        """(table, row number) of a batch's rows, block after block."""
        names = list(zip(batch.column(set_col).to_pylist(), batch.column("block").to_pylist()))
        for i in sorted(range(len(names)), key=lambda i: names[i]):
            yield self.table(names[i], batch.column("rubric")[i].as_py() if names[i] not in self.held else None), i

    def answers(self, batches, id_col: str, set_col: str, blocks: dict | None):
        """(table, set, block, id, sequence) of all answers and blocks of their
        sets.  Answers are held back, so that a table serves many of them."""
        if blocks is None:
            for batch in batches:
                for table, i in self.rows(batch, set_col):
                    yield table, batch.column(set_col)[i].as_py(), batch.column("block")[i].as_py(), batch.column(id_col)[i].as_py(), _sequence(batch, i)
            return
        waiting, n = {}, 0
        for batch in batches:
            ids, sets = batch.column(id_col).to_pylist(), batch.column(set_col).to_pylist()
            for i, name in enumerate(sets):
                if name in blocks:
                    seq = _sequence(batch, i).astype("int32")
                    waiting.setdefault(name, []).append((ids[i], seq))
                    n += len(seq) + 1
                if n >= TOKENS_HELD:
                    yield from self._meet(waiting, blocks)
                    waiting, n = {}, 0
        yield from self._meet(waiting, blocks)

    def _meet(self, waiting: dict, blocks: dict):
        for name in sorted(waiting):
            for block, rubric in blocks[name]:
                table = self.table((name, block), rubric)
                for key, seq in waiting[name]:
                    yield table, name, block, key, seq


def _sequence(batch, i):
    return _ids(batch.column("seq")[i])


def _ids(seq):
    return seq.values.to_numpy(zero_copy_only=False).astype("int64") if seq.is_valid else np.empty(0, "int64")


def _scores(A, K, op):
    z = K @ A.T  # (n_key, n_ans)
    if op == "cos":
        nk = np.maximum(np.linalg.norm(K, axis=1), MASK_FLOOR)
        na = np.maximum(np.linalg.norm(A, axis=1), MASK_FLOOR)
        return z / nk[:, None] / na[None, :]
    if op == "sdp":
        return z / np.sqrt(A.shape[1])
    return z


def _gate(nearest):
    return 1 / (1 + np.exp(-5 * nearest))


def _softmax(x, axis):
    m = x.max(axis=axis, keepdims=True)
    e = np.exp(x - m)
    return e / e.sum(axis=axis, keepdims=True)


def _pool(x, how):
    if x.shape[0] == 0:
        return np.zeros(x.shape[1])
    if how == "sum":
        return x.sum(axis=0)
    if how == "max":
        return x.max(axis=0)
    return x.mean(axis=0)


def attend(A, K, op="dp", pool="mean", merge="concat", beta=False):
    """One answer matrix A (n_ans, d) against one phrase matrix K (n_key, d).
    Returns (f, z) with z the (n_key, n_ans) scores used for K9."""
    d = A.shape[1] if A.ndim == 2 else K.shape[1]
    if A.shape[0] == 0 or K.shape[0] == 0:
        zero = np.zeros(d)
        f = {"concat": np.concatenate([zero, zero])}.get(merge, zero)
        return f, np.zeros((K.shape[0], A.shape[0]))
    z = _scores(A, K, op)
    U = _softmax(z, axis=1) @ A  # key word i attends over answer words
    V = _softmax(z, axis=0).T @ K  # answer word j attends over key words
    if beta:
        c = _scores(A, K, "cos")
        U = U * _gate(c.max(axis=1))[:, None]
        V = V * _gate(c.max(axis=0))[:, None]
    u, v = _pool(U, pool), _pool(V, pool)
    if merge == "concat":
        f = np.concatenate([u, v])
    elif merge == "mean":
        f = (u + v) / 2
    elif merge == "ans":
        f = u
    else:
        f = v
    return f, z


def keyword_attention(
    answer_seqs: DataFrame,
    phrase_seqs: DataFrame,
    vocab: DataFrame,
    vectors: DataFrame,
    dim: int,
    num_words: int = 10000,
    op: str = "dp",
    pool: str = "mean",
    merge: str = "concat",
    beta: bool = False,
    id_col: str = "essay_id",
    set_col: str = "essay_set",
    decimals: int | None = None,
) -> DataFrame:
    """K7: one row per answer and phrase of its set, with the merged vector
    ``f``, rounded to ``decimals`` places where that is given."""
    matrix = vector_matrix(vocab, vectors, dim, num_words)
    shared = answer_seqs.sparkSession.sparkContext.broadcast(matrix)
    width = (2 if merge == "concat" else 1) * dim
    batch_rows = ROWS_PER_BATCH

    def emit(ids, keys, blocks):
        flat = np.concatenate([x.reshape(-1) for x in blocks])
        if decimals is not None:
            flat = np.round(flat, decimals) + 0.0  # no negative zero
        sizes = [len(k) for k in keys]
        offsets = pa.array(np.arange(0, sum(sizes) * width + 1, width, dtype="int32"))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(ids, dtype="int64"), sizes)), pa.array(np.concatenate(keys)),
             pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[id_col, "key_id", "f"])

    def run(batches):
        tables = _Tables(shared.value, op)
        ids, keys, blocks, n = [], [], [], 0
        for table, _, _, key, seq in tables.answers(batches, id_col, set_col, rubrics and rubrics.value):
            out = table.attend(seq, pool, merge, beta)
            ids.append(key)
            keys.append(table.keys)
            blocks.append(out)
            n += len(table.keys)
            if n >= batch_rows:
                yield emit(ids, keys, blocks)
                ids, keys, blocks, n = [], [], [], 0
        if n:
            yield emit(ids, keys, blocks)

    met, rubrics = _with_blocks(answer_seqs, phrase_seqs, len(np.flatnonzero(matrix.any(axis=1))) + 1, id_col, set_col)
    return met.mapInArrow(run, f"{id_col} long, key_id long, f array<double>")


def keyword_features(att: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """K8: per answer the vectors of its set's phrases concatenated in key
    order (length 2*dim*k for concat, k the phrases of the set's rubric)."""
    g = att.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("key_id", "f"))).alias("_kf"))
    return g.select(id_col, F.flatten(F.col("_kf.f")).alias("keyword_features"))


def answer_features(
    answer_seqs: DataFrame,
    phrase_seqs: DataFrame,
    vocab: DataFrame,
    vectors: DataFrame,
    dim: int,
    num_words: int = 10000,
    op: str = "dp",
    pool: str = "mean",
    merge: str = "concat",
    beta: bool = False,
    id_col: str = "essay_id",
    set_col: str = "essay_set",
    decimals: int | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """``keyword_features`` of ``keyword_attention`` without moving a vector: the
    token ids of an answer are brought together, the vectors of all its phrases are
    worked out in one place.  With ``rows`` (id, ...) these come back with the
    column ``keyword_features``, null where an answer has no phrase.  A rubric
    beyond the broadcast bound goes the long way over ``keyword_attention``."""
    matrix = vector_matrix(vocab, vectors, dim, num_words)
    met, rubrics = _with_blocks(answer_seqs, phrase_seqs, len(np.flatnonzero(matrix.any(axis=1))) + 1, id_col, set_col)
    if rubrics is None:
        att = keyword_attention(answer_seqs, phrase_seqs, vocab, vectors, dim, num_words, op, pool, merge, beta, id_col, set_col, decimals)
        return keyword_features(att, id_col) if rows is None else rows.join(keyword_features(att, id_col), id_col, "left")
    shared = answer_seqs.sparkSession.sparkContext.broadcast(matrix)
    width = (2 if merge == "concat" else 1) * dim
    feature_bytes, batch_bytes, every_row = FEATURE_BYTES, BATCH_BYTES, rows is not None
    held = met.groupBy(id_col).agg(F.collect_list(F.struct(F.col(set_col).alias("name"), F.col("seq"))).alias("_held"))
    source = rows.join(held, id_col, "left") if every_row else held

    def run(batches):
        tables, blocks = _Tables(shared.value, op), rubrics.value
        keys = {name: np.array([r["key_id"] for _, rubric in b for r in rubric], dtype="int64") for name, b in blocks.items()}

        def filled(names, seqs, starts, flat):
            """Writes the vectors of all sequences to their places, block after block."""
            met = {}
            for i, name in enumerate(names):
                if name in keys:
                    met.setdefault(name, []).append(i)
            for name in sorted(met):
                ahead = 0
                for block, rubric in blocks[name]:
                    table = tables.table((name, block), rubric)
                    for i in met[name]:
                        out = table.attend(_ids(seqs[i]), pool, merge, beta)
                        flat[starts[i] + ahead : starts[i] + ahead + len(out)] = out if decimals is None else np.round(out, decimals) + 0.0
                    ahead += len(rubric)

        for batch in batches:
            lists = batch.column("_held")
            entries, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            names, seqs = entries.field(0).to_pylist(), entries.field(1)
            phrases = np.array([len(keys.get(name, ())) for name in names], dtype="int64")
            of_row = np.bincount(row, phrases, minlength=len(lists)).astype("int64")
            part = np.cumsum(of_row) * width * 8 // feature_bytes
            for a, b in _runs(part):
                first, last = np.searchsorted(row, [a, b])
                ends = np.cumsum(of_row[a:b])
                flat = np.empty((int(ends[-1]), width))
                starts = np.cumsum(phrases[first:last]) - phrases[first:last]
                filled(names[first:last], seqs[first:last], starts, flat)
                for i in range(a, b):  # in key order, as one list of an answer that is there more than once
                    e0, e1 = np.searchsorted(row, [i, i + 1])
                    k = np.concatenate([keys[n] for n in names[e0:e1] if n in keys] or [np.empty(0, "int64")])
                    if (k[1:] <= k[:-1]).any():
                        mine = flat[ends[i - a] - len(k) : ends[i - a]]
                        mine[:] = mine[np.lexsort((*mine.T[::-1], k))]
                offsets = pa.array(np.r_[0, ends * width].astype("int32"), mask=np.r_[of_row[a:b] == 0, False])
                out = batch.slice(a, b - a).drop_columns(["_held"])
                out = pa.RecordBatch.from_arrays([*out.columns, pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=[*out.schema.names, "keyword_features"])
                for c, d in _runs(ends * width * 8 // batch_bytes):
                    some = out.slice(c, d - c)
                    yield some if every_row else some.filter(pc.is_valid(some.column("keyword_features")))

    fields = [f for f in source.schema.fields if f.name != "_held"]
    return source.mapInArrow(run, T_.StructType([*fields, T_.StructField("keyword_features", T_.ArrayType(T_.DoubleType()))]))


@dataclass
class KeywordBlock:
    """The vectors of ``answer_features`` for whoever joins them: ``ids`` of the answers
    that have a phrase, and ``beside(rows)``, rows (id, ...) with their vectors."""

    ids: DataFrame
    beside: Callable[[DataFrame], DataFrame]


def keyword_block(answer_seqs: DataFrame, phrase_seqs: DataFrame, vocab: DataFrame, vectors: DataFrame, dim: int, num_words: int = 10000,
                  id_col: str = "essay_id", set_col: str = "essay_set", **options) -> KeywordBlock:
    sets = phrase_seqs.select(set_col).distinct()
    ids = lookup_join(answer_seqs.select(id_col, set_col), sets, [set_col], "left_semi").select(id_col)

    def beside(rows: DataFrame) -> DataFrame:
        return answer_features(answer_seqs, phrase_seqs, vocab, vectors, dim, num_words, id_col=id_col, set_col=set_col, rows=rows, **options)

    return KeywordBlock(ids, beside)


def _runs(part: np.ndarray):
    """(start, end) of the runs of equal numbers."""
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
    return zip(cuts, np.r_[cuts[1:], len(part)])


def attention_top_words(
    answer_seqs: DataFrame,
    phrase_seqs: DataFrame,
    vocab: DataFrame,
    vectors: DataFrame,
    dim: int,
    num_words: int = 10000,
    op: str = "dp",
    id_col: str = "essay_id",
    set_col: str = "essay_set",
) -> DataFrame:
    """K9: per answer, phrase of its set and key-word position, the answer
    position the key word attends to most (lowest position on ties) and its
    word id."""
    matrix = vector_matrix(vocab, vectors, dim, num_words)
    shared = answer_seqs.sparkSession.sparkContext.broadcast(matrix)
    names = [id_col, "key_id", "kpos", "apos", "word_id"]
    types = ["int64", "int64", "int32", "int32", "int32"]
    batch_rows = ROWS_PER_BATCH

    def emit(parts):
        cols = [np.concatenate(x).astype(t) for x, t in zip(zip(*parts), types)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def run(batches):
        tables = _Tables(shared.value, op)
        parts, n = [], 0
        for table, _, _, key, seq in tables.answers(batches, id_col, set_col, rubrics and rubrics.value):
            if not len(seq) or not table.size.any():
                continue
            best = table.best(seq)[np.concatenate(table.place)]
            m = len(best)
            essay = np.full(m, key, dtype="int64")
            starts = np.cumsum(table.size) - table.size
            parts.append((essay, np.repeat(table.keys, table.size), np.arange(m) - np.repeat(starts, table.size), best, seq[best]))
            n += m
            if n >= batch_rows:
                yield emit(parts)
                parts, n = [], 0
        if parts:
            yield emit(parts)

    met, rubrics = _with_blocks(answer_seqs, phrase_seqs, len(np.flatnonzero(matrix.any(axis=1))) + 1, id_col, set_col)
    return met.mapInArrow(run, f"{id_col} long, key_id long, kpos int, apos int, word_id int")
