"""Operator 3, LM scoring: a gated recurrent language model with a softmax
factored by word class.

P(word | history) = P(class | history) * P(word | class).

*Classes* are a rule on the word itself (``word_classes``: its closing mark and
last letters), so they need no table; the end of a text is a class of its own.
P(class | history) is a softmax over the state of a gated recurrent network.
The state starts at zero with each text and is carried over windows of
``WINDOW`` steps, so the score is that of the whole text.

*Words in a class* have counts over all training texts: a word seen c times has
(c + 1) / (N_k + V_k + 1), where its class has N_k tokens and V_k words; the
words not seen share the rest.  The counts are asked for by blocks of documents
(``blocks``) and grow with the corpus.

*Training* is truncated backpropagation through time in numpy, with the state
carried into the next window.  All training texts fit the recurrent weights: each block
of documents fits a copy in one pass over all tokens of all its texts, and the
copies are averaged with the number of their tokens as weights, ``rounds`` times.
Blocks are dealt by ids and the total size, so the weights do not depend on how
the input is partitioned.  They are a few thousand numbers, whatever the corpus.

Cases.  Null text is empty: one token, the end.  Without training texts all
counts are 0 and the weights stay as they start.  Rows with a null id are never
held out.  Repeated rows count and score like others.  Very long texts are
scored in windows and only need memory for their words.  Other columns are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm import blocks as B
from gradeflow.llm.words import Words, slices
from gradeflow.session import ensure_checkpoint_dir

HIDDEN = 24
FOLDS, HELD_OUT = 7, 2
ROUNDS = 1
RATE = 0.01
WINDOW = 32
LANES = 64
SCORE_LANES = 256
BLOCK_BYTES = 8 << 20

#: Classes by closing mark: none, full stop, comma, another mark.  Then the end.
SIZES = (40, 8, 8, 7)
END = sum(SIZES)
CLASSES = END + 1


def word_classes(words: Words) -> np.ndarray:
    """Class of each word, the same for the same lower-cased word."""
    lower = np.arange(256)
    lower[65:91] += 32
    mark = np.zeros(256, dtype=np.int64)
    mark[33:48] = mark[58:65] = mark[91:97] = mark[123:127] = 3
    mark[ord(".")], mark[ord(",")] = 1, 2
    size = words.end - words.start
    kind = mark[words.data[words.end - 1]] if len(size) else np.empty(0, dtype=np.int64)
    at = words.end - 1 - ((kind > 0) & (size > 1))
    one = lower[words.data[at]] if len(size) else at
    two = np.where(at > words.start, lower[words.data[np.maximum(at - 1, 0)]], 0) if len(size) else at
    three = np.where(at - 1 > words.start, lower[words.data[np.maximum(at - 2, 0)]], 0) if len(size) else at
    code = (one * 0x9E3779B1 + two * 0x85EBCA77 + three * 0xC2B2AE3D) & 0xFFFFFFFF
    code = ((code ^ (code >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 12
    base = np.array([0, *np.cumsum(SIZES)[:-1]])
    return base[kind] + code % np.array(SIZES)[kind]


def token_classes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, each text's end included, and texts' bounds."""
    count = np.diff(words.first)
    bounds = np.r_[0, np.cumsum(count + 1)]
    out = np.full(bounds[-1], END, dtype=np.int64)
    out[np.arange(len(words.doc)) + words.doc] = word_classes(words)
    return out, bounds


def _sigmoid(x):
    """In place; where exp is infinite the result is 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _gate_inputs(x, inputs):
    """Rows of ``x`` for each step, lanes in columns."""
    turned = np.ascontiguousarray(x.T)
    return [np.take(turned, row, axis=1) for row in inputs]


class Network:
    """Weights: ``x`` (class to the gates' inputs), ``u`` (state to gates),
    ``o`` and ``b`` (state to class scores)."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(hidden), s).astype(np.float32)
        self.hidden = hidden
        self.w = [draw(CLASSES, 3 * hidden), draw(hidden, 3 * hidden), draw(hidden, CLASSES) * np.float32(0.1), np.zeros(CLASSES, np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for i, x in enumerate(self.w):
            self.w[i] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return self

    def cell(self, turned, h, a):
        """One step with lanes in columns; ``a`` are the inputs of the gates.
        Returns the new state, z, r, n and what the state adds to n."""
        k = self.hidden
        g = turned @ h
        zr = a[: 2 * k] + g[: 2 * k]
        _sigmoid(zr)
        z, r, g = zr[:k], zr[k:], g[2 * k :]
        n = r * g
        n += a[2 * k :]
        n *= 2  # tanh(x) = 2 sigmoid(2x) - 1, faster than numpy's
        _sigmoid(n)
        n *= 2
        n -= 1
        new = h - n
        new *= z
        new += n
        return new, z, r, n, g

    def step(self, h, cls):
        """One step with lanes in rows; returns the new state."""
        h = h * (cls != END)[:, None]  # a text starts from the zero state
        return (self.cell(self.w[1].T, h.T, self.w[0][cls].T)[0].T,)

    def log_classes(self, h):
        s = h @ self.w[2] + self.w[3]
        s -= s.max(axis=-1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=-1, keepdims=True))
        return s

    def gradients(self, h, inputs, targets):
        """Loss, gradients of one window and the state after it.  A target
        below 0 is padding and counts for nothing."""
        x, u, o, b = self.w
        k, (steps, lanes), kind = self.hidden, inputs.shape, x.dtype
        turned, live = np.ascontiguousarray(u.T), (inputs != END).astype(kind)
        a = _gate_inputs(x, inputs)
        before, states, z, r, n, g = (np.empty((k, steps, lanes), dtype=kind) for _ in range(6))
        last = h.T.astype(kind)
        for t in range(steps):
            old = before[:, t] = last * live[t]
            last, z[:, t], r[:, t], n[:, t], g[:, t] = self.cell(turned, old, a[t])
            states[:, t] = last
        flat = states.reshape(k, -1)
        d = o.T @ flat
        d += b[:, None]
        d -= d.max(axis=0)
        y = targets.ravel()
        at = np.flatnonzero(y >= 0)
        picked = d[y[at], at]
        np.exp(d, out=d)
        total = d.sum(axis=0)
        loss = float((np.log(total[at]) - picked).mean())
        d /= total
        d[y[at], at] -= 1
        d *= ((y >= 0) / len(at)).astype(kind)
        grad_o, grad_b = flat @ d.T, d.sum(axis=1)
        back = (o @ d).reshape(states.shape)
        to_z, to_n, to_r = (before - n) * z * (1 - z), (1 - z) * (1 - n * n), g * r * (1 - r)
        gates = np.empty((3 * k, steps, lanes), dtype=kind)
        sent = np.empty((3 * k, steps, lanes), dtype=kind)
        dg = np.empty((3 * k, lanes), dtype=kind)
        dh = np.zeros((k, lanes), dtype=kind)
        for t in range(steps - 1, -1, -1):
            dh += back[:, t]
            dn = np.multiply(dh, to_n[:, t], out=gates[2 * k :, t])
            np.multiply(dh, to_z[:, t], out=dg[:k])
            np.multiply(dn, to_r[:, t], out=dg[k : 2 * k])
            np.multiply(dn, r[:, t], out=dg[2 * k :])
            sent[:, t] = dg
            dh *= z[:, t]
            dh += u @ dg
            dh *= live[t]
        gates[: 2 * k] = sent[: 2 * k]
        hot = np.zeros((CLASSES, inputs.size), dtype=kind)
        hot[inputs.ravel(), np.arange(inputs.size)] = 1
        grad_u = before.reshape(k, -1) @ sent.reshape(3 * k, -1).T
        return loss, [hot @ gates.reshape(3 * k, -1).T, grad_u, grad_o, grad_b], last.T

    def fit(self, classes: np.ndarray, memory: dict, rate: float = RATE, window: int = WINDOW, lanes: int = LANES) -> float:
        """One pass over a stream of texts, all tokens of it: the last lanes are
        padded.  ``memory`` keeps the optimiser's averages from one call to the
        next.  Returns the mean loss."""
        if not len(classes):
            return float("nan")
        lanes = max(1, min(lanes, len(classes) // window))
        n = -(-len(classes) // lanes)
        grid = np.full(n * lanes, -1, dtype=np.int64)
        grid[: len(classes)] = classes
        grid = grid.reshape(lanes, n).T
        inputs = np.vstack([np.full((1, lanes), END), np.where(grid[:-1] < 0, END, grid[:-1])])
        h = np.zeros((lanes, self.hidden), dtype=np.float32)
        losses = []
        for at in range(0, n, window):
            loss, grads, h = self.gradients(h, inputs[at : at + window], grid[at : at + window])
            losses.append(loss)
            memory["t"] = t = memory.get("t", 0) + 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for i, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m = memory[i, "m"] = 0.9 * memory.get((i, "m"), 0) + 0.1 * g
                v = memory[i, "v"] = 0.99 * memory.get((i, "v"), 0) + 0.01 * g * g
                self.w[i] = (self.w[i] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses))

    def log_probability(self, classes: np.ndarray, bounds: np.ndarray, window: int = WINDOW, lanes: int = SCORE_LANES) -> np.ndarray:
        """Natural log of P(class | history) of every token.  Whole texts are
        dealt to lanes of like length, longest first."""
        size = np.diff(bounds)
        out = np.zeros(len(classes))
        if not len(size):
            return out
        lanes = int(min(len(size), lanes, max(8, len(classes) // int(size.max()))))
        heap = [(0, i) for i in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for doc in np.argsort(-size, kind="stable").tolist():
            load, lane = heapq.heappop(heap)
            held[lane].append(doc)
            heapq.heappush(heap, (load + int(size[doc]), lane))
        length = np.zeros(lanes, dtype=np.int64)
        for load, lane in heap:
            length[lane] = load
        order = np.argsort(-length, kind="stable")
        place = np.full((length.max(), lanes), -1, dtype=np.int64)
        for col, lane in enumerate(order.tolist()):
            place[: length[lane], col] = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in held[lane]])
        live = np.searchsorted(-length[order], -np.arange(length.max()), side="left")  # lanes that are longer than t
        turned, o = np.ascontiguousarray(self.w[1].T), np.ascontiguousarray(self.w[2].T)
        h = np.zeros((self.hidden, lanes), dtype=np.float32)
        last = np.full((1, lanes), END)
        for at in range(0, len(place), window):
            rows = place[at : at + window, : live[at]]
            fine = rows >= 0
            now = np.where(fine, classes[rows], END)
            inputs = np.vstack([last[:, : live[at]], now[:-1]])
            last = now[-1:]
            a = _gate_inputs(self.w[0], inputs)
            begin = (inputs != END).astype(np.float32)
            states = np.zeros((self.hidden, *rows.shape), dtype=np.float32)
            for t in range(len(rows)):
                n = live[at + t]
                h = self.cell(turned, h[:, :n] * begin[t, :n], a[t][:, :n])[0]
                states[:, t, :n] = h
            s = o @ states.reshape(self.hidden, -1)
            s += self.w[3][:, None]
            s -= s.max(axis=0)
            picked = s[now.ravel(), np.arange(now.size)]
            np.exp(s, out=s)
            out[rows[fine]] = (picked - np.log(s.sum(axis=0)))[fine.ravel()]
        return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _round(dealt: DataFrame, start: np.ndarray, rate: float, hidden: int, seed: int) -> DataFrame:
    """(n, w): the tokens of each task and the sum of its blocks' weights, each
    times its tokens, after one pass of every block from the weights ``start``."""

    def train(table):
        table = table.filter(pc.invert(table["held_out"])).sort_by([("id", "ascending"), ("text", "ascending")])
        own, memory, tokens = Network(hidden, seed).load(start), {}, 0
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                classes, _ = token_classes(Words(part.column("text")))
                own.fit(classes, memory, rate)
                tokens += len(classes)
        return pa.table([pa.array([tokens], pa.int64()), pa.array([(own.flat() * tokens).tobytes()], pa.binary())], names=["n", "w"])

    return dealt.groupBy("block").applyInArrow(train, "n long, w binary").mapInArrow(_added, "n long, w binary")


def _added(batches):
    n, w = 0, 0.0
    for batch in batches:
        n += sum(batch.column("n").to_pylist())
        for x in batch.column("w").to_pylist():
            w = w + np.frombuffer(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "w"])


def _average(trained: DataFrame, network: Network) -> Network:
    """``network`` with the mean of the weights: added up in a few tasks, then here."""
    few = math.ceil(math.sqrt(B.partitions(trained)))
    parts = trained.repartition(few).mapInArrow(_added, "n long, w binary").collect()
    n = sum(p["n"] for p in parts)
    return network.load(sum(np.frombuffer(bytes(p["w"])) for p in parts) / n) if n else network


def fit_network(dealt: DataFrame, rounds: int = ROUNDS, hidden: int = HIDDEN, seed: int = 3, done: DataFrame | None = None) -> Network:
    """Recurrent weights from all training texts of ``dealt``, the blocks of
    ``score_texts`` (block, id, text, held_out).  In a round every block makes one
    pass over its texts, in the order of ids, from the weights of the round
    before; the weights of the blocks are averaged by their tokens.  Blocks
    follow the ids and the total size, so the result does not depend on how
    the input is partitioned.  ``done`` is the first round, if it was worked out
    already."""
    network = Network(hidden, seed)
    for r in range(rounds):
        if r or done is None:
            done = _round(dealt, network.flat(), RATE / (1 + 2 * r), hidden, seed)
        network = _average(done, network)
    return network


def _merge_counts(keys, counts, classes):
    key, bounds = B.joined(keys, np.uint64)
    count, _ = B.joined(counts, np.int32)
    cls, _ = B.joined(classes, np.uint8)
    order = np.argsort(key, kind="stable")
    starts = B.group_starts(key[order])
    out, tally = np.empty(len(order), dtype=np.int64), np.zeros((2, CLASSES), dtype=np.int64)
    if len(order):
        total = np.add.reduceat(count[order].astype(np.int64), starts)
        kind = cls[order][starts]
        tally[0] = np.bincount(kind, weights=total, minlength=CLASSES).astype(np.int64)
        tally[1] = np.bincount(kind[total > 0], minlength=CLASSES)
        out[order] = np.repeat(total, np.diff(np.r_[starts, len(order)]))
    return [*B.split(out, bounds), tally]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                rounds: int = ROUNDS, hidden: int = HIDDEN) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 probabilities of the whole text)."""
    ensure_checkpoint_dir(docs.sparkSession)
    bits = B.shard_bits(docs)
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    dealt = B.blocked(thin, "text", ["id", "text"], block_bytes)

    def distinct(table):
        words = Words(table["text"], lower=True)
        keys, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        return words, keys, first, place

    def send(block, table):
        words, keys, first, place = distinct(table)
        train = ~table["held_out"].to_numpy()[words.doc]
        count = np.bincount(place[train], minlength=len(keys)).astype(np.int32)
        return B.ask_rows(block, 1, bits, keys, count, word_classes(words)[first].astype(np.uint8))

    # the first round of the fit shares the shuffle of the counts; its rows are block -2
    first = _round(dealt, Network(hidden).flat(), RATE, hidden, 3)
    trained = first.select(F.lit(-2).cast("long").alias("block"), F.col("n").alias("shard"), F.lit(0).alias("kind"), F.col("w").alias("answer"))
    counts = B.ask(dealt, send, _merge_counts, summary=True).unionByName(trained).checkpoint()
    done = counts.filter(F.col("block") == -2).select(F.col("shard").alias("n"), F.col("answer").alias("w"))
    weights = fit_network(dealt, rounds, hidden, done=done).flat()

    def total(batches):
        tally = np.zeros(2 * CLASSES, dtype=np.int64)
        for batch in batches:
            for x in batch.column("answer").to_pylist():
                tally += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([tally.tobytes()], pa.binary())], ["answer"])

    sums = counts.filter(F.col("block") == -1).select("answer").repartition(4).mapInArrow(total, "answer binary").collect()
    tally = sum((np.frombuffer(bytes(r["answer"]), dtype=np.int64) for r in sums), np.zeros(2 * CLASSES, np.int64)).reshape(2, CLASSES)
    ends = thin.filter(~F.col("held_out")).count()  # an end is a token of its own
    n_train, distinct_train = int(tally[0].sum()) + ends, int(tally[1].sum()) + (ends > 0)
    in_class = np.log10(tally[0] + tally[1] + 1.0)
    base = np.log10(n_train + distinct_train + 1.0)
    end_base, end_known = np.log10(ends + 1.0) - base, int(ends > 0)

    def score(block, table, got):
        if not table.num_rows:
            return pa.table([table["id"], table["held_out"]] + [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        words, keys, _, place = distinct(table)
        seen = np.frombuffer(got.get(1, b""), dtype=np.int64)[place]
        classes, bounds = token_classes(words)
        log_count = np.log10(seen + 1.0)
        at = np.arange(len(words.doc)) + words.doc
        token = Network(hidden).load(weights).log_probability(classes, bounds) / np.log(10)
        token[at] += log_count - in_class[classes[at]]
        n = table.num_rows
        per = lambda w: np.bincount(words.doc, weights=w, minlength=n)
        n_words = np.diff(words.first)
        cols = [table["id"], table["held_out"], pa.array(n_words + 1, pa.int64()), pa.array((per(seen > 0) + end_known).astype(np.int64)),
                pa.array(per(log_count) - n_words * base + end_base), pa.array(np.add.reduceat(token, bounds[:-1]))]
        return pa.table(cols, names=names)

    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = f"id {thin.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = B.with_answers(dealt, counts.filter(F.col("block") >= 0), score, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
