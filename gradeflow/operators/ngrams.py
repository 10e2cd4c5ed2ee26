"""N-grams counted where the texts are read (K5, K6).

``top_ngrams`` finds the best n-grams without shuffling all of them.  Every task
keeps a summary of at most ``keep`` n-grams and of how much it left out of any
other one; summaries add up, and so do these errors, so an n-gram that no summary
holds occurs at most as often as the errors say.  The candidates are then counted
exactly, and the answer stands if the best score that an n-gram outside could
have is below the last of the k best.  Otherwise the summaries are widened.

``presence`` walks a trie of the phrases' token ids with all starts of a batch at
once, one level at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import scan
from gradeflow.plans.joins import fits_broadcast, max_broadcast_bytes

KEEP = 4096
MOST_CANDIDATES = 1 << 20


def _tokens(batch, limit: int = 4 << 20):
    """(first row, dictionary, codes, rows) of the Keras tokens of the lower-cased
    texts of a batch, a few MB at a time."""
    text = batch.column("low")
    for at, n in scan.slices(text, limit):
        s = scan.Scan(text.slice(at, n))
        words, rows = s.tokens(~s.has(scan.KERAS_SEP))
        coded = words.dictionary_encode()
        yield at, n, coded.dictionary, coded.indices.to_numpy().astype("int64"), rows


def _gram_keys(codes: np.ndarray, rows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that lie in one row (codes below ``size``, where one
    is negative the n-gram is left out), and their rows."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, "int64"), np.empty(0, "int64")
    inside = rows[:m] == rows[n - 1 :]
    key = np.zeros(m, dtype="int64")
    for i in range(n):
        key = key * size + codes[i : i + m]
        inside &= codes[i : i + m] >= 0
    return key[inside], rows[:m][inside]


def _summaries(texts: DataFrame, n_max: int, keep: int) -> tuple[DataFrame, int]:
    """(ngram, n) as far as the tasks kept them, and the sum of the errors."""

    def run(batches):
        held: dict[str, int] = {}
        error = 0
        for batch in batches:
            for _, _, words, codes, rows in _tokens(batch):
                size = max(len(words), 2)
                if size**n_max >= 1 << 63:
                    raise ValueError("too many distinct words in a slice")
                for n in range(1, n_max + 1):
                    keys, counts = np.unique(_gram_keys(codes, rows, n, size)[0], return_counts=True)
                    if len(keys) > keep:
                        order = np.argpartition(-counts, keep)
                        error += int(counts[order[keep]])
                        keys, counts = keys[order[:keep]], counts[order[:keep]]
                    parts = [words.take(pa.array(keys // size**i % size)) for i in range(n - 1, -1, -1)]
                    names = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).to_pylist() if n > 1 else parts[0].to_pylist()
                    for g, c in zip(names, counts.tolist()):
                        held[g] = held.get(g, 0) + c
                if len(held) > 4 * n_max * keep:
                    ranked = sorted(held.items(), key=lambda x: -x[1])
                    error += ranked[n_max * keep][1]
                    held = dict(ranked[: n_max * keep])
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), error], pa.int64())], ["ngram", "n"])

    found = texts.mapInArrow(run, "ngram string, n long").groupBy("ngram").agg(F.sum("n").alias("n")).persist()
    return found, found.filter("ngram is null").agg(F.sum("n")).first()[0] or 0


def _exact(texts: DataFrame, grams: list[str], n_max: int) -> DataFrame:
    """(ngram, total, df) of the given n-grams over all texts."""
    split = [g.split(" ") for g in grams]
    vocabulary = pa.array(sorted({w for g in split for w in g}), pa.large_string())
    size = max(len(vocabulary), 2)
    at = {w: i for i, w in enumerate(vocabulary.to_pylist())}
    tables = []
    for n in range(1, n_max + 1):
        mine = [(sum(at[w] * size ** (n - 1 - i) for i, w in enumerate(g)), j) for j, g in enumerate(split) if len(g) == n]
        mine.sort()
        tables.append((np.array([k for k, _ in mine], dtype="int64"), np.array([j for _, j in mine], dtype="int64")))
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, size, tables, grams))

    def run(batches):
        vocabulary, size, tables, grams = shared.value
        total, df = np.zeros(len(grams), dtype="int64"), np.zeros(len(grams), dtype="int64")
        for batch in batches:
            for _, _, words, codes, rows in _tokens(batch):
                known = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy()
                codes = known[codes].astype("int64")
                for n, (keys, which) in enumerate(tables, start=1):
                    if not len(keys):
                        continue
                    key, row = _gram_keys(codes, rows, n, size)
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[place] == key
                    gram, row = which[place[hit]], row[hit]
                    total += np.bincount(gram, minlength=len(grams))
                    df += np.bincount(np.unique(row * len(grams) + gram) % len(grams), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([grams[i] for i in some], pa.string()), pa.array(total[some]), pa.array(df[some])], ["ngram", "total", "df"])

    return texts.mapInArrow(run, "ngram string, total long, df long").groupBy("ngram").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def top_ngrams(df: DataFrame, n_max: int, k: int, text_col: str, keep: int = KEEP) -> DataFrame | None:
    """(ngram, total, score) of the k best n-grams by ``score = total *
    (ln((1 + N) / (1 + df)) + 1)``, or None where the candidates would be too
    many to be sent to the tasks."""
    texts = df.select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    n_docs = df.count()
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    largest = math.log((1 + n_docs) / 2) + 1 if n_docs else 1.0  # an n-gram is in one text at least
    while True:
        found, error = _summaries(texts, n_max, keep)
        named = found.filter("ngram is not null")
        # a score is at least the total, which is at least the sum in the summaries
        low = named.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).first()
        least = low["n"] if low["c"] == k else 0
        candidates = named.filter((F.col("n") + error) * largest >= least).limit(MOST_CANDIDATES + 1)
        grams = [r["ngram"] for r in candidates.collect()]
        found.unpersist()
        if len(grams) > MOST_CANDIDATES or (len({w for g in grams for w in g.split(" ")}) + 2) ** n_max >= 1 << 63:
            return None
        exact = _exact(texts, grams, n_max)
        best = exact.select("ngram", "total", F.round(idf * F.col("total"), 6).alias("score")).orderBy(F.desc("score"), "ngram").limit(k)
        rows = best.collect()
        # what no summary holds occurs at most ``error`` times
        if not error or (len(rows) == k and error * largest < rows[-1]["score"] - 1e-6):
            return df.sparkSession.createDataFrame(rows, "ngram string, total long, score double")
        keep *= 8


class Trie:
    """Phrases as a trie over word ids: ``step`` leads from (node, word) to a
    node; ``ends`` lists the phrases that end in a node."""

    def __init__(self, phrases: list[list[str]]):
        self.words = pa.array(sorted({w for p in phrases for w in p}), pa.large_string())
        at = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.size = max(len(self.words), 1)
        edges: dict[int, int] = {}
        ends: dict[int, list[int]] = {}
        for j, phrase in enumerate(phrases):
            node = 0
            for w in phrase:
                node = edges.setdefault(node * self.size + at[w], len(edges) + 1)
            if phrase:
                ends.setdefault(node, []).append(j)
        keys = np.array(sorted(edges), dtype="int64")
        self.keys, self.to = keys, np.array([edges[x] for x in keys.tolist()], dtype="int64")
        counts = np.array([len(ends.get(i, [])) for i in range(len(edges) + 1)], dtype="int64")
        self.first = np.r_[0, np.cumsum(counts)]
        self.ends = np.array([j for i in sorted(ends) for j in ends[i]], dtype="int64")

    def find(self, words: pa.Array, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase) for every occurrence of a phrase within a row."""
        out = [np.empty((2, 0), dtype="int64")]
        if not len(self.keys) or not len(codes):
            return out[0][0], out[0][1]
        ids = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype("int64")[codes]
        start = np.flatnonzero(ids >= 0)
        node, depth = np.zeros(len(start), dtype="int64"), 0
        while len(start):
            at = start + depth
            fine = at < len(ids)
            fine[fine] = (ids[at[fine]] >= 0) & (rows[at[fine]] == rows[start[fine]])
            start, node, at = start[fine], node[fine], at[fine]
            key = node * self.size + ids[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fine = self.keys[place] == key
            start, node = start[fine], self.to[place[fine]]
            many = self.first[node + 1] - self.first[node]
            hit = np.flatnonzero(many)
            if len(hit):
                n = many[hit]
                item = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[node[hit]], n)
                out.append(np.stack([np.repeat(rows[start[hit]], n), self.ends[item]]))
            depth += 1
        found = np.concatenate(out, axis=1)
        return found[0], found[1]


def presence(df: DataFrame, phrases: DataFrame, id_col: str, text_col: str, set_col: str) -> DataFrame:
    """(id, key_id, present) for every text and phrase (key_id, set, tokens) of
    its set: 1 where the phrase's tokens follow one another in the text's.  One
    pass over the texts for each part of the phrases that fits a broadcast."""
    parts = 1
    while not fits_broadcast(phrases.filter(F.pmod(F.xxhash64("key_id"), F.lit(parts)) == 0), max_broadcast_bytes(df)):
        parts *= 2
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(set_col).alias("set"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    out = None
    for part in range(parts):
        rows = phrases.filter(F.pmod(F.xxhash64("key_id"), F.lit(parts)) == part).select("key_id", F.col(set_col).alias("set"), "tokens").collect()
        one = _presence_of(texts, rows)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("id").alias(id_col), "key_id", "present")


def _presence_of(texts: DataFrame, rows: list) -> DataFrame:
    of_set: dict = {}
    for j, r in enumerate(rows):
        of_set.setdefault(r["set"], []).append(j)
    shared = texts.sparkSession.sparkContext.broadcast(
        (Trie([r["tokens"] or [] for r in rows]), np.array([r["key_id"] for r in rows], dtype="int64"), {s: np.array(x) for s, x in of_set.items() if s is not None}))

    def run(batches):
        trie, keys, of_set = shared.value
        for batch in batches:
            sets, ids = np.array(batch.column("set").to_pylist(), dtype=object), batch.column("id")
            for at, n, words, codes, where in _tokens(batch):
                row, phrase = trie.find(words, codes, where)
                for name in {s for s in sets[at : at + n] if s in of_set}:
                    mine = np.flatnonzero(sets[at : at + n] == name)
                    column = np.full(len(keys), -1)
                    column[of_set[name]] = np.arange(len(of_set[name]))
                    place = np.full(n, -1)
                    place[mine] = np.arange(len(mine))
                    fine = (place[row] >= 0) & (column[phrase] >= 0)
                    table = np.zeros((len(mine), len(of_set[name])), dtype="int32")
                    table[place[row[fine]], column[phrase[fine]]] = 1
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.repeat(mine + at, table.shape[1]))), pa.array(np.tile(keys[of_set[name]], len(mine))), pa.array(table.ravel())],
                        ["id", "key_id", "present"])

    return texts.mapInArrow(run, "id long, key_id long, present int")
