"""Attention weights kept with a result (S10): what each pair of words scores
and how both sides attend, for every essay and phrase of its set.

The weights of one essay and phrase are matrices (key words x answer words), but
they factor.  A score depends on the pair of words alone, so it is stored once for
a block of phrases; the softmax over the key words of a phrase needs one number
for each word and phrase, the softmax over the answer one number for each essay
and key word.  The store holds these factors as nested columns, partitioned by
set:

* ``blocks``: ``words`` (ids; -1 stands for all words without a vector),
  ``key_words``, the phrases with their token ids, and by word ``z`` for each key
  word, ``over_key`` (sum of exp(z) over a phrase's key words) and ``gate_key``
  for each phrase;
* ``essays``: places of the essay's distinct words in ``words``, their counts, and
  for each key word ``over_ans`` (sum of exp(z) over the essay's words) and
  ``gate_ans``.

``exp`` is shifted by the largest score of a block.  ``read_attention`` restores
the matrices of the essays and phrases asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.operators import attention as A
from gradeflow.plans.joins import lookup_join
from gradeflow.session import DICTIONARY_BYTES

BLOCKS = ("block int, words array<int>, key_words array<int>, keys array<long>, seqs array<array<int>>, z array<array<double>>, "
          "over_key array<array<double>>, gate_key array<array<double>>")
ESSAYS = "essay_id long, block int, places array<int>, counts array<int>, over_ans array<double>, gate_ans array<double>"
WEIGHTS = ("essay_id long, key_id long, words array<int>, counts array<int>, z array<array<double>>, z_ans array<array<double>>, "
           "z_key array<array<double>>, beta_ans array<double>, beta_key array<double>")
ESSAYS_PER_COPY = 16_000
ROWS_PER_BATCH = 1000  # essays written at once
SUMS = "essay_id long, key_id long, n_key int, n_words int, z double, z_ans double, z_key double, beta_ans double, beta_key double"


def _gate(cos: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-5 * cos))


def _exp(table: A.ScoreTable) -> np.ndarray:
    if table.weight is None and table.z.size:
        raise ValueError("the scores of a block are too far apart to be stored as factors")
    return table.weight if table.z.size else table.z


def write_attention_weights(
    answer_seqs: DataFrame, phrase_seqs: DataFrame, vocab: DataFrame, vectors: DataFrame, path: str, dim: int, num_words: int = 10000,
    op: str = "dp", id_col: str = "essay_id", set_col: str = "essay_set",
) -> None:
    """Write the store; phrases and essays without a token are in it too."""
    matrix = A.vector_matrix(vocab, vectors, dim, num_words)
    shared = answer_seqs.sparkSession.sparkContext.broadcast(matrix)
    n_words = int(matrix.any(axis=1).sum()) + 1

    def of_blocks(batches):
        tables = A._Tables(shared.value, op)
        ids = np.r_[np.flatnonzero(shared.value.any(axis=1)), -1]
        for batch in batches:
            for t, i in tables.rows(batch, set_col):
                e = _exp(t)
                cos = t.cosine
                gates = [_gate(cos[:, p].max(axis=1)) if len(p) else np.zeros(len(ids)) for p in t.place]
                yield pa.RecordBatch.from_pylist([{
                    set_col: batch.column(set_col)[i].as_py(), "block": batch.column("block")[i].as_py(), "words": ids.tolist(),
                    "key_words": t.key_words.tolist(), "keys": t.keys.tolist(), "seqs": [x.tolist() for x in t.ids], "z": t.z.tolist(),
                    "over_key": (e @ t.count.T).tolist(), "gate_key": np.stack(gates, axis=1).tolist()}], schema=_schema(set_col, BLOCKS))

    def of_essays(batches):
        tables = A._Tables(shared.value, op)
        rows: list = []
        for t, name, block, key, seq in tables.answers(batches, id_col, set_col, rubrics and rubrics.value):
            at, c = t.words.counted(seq)
            cos = t.cosine[at]  # worked out once a table
            rows.append({set_col: name, "essay_id": key, "block": block, "places": at.tolist(), "counts": c.astype(int).tolist(),
                         "over_ans": (c @ _exp(t)[at]).tolist(), "gate_ans": _gate(cos.max(axis=0)).tolist() if len(at) else []})
            if len(rows) >= ROWS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(set_col, ESSAYS))
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_schema(set_col, ESSAYS))

    blocks = A.phrase_blocks(phrase_seqs, A.block_tokens(n_words), set_col)
    blocks.mapInArrow(of_blocks, f"{set_col} string, {BLOCKS}").write.mode("overwrite").partitionBy(set_col).parquet(f"{path}/blocks")
    # a gate is that of the nearest word, so the gates of many essays are the same numbers
    met, rubrics = A._with_blocks(answer_seqs, phrase_seqs, n_words, id_col, set_col)
    met.mapInArrow(of_essays, f"{set_col} string, {ESSAYS}").write.mode("overwrite").option(
        "parquet.dictionary.page.size", DICTIONARY_BYTES).partitionBy(set_col).parquet(f"{path}/essays")


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _type(kind: str) -> pa.DataType:
    return pa.list_(_type(kind[6:-1])) if kind.startswith("array<") else _TYPES[kind]


def _columns(columns: str) -> pa.Schema:
    return pa.schema([(c.split(" ")[0], _type(c.split(" ")[1])) for c in columns.split(", ")])


def _schema(set_col: str, columns: str) -> pa.Schema:
    return _columns(f"{set_col} string, {columns}")


def _restored(block: dict, essay: dict):
    """(key_id, z, z_ans, z_key, gates of key words, gates of answer words) of
    each phrase of a block for one essay."""
    at = np.asarray(essay["places"], dtype="int64")
    z = block["z"][at]
    e = np.exp(z - block["top"])
    over_ans, gate_ans = np.asarray(essay["over_ans"]), np.asarray(essay.get("gate_ans", np.zeros(len(block["key_words"]))))
    for p, key in enumerate(block["keys"]):
        columns = block["place"][p]
        w = e[:, columns]
        none = np.zeros((len(columns), len(at)))
        if not len(at) or not len(columns):
            yield key, none, none, none, np.zeros(len(columns)), np.zeros(len(at))
            continue
        yield (key, z[:, columns].T, (w / over_ans[columns]).T, (w / block["over_key"][at, p][:, None]).T, gate_ans[columns], block["gate_key"][at, p])


def _gate_sums(blocks: DataFrame, held: DataFrame) -> DataFrame:
    """``held`` with ``gate_sums``, the sum of ``gate_ans`` over the key words of each phrase,
    in its place: where the essays are stored, from the phrases' places alone."""
    place = F.transform("seqs", lambda s: F.transform(s, lambda x: (F.array_position("key_words", x) - 1).cast("int")))
    places = blocks.select("essay_set", "block", place.alias("_place"))
    gate = lambda i: F.coalesce(F.get("gate_ans", i), F.lit(0.0))  # noqa: E731  (none in an essay without a token)
    sums = F.transform("_place", lambda p: F.aggregate(p, F.lit(0.0), lambda total, i: total + gate(i)))
    return lookup_join(held, places, ["essay_set", "block"]).withColumn("gate_sums", sums).drop("_place", "gate_ans")


def _pairs(spark: SparkSession, path: str, sets: list | None, essays: DataFrame | None, gates: bool = True):
    """Rows of blocks and essays, and a function that yields (block, essay) of them:
    a block, which is large, comes once ahead of the essays that meet it.  Without
    ``gates`` an essay has their sums by phrase (``_gate_sums``) instead."""
    blocks, held = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/essays")
    if sets is not None:  # a pruned read
        blocks, held = blocks.filter(F.col("essay_set").isin(sets)), held.filter(F.col("essay_set").isin(sets))
    if essays is not None:
        held = held.join(essays.select("essay_id"), "essay_id", "left_semi")
    if not gates:
        held = _gate_sums(blocks, held)
    # rows of a group: copies of its block, each ahead of some of its essays
    sizes = held.groupBy("essay_set", "block").agg(F.ceil(F.count(F.lit(1)) / ESSAYS_PER_COPY).cast("int").alias("_copies"))
    names = [c for c in blocks.columns if c not in ("essay_set", "block")]
    packed = lookup_join(blocks.select("essay_set", "block", F.struct(*names).alias("b")), sizes, ["essay_set", "block"])
    packed = packed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    dealt = lookup_join(held, sizes, ["essay_set", "block"])
    dealt = dealt.withColumn("_copy", F.pmod(F.xxhash64("essay_id"), F.col("_copies")).cast("int")).drop("_copies")
    group = ["essay_set", "block", "_copy"]
    both = packed.unionByName(dealt, allowMissingColumns=True).repartition(*group)
    joined = both.sortWithinPartitions(*group, F.col("b").isNull())
    wanted = ("places", "counts", "over_ans", "gate_ans" if gates else "gate_sums")

    def each(batches):
        for batch in batches:
            nothing = batch.column("b").is_null().to_pylist()
            ids = batch.column("essay_id").to_pylist()
            for i, essay_row in enumerate(nothing):
                if not essay_row:
                    kept = _block(batch.column("b")[i])
                else:
                    lists = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in wanted}
                    yield kept, {"essay_id": ids[i], **lists}

    return joined, each


def _block(held: pa.StructScalar) -> dict:
    """A row of ``blocks`` with its matrices as arrays."""
    b = {c: held[c].as_py() for c in ("words", "key_words", "keys", "seqs")}
    for c in ("z", "over_key", "gate_key"):
        b[c] = held[c].values.flatten().to_numpy(zero_copy_only=False).reshape(len(b["words"]), -1)
    b["top"] = b["z"].max() if b["z"].size else 0.0
    b["words"], b["key_words"] = np.array(b["words"]), np.array(b["key_words"], dtype="int64")
    b["place"] = [np.searchsorted(b["key_words"], np.array(s, dtype="int64")) for s in b["seqs"]]
    return b


def read_attention(spark: SparkSession, path: str, sets: list | None = None, essays: DataFrame | None = None) -> DataFrame:
    """The matrices of every essay and phrase, or of the ``sets`` and ``essays``
    (essay_id) asked for: rows are the phrase's key words, columns the essay's
    distinct ``words``; a word that occurs ``counts`` times has that weight at
    each of its places."""
    joined, each = _pairs(spark, path, sets, essays)

    def run(batches):
        for block, essay in each(batches):
            words = block["words"][np.asarray(essay["places"], dtype="int64")].tolist()
            rows = [{"essay_id": essay["essay_id"], "key_id": key, "words": words, "counts": essay["counts"].tolist(), "z": z.tolist(), "z_ans": a.tolist(),
                     "z_key": k.tolist(), "beta_ans": ga.tolist(), "beta_key": gk.tolist()} for key, z, a, k, ga, gk in _restored(block, essay)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_columns(WEIGHTS))

    return joined.mapInArrow(run, WEIGHTS)


def attention_sums(spark: SparkSession, path: str) -> DataFrame:
    """Per essay and phrase sums over the restored matrices, words weighted by
    their counts: of ``z``, of the squares of ``z_ans`` and ``z_key``, of both
    gates.  Those of the key words' gates are made before the essays travel."""
    joined, each = _pairs(spark, path, None, None, gates=False)
    names = [c.split(" ")[0] for c in SUMS.split(", ")]

    def run(batches):
        rows: list = []
        for block, essay in each(batches):
            c = np.asarray(essay["counts"], dtype="float64")
            for (key, z, a, k, ga, gk), gate_sum in zip(_restored(block, essay), essay["gate_sums"].tolist()):
                rows.append((essay["essay_id"], key, len(ga), int(c.sum()), float((z @ c).sum()), float(((a * a) @ c).sum()), float(((k * k) @ c).sum()),
                             gate_sum, float(gk @ c)))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_columns(SUMS))
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_columns(SUMS))

    return joined.mapInArrow(run, SUMS)
