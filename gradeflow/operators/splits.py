"""Splits, sampling, augmentation.

Every random choice is a pinned hash order ``md5(id || ':' || seed), id``.
Splits cut that order at a few places (``plans/cuts.py``): counts by digest prefix
find the key at each cut, and a row compares its own key with it, so nothing is
sorted or shuffled, however large a class is.  Where no key says where to cut (very
many folds or classes, or ids that repeat across a cut) the distributed global rank
numbers the rows; the result follows the same order.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions import scan
from gradeflow.plans.chunks import with_word_facts
from gradeflow.plans.cuts import at_or_after, hash_cuts
from gradeflow.plans.joins import lookup_join
from gradeflow.plans.rank import global_ntile, global_rank

SYNONYM_CHUNK_BYTES = 16 << 20  # a chunk holds its texts, their lower case and the new texts


def hash_key(id_col: str, seed) -> F.Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def apply_folds(df: DataFrame, fold_ids: DataFrame, k: int = 5, id_col: str = "essay_id") -> DataFrame:
    """Per fold, rows listed as dev/test keep that role, all others are
    train.  Each row appears once per fold (k copies: the k-fold layout).
    A row meets the list of its roles in one join by id and is copied after it."""
    roles = fold_ids.groupBy(id_col).agg(F.collect_list(F.struct(F.col("fold").cast("int").alias("fold"), F.col("role").alias("split"))).alias("_roles"))
    held = F.coalesce("_roles", F.array().cast("array<struct<fold:int,split:string>>"))

    def of_fold(i):
        own = F.filter(held, lambda r: r["fold"] == i)
        train = F.array(F.struct(i.alias("fold"), F.lit("train").alias("split")))
        return F.when(F.size(own) > 0, own).otherwise(train)

    per_fold = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of_fold))
    j = df.select(id_col).join(roles, id_col, "left").select(id_col, F.explode(per_fold).alias("_r"))
    return j.select("_r.fold", "_r.split", id_col)


def rotate_folds(df: DataFrame, k: int = 5, id_col: str = "essay_id") -> DataFrame:
    """bucket = first 8 hex digits of md5(id) mod k; in fold i the test
    rows are bucket i, the dev rows bucket i-1 (mod k), the rest train."""
    b = (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")
    rows = df.select(id_col, b.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    role = (
        F.when(F.col("_b") == F.col("fold"), "test")
        .when(F.col("_b") == F.pmod(F.col("fold") - 1, F.lit(k)), "dev")
        .otherwise("train")
    )
    return rows.select("fold", role.alias("split"), id_col)


def _tile_starts(n: int, k: int) -> list[int]:
    """Where tiles 1 to k - 1 of n rows start: SQL's ntile(k)."""
    q, m = divmod(n, k)
    return [j * q + min(j, m) for j in range(1, k)]


def _cuts_before(cuts: dict, places: list[int], id_col: str) -> F.Column:
    """How many of ``places`` are at or before the row; ``_h`` is its digest.
    A place behind the last row has no cut."""
    out = F.lit(0)
    for p in places:
        if p in cuts:
            out = out + at_or_after(F.col("_h"), id_col, cuts[p]).cast("int")
    return out


def kfold_split(df: DataFrame, k: int = 5, seed=42, id_col: str = "essay_id") -> DataFrame:
    """D3: k folds in hash order; sizes differ by at most 1, the first n mod k
    larger (SQL ntile)."""
    starts = {}

    def positions(counts):
        starts["all"] = _tile_starts(counts[""], k)
        return {"": starts["all"]}

    cuts = hash_cuts(df, hash_key(id_col, seed), id_col, positions)
    if cuts is None:
        t = global_ntile(df, [hash_key(id_col, seed), F.col(id_col)], k, name="_tile")
        return t.withColumn("fold", F.col("_tile") - 1).drop("_tile")
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    return keyed.withColumn("fold", _cuts_before(cuts.get("", {}), starts["all"], id_col)).drop("_h")


def holdout_then_kfold(df: DataFrame, ratio: float = 0.2, k: int = 5, seed=42, id_col="essay_id") -> DataFrame:
    """The first ceil(ratio*n) rows in hash order are a fixed validation
    set; the rest get k folds (ntile in the same order).  ``fold`` is null
    for the validation rows."""
    places = {}

    def positions(counts):
        n = counts[""]
        n_val = math.ceil(n * ratio)
        places["val"], places["folds"] = n_val, [n_val + s for s in _tile_starts(n - n_val, k)]
        return {"": [n_val, *places["folds"]]}

    cuts = hash_cuts(df, hash_key(id_col, seed), id_col, positions)
    if cuts is None:
        return _ranked_holdout(df, ratio, k, seed, id_col)
    cuts = cuts.get("", {})
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_cv", _cuts_before(cuts, [places["val"]], id_col) == 1)
    return keyed.select(
        *df.columns,
        F.when(F.col("_cv"), "cv").otherwise("val").alias("role"),
        F.when(F.col("_cv"), _cuts_before(cuts, places["folds"], id_col)).alias("fold"),
    )


def _ranked_holdout(df, ratio, k, seed, id_col):
    r = global_rank(df, [hash_key(id_col, seed), F.col(id_col)], name="_r", with_total=True)
    n_val = F.ceil(F.col("_r_n") * F.lit(ratio))
    n, rr = F.col("_r_n") - n_val, F.col("_r") - n_val
    q = F.floor(n / k)
    m = n - q * k
    big = m * (q + 1)
    tile = F.when(rr <= big, F.floor((rr - 1) / (q + 1))).otherwise(m + F.floor((rr - 1 - big) / q))
    return r.select(
        *df.columns,
        F.when(F.col("_r") <= n_val, "val").otherwise("cv").alias("role"),
        F.when(F.col("_r") > n_val, tile.cast("int")).alias("fold"),
    )


def _rank_in_class(df: DataFrame, label: str, id_col: str, seed) -> DataFrame:
    """Position of each row inside its class in hash order, from one global
    rank over (class, hash, id) minus the class start."""
    r = global_rank(df, [F.col(label), hash_key(id_col, seed), F.col(id_col)], name="_g")
    starts = r.groupBy(label).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_n_class"))
    # one row per class: a small broadcast
    return lookup_join(r, starts, [label]).withColumn("_pos", F.col("_g") - F.col("_start") + 1)


def drop_quotas(counts: dict, p: float) -> dict:
    """Largest remainder: n_drop = ceil(p*n) split over classes, ties by class."""
    n = sum(counts.values())
    n_drop = math.ceil(p * n)
    exact = {c: p * v for c, v in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    left = n_drop - sum(quota.values())
    order = sorted(counts, key=lambda c: (-(exact[c] - quota[c]), c))
    for c in order[: max(left, 0)]:
        quota[c] += 1
    return quota


def _first_in_class(df: DataFrame, wanted, label: str, id_col: str, seed):
    """Mark ``_first``: the row is among the first rows of its class in hash order,
    as many as ``wanted(counts)`` says (a class that it leaves out has none)."""
    amounts = {}

    def positions(counts):
        amounts.update({c: (int(n), counts[c]) for c, n in wanted(counts).items() if c in counts})
        return {c: [n] for c, (n, size) in amounts.items() if 0 < n < size}

    cuts = hash_cuts(df, hash_key(id_col, seed), id_col, positions, label)
    if cuts is None:
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
        table = df.sparkSession.createDataFrame(
            [(c, int(n)) for c, n in wanted(counts).items()], T.StructType([df.schema[label], T.StructField("_amount", T.LongType())]))
        ranked = lookup_join(_rank_in_class(df, label, id_col, seed), table, [label], "left")
        return ranked.withColumn("_first", F.coalesce(F.col("_pos") <= F.col("_amount"), F.lit(False))).select(*df.columns, "_first")
    first = F.lit(False)
    for c, (n, size) in amounts.items():
        mine = F.col(label).eqNullSafe(F.lit(c))
        if n >= size:
            first = first | mine
        elif n > 0:
            first = first | (mine & ~at_or_after(F.col("_h"), id_col, cuts[c][n]))
    return df.withColumn("_h", hash_key(id_col, seed)).withColumn("_first", first).drop("_h")


def stratified_downsample(df: DataFrame, p: float, label: str = "domain1_score", seed=42, id_col="essay_id"):
    """Drop a stratified share ``p`` (keep 1-p); per-class quotas by
    largest remainder, the dropped rows are the first in hash order.  Rows
    without a label belong to no class and go."""
    named = df.filter(F.col(label).isNotNull())
    return _first_in_class(named, lambda counts: drop_quotas(counts, p), label, id_col, seed).filter(~F.col("_first")).drop("_first")


def _lowest(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """The ``n`` rows of the lowest ids (null first).  The ids alone show where
    they end, so that whole rows of a few files are read and ordered."""
    if n == 0:
        return df.limit(0)
    low = df.select(F.col(id_col).alias("i")).orderBy("i").limit(n)
    cut = low.agg(F.max("i").alias("i")).first()["i"]
    up_to = F.col(id_col).isNull() if cut is None else F.col(id_col).isNull() | (F.col(id_col) <= F.lit(cut))
    return df.filter(up_to).orderBy(id_col).limit(n)


def pad_to_multiple(df: DataFrame, multiple: int = 32, id_col="essay_id", form: str = "table") -> DataFrame:
    """Repeat rows from the start (lowest ids) until the count is a
    multiple.  ``table``: append at most n rows once; ``list``: cycle.
    Adds ``copy`` (0 = original)."""
    n = df.count()
    missing = -n % multiple
    if form == "table":
        rows = df.withColumn("copy", F.lit(0))
        return rows.unionByName(_lowest(df, min(n, missing), id_col).withColumn("copy", F.lit(1)))
    if n == 0:
        return df.withColumn("copy", F.lit(0))
    # whole rounds for every row, and one more copy of the first rows: fewer than ``multiple``
    rounds, more = divmod(n + missing, n)
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))) if rounds > 1 else F.lit(0))
    return rows.unionByName(_lowest(df, more, id_col).withColumn("copy", F.lit(rounds)))


def oversample_by_class(
    df: DataFrame, plan: dict, label: str = "domain1_score", seed=42, id_col="essay_id"
) -> DataFrame:
    """Per class in ``plan`` ({class: (amount, multiplier)}), take
    ``amount`` rows in hash order and emit ``multiplier`` variants of each
    with applied=1, length=0; append to the input (variant 0)."""
    chosen = df.filter(F.col(label).isin(list(plan)))
    mult = F.create_map(*[x for c, (_, m) in plan.items() for x in (F.lit(c), F.lit(m))])
    picked = _first_in_class(chosen, lambda counts: {c: a for c, (a, _) in plan.items()}, label, id_col, seed).filter("_first")
    extra = picked.select(
        *df.columns,
        F.explode(F.sequence(F.lit(1), F.element_at(mult, F.col(label)))).alias("variant"),
        F.lit(1).alias("applied"),
        F.lit(0).alias("length"),
    )
    base = df.withColumn("variant", F.lit(0))
    return base.unionByName(extra, allowMissingColumns=True)


def synonym_substitute(
    df: DataFrame, synonyms: DataFrame, variant: int = 1, rate_tenths: int = 3, id_col="essay_id", text_col="essay", chunk_bytes: int = SYNONYM_CHUNK_BYTES
) -> DataFrame:
    """Replace a blank token whose lower case has a synonym when
    md5(id:variant:pos) picks it (first 8 hex digits mod 10 < rate_tenths);
    texts are re-assembled by position with single blanks.  Texts of one id are
    taken together, rows without an id get no text.

    Tokens are never shuffled: chunks of texts ask for the synonyms of their words
    (``plans/chunks.py``)."""
    syn = synonyms.groupBy("word").agg(F.min("synonym").alias("synonym")).filter(F.col("synonym").isNotNull())
    kept = [c for c in df.columns if c not in (id_col, text_col)]
    rows = df.select(id_col, *kept, text_col, F.lower(F.col(text_col)).alias("_low"), F.col(id_col).cast("string").alias("_key"))

    def use(texts: pa.Table, found: pa.Table) -> pa.Table:
        words, instead = (found[c].combine_chunks().cast(pa.large_string()) for c in ("word", "synonym"))
        text, low = (texts[c].combine_chunks() for c in (text_col, "_low"))
        keys = texts["_key"].to_pylist()
        shared: dict = {k: [] for k, n in Counter(keys).items() if n > 1 and k is not None}
        done = []
        for at, n in scan.slices(text):
            lists = _substituted(text.slice(at, n), low.slice(at, n), keys[at : at + n], words, instead, variant, rate_tenths)
            for i in range(n) if shared else ():
                if keys[at + i] in shared:
                    shared[keys[at + i]] += enumerate(lists[i].as_py())
            done += pc.binary_join(lists, " ").to_pylist()
        whole = {k: " ".join(token for _, token in sorted(tokens)) for k, tokens in shared.items()}
        out = [whole.get(k, x) if whole else x for k, x in zip(keys, done)]
        return texts.select([id_col, *kept]).append_column(text_col, pa.array(out, pa.string()))

    schema = T.StructType([*[df.schema[c] for c in (id_col, *kept)], T.StructField(text_col, T.StringType())])
    spread = F.when(F.col(id_col).isNull(), F.col("_low"))  # rows without an id need not meet
    return with_word_facts(rows, "_low", [F.col(id_col), spread], syn, (1,), use, schema, chunk_bytes)


def _substituted(text: pa.Array, low: pa.Array, keys: list, words: pa.Array, instead: pa.Array, variant: int, rate_tenths: int) -> pa.Array:
    """The blank tokens of each text, the picked ones replaced; none where the key is null."""
    (tokens, row), (lower, _) = (s.tokens(~s.has(scan.WS)) for s in (scan.Scan(text), scan.Scan(low)))
    if len(tokens) != len(lower):
        raise ValueError("a text and its lower case differ in their tokens")
    known = pa.array([k is not None for k in keys], pa.bool_()).to_numpy(zero_copy_only=False)[row]
    tokens, lower, row = tokens.filter(pa.array(known)), lower.filter(pa.array(known)), row[known]
    ends = np.cumsum(np.bincount(row, minlength=len(keys)))
    pos = np.arange(len(row)) - np.r_[0, ends][row]
    coded = lower.dictionary_encode()
    place = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy()[coded.indices.to_numpy()]
    asked = np.flatnonzero(place >= 0)
    digests = b"".join(hashlib.md5(f"{keys[r]}:{variant}:{p}".encode()).digest()[:4] for r, p in zip(row[asked].tolist(), pos[asked].tolist()))
    picked = asked[np.frombuffer(digests, dtype=">u4") % 10 < rate_tenths]
    index = np.arange(len(tokens))
    index[picked] = len(tokens) + place[picked]
    out = pa.concat_arrays([tokens, instead]).take(pa.array(index)).cast(pa.string())  # some MB of text (``scan.slices``)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), out)
