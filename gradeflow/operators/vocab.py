"""Vocabulary, token ids, padding and word vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gradeflow.functions import patterns as P
from gradeflow.functions import scan
from gradeflow.functions.text import keras_tokens, num_sentences
from gradeflow.plans.chunks import with_word_facts
from gradeflow.plans.joins import fits_broadcast, lookup_join
from gradeflow.plans.rank import global_rank

VECTOR_CHUNK_BYTES = 64 << 20  # a chunk gets each vector once, so larger ones than for flags
SUMMED_BYTES = 16 << 20  # vectors multiplied at once


def tokenize(df: DataFrame, text_col: str = "essay", out: str = "tokens") -> DataFrame:
    """V1: Keras ``text_to_word_sequence`` tokens as an array column."""
    return df.withColumn(out, keras_tokens(text_col))


def _counted_words(df: DataFrame, id_col: str, text_col: str, src: int) -> DataFrame:
    """Per Arrow batch of texts one row for each distinct word: its count and its
    first place (id, then position; a null id comes first)."""

    def count(batches):
        for batch in batches:
            lists, ids = batch.column("tokens"), batch.column("tid")
            coded = lists.flatten().dictionary_encode()
            code, row = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
            n = len(coded.dictionary)
            if not n:
                continue
            start = np.searchsorted(row, np.arange(len(lists)))
            rank = np.empty(len(lists), dtype=np.int64)
            rank[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(lists))
            # the texts of a batch in id order, their tokens in text order
            order = np.argsort(rank[row], kind="stable")
            _, first = np.unique(code[order], return_index=True)
            at = order[first]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(np.bincount(code, minlength=n)), pa.array(np.full(n, src, dtype=np.int32)),
                 ids.take(pa.array(row[at])), pa.array((at - start[row[at]]).astype(np.int32))], ["word", "n", "src", "tid", "pos"])

    toks = df.select(F.col(id_col).cast("long").alias("tid"), keras_tokens(text_col).alias("tokens"))
    return toks.mapInArrow(count, "word string, n long, src int, tid long, pos int")


def fit_vocab(
    corpus: DataFrame,
    id_col: str = "essay_id",
    text_col: str = "essay",
    extra: DataFrame | None = None,
    extra_id_col: str = "key_id",
    extra_text_col: str = "phrase",
) -> DataFrame:
    """V2: ``(word, count, index)``; index 1.. by count desc, ties by first
    appearance (corpus in id order, then the extra texts in id order).

    Words are counted batch by batch where the texts are read, so the
    aggregation gets one row per distinct word and batch, and a word present in
    a third of all rows costs no more; the index is a distributed global rank
    (no single-task window).
    """
    counted = _counted_words(corpus, id_col, text_col, 0)
    if extra is not None:
        counted = counted.unionByName(_counted_words(extra, extra_id_col, extra_text_col, 1))
    agg = counted.groupBy("word").agg(F.sum("n").alias("count"), F.min(F.struct("src", "tid", "pos")).alias("first"))
    agg = agg.select("word", "count", "first.src", "first.tid", "first.pos")
    ranked = global_rank(agg, [F.col("count").desc(), F.col("src"), F.col("tid"), F.col("pos")], name="index")
    return ranked.select("word", F.col("count").cast("long").alias("count"), "index")


def texts_to_sequences(
    df: DataFrame,
    vocab: DataFrame,
    id_col: str = "essay_id",
    text_col: str = "essay",
    num_words: int | None = 10000,
    out: str = "seq",
) -> DataFrame:
    """V3: token ids in text order; unknown words and ids >= num_words dropped.

    A vocabulary of a measured size is broadcast and looked up in place, so the
    texts stay where they were read.  For a larger one the tokens are exploded
    next to the scan, joined to it and regrouped per id; the partial collect
    runs map-side, so the shuffle carries one row per document per partition.
    """
    voc = vocab.select("word", F.col("index").cast("int").alias("wid"))
    if num_words is not None:
        voc = voc.filter(F.col("wid") < num_words)
    if fits_broadcast(voc):
        return df.withColumn(out, _ids_in_place(voc, keras_tokens(text_col)))
    return _joined_sequences(df, voc, id_col, text_col, out)


def _ids_in_place(voc: DataFrame, tokens: Column) -> Column:
    """The ids of an array of words, from a vocabulary small enough to be
    broadcast.  A null array has no ids."""
    table = voc.filter(F.col("word").isNotNull()).toArrow()
    shared = voc.sparkSession.sparkContext.broadcast((table["word"].combine_chunks(), table["wid"].to_numpy()))

    @F.arrow_udf("array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        words, wid = shared.value
        coded = lists.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy()[coded.indices.to_numpy()]
        row, known = pc.list_parent_indices(lists).to_numpy(), place >= 0
        ends = np.cumsum(np.bincount(row[known], minlength=len(lists)))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("int32")), pa.array(wid[place[known]], pa.int32()))

    return ids(tokens)


def _joined_sequences(df: DataFrame, voc: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    toks = df.select(F.col(id_col), F.posexplode(keras_tokens(text_col)).alias("pos", "word"))
    hit = lookup_join(toks, voc, ["word"], "inner", salt_by=[F.col(id_col), F.col("pos")])
    seqs = hit.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "wid"))).alias("_s"))
    seqs = seqs.select(id_col, F.col("_s.wid").alias(out))
    return df.join(seqs, id_col, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<int>"))
    )


def pad_column(arr, maxlen: int, padding: str = "post", truncating: str = "post", value: int = 0):
    """V4 on one array column: Keras ``pad_sequences`` semantics."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = F.size(a)
    if truncating == "post":
        cut = F.slice(a, 1, maxlen)
    else:
        cut = F.when(n > maxlen, F.slice(a, -maxlen, maxlen)).otherwise(a)
    fill = F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(0), F.lit(maxlen) - F.size(cut)))
    return F.concat(cut, fill) if padding == "post" else F.concat(fill, cut)


def pad_sequences(df, col="seq", maxlen=None, padding="post", truncating="post", out="padded"):
    """V4.  Without ``maxlen`` the length is that of the longest sequence."""
    if maxlen is None:
        maxlen = df.agg(F.max(F.size(col))).first()[0] or 0
    return df.withColumn(out, pad_column(col, maxlen, padding, truncating))


def token_mask(df, col="padded", out="mask"):
    """V5: 1 where the id is not 0."""
    return df.withColumn(out, F.transform(F.col(col), lambda x: F.when(x == 0, 0).otherwise(1)))


def build_embedding_matrix(
    vocab: DataFrame, vectors: DataFrame, dim: int, vocab_size: int | None = None, skip_last: bool = False
):
    """V6: one row per word id with its vector, zero vector when none.
    ``skip_last`` reproduces the reference loop that leaves the last
    vocabulary word without a row (off by default)."""
    voc = vocab if vocab_size is None else vocab.filter(F.col("index") < vocab_size)
    if skip_last:
        last = voc.agg(F.max("index")).first()[0]
        voc = voc.filter(F.col("index") < F.lit(last))
    joined = voc.join(vectors.select("word", "vec"), "word", "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return joined.select("index", "word", F.coalesce("vec", zero).alias("vec"))


def embedding_coverage(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """V7: vocabulary words with and without a vector."""
    j = vocab.join(vectors.select("word", F.lit(1).alias("_hit")), "word", "left")
    return j.agg(
        F.count(F.lit(1)).alias("vocab_size"),
        F.count("_hit").alias("with_vector"),
        (F.count(F.lit(1)) - F.count("_hit")).alias("without_vector"),
    )


def basic_english_tokens(text):
    """V8 tokeniser (torchtext ``basic_english``): lower; ``' . , ( ) ! ?``
    get blanks around them; ``"`` removed; ``; :`` and ``<br />`` -> blank."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    t = F.regexp_replace(t, F.lit("'"), F.lit(" '  "))
    t = F.regexp_replace(t, F.lit('"'), F.lit(""))
    t = F.regexp_replace(t, F.lit(r"\."), F.lit(" . "))
    t = F.regexp_replace(t, F.lit("<br />"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(","), F.lit(" , "))
    t = F.regexp_replace(t, F.lit(r"\("), F.lit(" ( "))
    t = F.regexp_replace(t, F.lit(r"\)"), F.lit(" ) "))
    t = F.regexp_replace(t, F.lit("!"), F.lit(" ! "))
    t = F.regexp_replace(t, F.lit(r"\?"), F.lit(" ? "))
    t = F.regexp_replace(t, F.lit(";"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(":"), F.lit(" "))
    t = F.regexp_replace(t, F.lit(r"\s+"), F.lit(" "))
    return F.filter(F.split(F.trim(t), " "), lambda x: x != "")


def basic_english_vocab(df: DataFrame, text_col: str = "essay", max_size: int = 10000) -> DataFrame:
    """V8: ``<unk>``=0, ``<pad>``=1, then words by count desc, ties alphabetic,
    ``max_size`` words at most.  A top-k, so Spark's TakeOrdered keeps it
    bounded per task."""
    words = df.select(F.explode(basic_english_tokens(text_col)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), F.col("word")).limit(max_size)
    ranked = global_rank(top, [F.col("count").desc(), F.col("word")], name="_r")
    body = ranked.select("word", F.col("count").cast("long").alias("count"), (F.col("_r") + 1).alias("index"))
    spark = df.sparkSession
    specials = spark.createDataFrame([("<unk>", None, 0), ("<pad>", None, 1)], "word string, count long, index long")
    return specials.unionByName(body)


def clean_oov(df: DataFrame, col: str, vocab_size: int) -> DataFrame:
    """V9: keep a row only if no id reaches ``vocab_size``."""
    return df.filter(~F.exists(F.col(col), lambda x: x >= vocab_size))


def encode_hierarchical(
    df: DataFrame, vocab: DataFrame, id_col="essay_id", text_col="essay", max_sents=50, max_words=100, num_words=10000
) -> DataFrame:
    """Essay -> sentences -> word ids, padded to (max_sents, max_words)."""
    sents = df.select(
        F.col(id_col),
        F.posexplode(F.split(F.col(text_col), P.SENTENCE_END)).alias("sent_pos", "sentence"),
    ).filter(F.col("sent_pos") < max_sents)
    sents = sents.withColumn("_sid", F.struct(F.col(id_col), F.col("sent_pos")))
    seqs = texts_to_sequences(
        sents.select("_sid", "sentence"), vocab, id_col="_sid", text_col="sentence", num_words=num_words, out="seq"
    )
    seqs = seqs.select(F.col("_sid").getField(id_col).alias(id_col), F.col("_sid.sent_pos").alias("sent_pos"),
                       pad_column("seq", max_words).alias("row"))
    grid = seqs.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("sent_pos", "row"))).alias("_rows"))
    empty_row = F.array_repeat(F.lit(0), max_words)
    grid = grid.select(id_col, F.col("_rows.row").alias("rows"))
    padded = F.concat(
        F.col("rows"), F.array_repeat(empty_row, F.greatest(F.lit(0), F.lit(max_sents) - F.size("rows")))
    )
    return grid.select(id_col, padded.alias("matrix"))


def mean_embedding(
    df: DataFrame, vectors: DataFrame, dim: int, id_col="essay_id", text_col="essay"
) -> DataFrame:
    """Per text, the mean of its tokens' vectors (tokens without a
    vector count as zero vectors); zero vector when no token.  Rows of one id
    share the mean of all their tokens; a word with several vectors counts once for
    each.

    Texts are dealt to chunks by their id; a chunk gets the vectors of its distinct
    words (``plans/chunks.py``) and sums them up text by text."""
    cell_rows = max(1, SUMMED_BYTES // (8 * dim))

    def use(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, low = texts[id_col].combine_chunks(), texts["_low"].combine_chunks()
        coded = ids.dictionary_encode()
        group = coded.indices.fill_null(-1).to_numpy()
        n = max(len(coded.dictionary), 1)
        sums, weight = np.zeros((n, dim)), np.zeros(n)
        with_vec = found.filter(pc.is_valid(found["vec"]))
        # the vectors of a word are added up first; it weighs as much as it has vectors
        named = with_vec["word"].combine_chunks().dictionary_encode()
        words, place = named.dictionary, named.indices.to_numpy()
        vec, times = np.zeros((len(words) + 1, dim)), np.ones(len(words) + 1)
        if len(place):
            np.add.at(vec, place, with_vec["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim))
            times[:-1] = np.bincount(place, minlength=len(words))
        for at, rows in scan.slices(low):
            tokens, row = scan.streams(low.slice(at, rows))[0]
            here = group[at : at + rows][row]
            tokens, here = tokens.filter(pa.array(here >= 0)), here[here >= 0]  # a null id has no group
            dist = tokens.dictionary_encode()
            code = pc.index_in(dist.dictionary.cast(pa.string()), value_set=words).fill_null(len(words)).to_numpy()[dist.indices.to_numpy()]
            weight += np.bincount(here, weights=times[code], minlength=n)
            known = code < len(words)
            pair, count = np.unique(here[known].astype("int64") * len(vec) + code[known], return_counts=True)
            for i in range(0, len(pair), cell_rows):
                part = pair[i : i + cell_rows]
                owner = part // len(vec)
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sums[owner[first]] += np.add.reduceat(vec[part % len(vec)] * count[i : i + cell_rows, None], first, axis=0)
        mean = np.divide(sums, weight[:, None], out=np.zeros_like(sums), where=weight[:, None] > 0)
        out = np.where(group[:, None] >= 0, mean[group], 0.0)
        return pa.table([ids, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float64()))], names=[id_col, "mean_vec"])

    low = df.select(id_col, F.lower(F.col(text_col)).alias("_low"))
    # rows without an id have no mean: they are dealt out by their text
    deal_by = [F.col(id_col), F.when(F.col(id_col).isNull(), F.col("_low"))]
    schema = StructType([low.schema[id_col], StructField("mean_vec", ArrayType(DoubleType()))])
    zero = F.array_repeat(F.lit(0.0).cast("double"), dim)
    known = vectors.select("word", F.coalesce(F.col("vec"), zero).alias("vec"))
    return with_word_facts(low, "_low", deal_by, known, (0,), use, schema, VECTOR_CHUNK_BYTES)
