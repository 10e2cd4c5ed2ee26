"""Fixture bindings: how the driver tables stand in for the reference inputs
(essays, phrases, vectors, lexicons, metric inputs).  Each is a lazy
DataFrame over the given parquet tables, so its work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLE_KEYS = {
    "documents": "doc_id",
    "labels": "doc_id",
    "benchmark": "item_id",
    "embeddings": "vec_id",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "conversations": "conv_id",
}


def spread(df: DataFrame, key: str | None) -> DataFrame:
    """Scan-parallelism guard: a scan with fewer splits than the cluster has
    cores (one big row group, as in the test files) is hash-spread on its key
    so the CPU-heavy text work runs on every core.  A large input already has
    thousands of splits and is left as it is (no extra shuffle)."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if key is None or df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), TABLE_KEYS.get(name))


def essays(spark, sf_dir) -> DataFrame:
    """documents left join labels: essay_id, essay_set, essay, domain1_score."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("essay_id"),
        F.col("lang").alias("essay_set"),
        F.col("text").alias("essay"),
        (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("domain1_score"),
    )


def texts(spark, sf_dir) -> DataFrame:
    """``essays`` without the score: no join with labels, so queries that
    only read the text never shuffle it for a join."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("essay_id"), F.col("lang").alias("essay_set"), F.col("text").alias("essay")
    )


def scored(spark, sf_dir) -> DataFrame:
    return essays(spark, sf_dir).filter(F.col("domain1_score").isNotNull())


# The essay set whose rubric holds an item, by item_id % 4
# (FIXTURES.md, "rubric").
RUBRIC_SETS = ("de", "en", "es", "fr")


def phrases(spark, sf_dir) -> DataFrame:
    """Rubric key phrases by essay set: the whole text of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    place = (F.pmod(F.col("item_id"), F.lit(len(RUBRIC_SETS))) + 1).cast("int")
    return b.select(
        F.col("item_id").alias("key_id"),
        F.element_at(F.array(*[F.lit(x) for x in RUBRIC_SETS]), place).alias("essay_set"),
        F.col("text").alias("phrase"),
    )


def corpus_vocab(spark, sf_dir) -> DataFrame:
    """V2 over every essay plus the phrases (the reference fits on the set and
    its keywords)."""
    from gradeflow.operators.vocab import fit_vocab

    return fit_vocab(texts(spark, sf_dir), extra=phrases(spark, sf_dir))


def vectors_from(vocab: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Word of index i gets embedding vec_id = i-1."""
    return vocab.join(embeddings, F.col("index") - 1 == F.col("vec_id")).select(
        "word", F.col("embedding").alias("vec")
    )


# The tag of a vocabulary word by index % 8 and the entity
# family by index % 11 (FIXTURES.md, "lexicon" and "gazetteer").
LEXICON_TAGS = {0: "NOUN", 1: "PROPN", 2: "VERB", 3: "ADJ", 4: "ADV", 5: "CCONJ"}
GAZETTEER_FAMILIES = {0: "ORG", 1: "LAW", 2: "PERSON"}


def lexicon_from(vocab: DataFrame) -> DataFrame:
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in LEXICON_TAGS.items() for x in kv]), (F.col("index") % 8).cast("int"))
    return vocab.select("word", tag.alias("tag")).filter(F.col("tag").isNotNull())


def gazetteer_from(vocab: DataFrame) -> DataFrame:
    fam = F.element_at(
        F.create_map(*[F.lit(x) for kv in GAZETTEER_FAMILIES.items() for x in kv]), (F.col("index") % 11).cast("int")
    )
    return vocab.select("word", fam.alias("tag")).filter(F.col("tag").isNotNull())


def dictionary_from(vocab: DataFrame) -> DataFrame:
    return vocab.filter(F.col("count") >= 5).select("word")


def easy_words_from(vocab: DataFrame) -> DataFrame:
    return vocab.filter(F.col("index") <= 500).select("word")


def synonyms_from(vocab: DataFrame) -> DataFrame:
    a = vocab.filter(F.col("index") % 2 == 0).select(F.col("word"), F.col("index").alias("i"))
    b = vocab.select(F.col("word").alias("synonym"), (F.col("index") - 1).alias("i"))
    return a.join(b, "i").select("word", "synonym")


def logits(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits"),
        F.col("label").cast("int").alias("label"),
    )


def binary(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.element_at("embedding", 1).cast("double").alias("score"),
        (F.col("label") % 2).cast("int").alias("label"),
    )


def binary_ties(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.floor(F.col("n_chars") / 500).cast("double").alias("score"),
        F.col("quality").cast("int").alias("label"),
    )


def regress(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    pred = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))
    return o.join(pred, o.o_orderkey == pred.l_orderkey).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("label"), "pred"
    )


def num(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("l_quantity"),
        F.col("l_extendedprice"),
        F.when(F.col("l_orderkey") % 5 == 0, "test").when(F.col("l_orderkey") % 5 == 1, "val").otherwise("train").alias("split"),
    )


def cat(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 5 == 0, "test").when(F.col("o_orderkey") % 5 == 1, "val").otherwise("train").alias("split"),
    )


def bucket_of(id_col: str, k: int = 5):
    """First 8 hex digits of md5(id) mod k."""
    return (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int")


def fold_ids(spark, sf_dir, k: int = 5) -> DataFrame:
    """(fold, role, essay_id): test of fold i is bucket i, dev is bucket i-1."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("essay_id"), bucket_of("doc_id", k).alias("b"))
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    rows = d.select("essay_id", "b", F.explode(folds).alias("fold"))
    role = F.when(F.col("b") == F.col("fold"), "test").when(F.col("b") == F.pmod(F.col("fold") - 1, F.lit(k)), "dev")
    return rows.select("fold", role.alias("role"), "essay_id").filter(F.col("role").isNotNull())
