"""Quotes, phrase lists, lexicon counts, n-gram ranking, phrase matching
(K1-K6)."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import text as T
from gradeflow.operators import ngrams as NG
from gradeflow.plans.joins import lookup_join


def extract_quotes(df: DataFrame, text_col="essay", out="quotes") -> DataFrame:
    """K1: every quoted span, after the quote normalisation."""
    return df.withColumn(out, T.quotes(T.normalize_quotes(text_col)))


def quote_set(
    df: DataFrame, set_col="essay_set", text_col="essay", only_score: dict | None = None, score_col="domain1_score"
) -> DataFrame:
    """K2: distinct quotes per set, with the number of distinct quotes of the
    set.  The count is a per-set aggregate joined back (sets are few).  A set
    named in ``only_score`` takes the essays of that score alone."""
    for name, score in (only_score or {}).items():
        df = df.filter((F.col(set_col) != name) | (F.col(score_col) == score))
    q = df.select(set_col, F.explode(T.quotes(T.normalize_quotes(text_col))).alias("quote")).distinct()
    n = q.groupBy(set_col).agg(F.count(F.lit(1)).cast("long").alias("n_quotes"))
    return lookup_join(q, n, [set_col])


def phrase_union(a: DataFrame, b: DataFrame, col="phrase") -> DataFrame:
    """K3: set union of two phrase lists."""
    return a.select(col).union(b.select(col)).distinct()


def lexicon_count(
    df: DataFrame, lexicon: DataFrame, tags: list[str], id_col="essay_id", text_col="essay"
) -> DataFrame:
    """K4: per text, the number of tokens per lexicon tag (one column per tag,
    0 when none).  Tokens are looked up next to the scan (size-checked
    broadcast) and counted per text with map-side partial aggregation, so
    only one row per text and partition is shuffled."""
    toks = df.select(id_col, F.explode(T.keras_tokens(text_col)).alias("word"))
    lex = lexicon.select("word", "tag").filter(F.col("tag").isin(tags))
    hit = lookup_join(toks, lex, ["word"], "inner", salt_by=[F.col(id_col), F.col("word")])
    counts = hit.groupBy(id_col).agg(*[F.count_if(F.col("tag") == t).alias(t) for t in tags])
    out = df.select(id_col).join(counts, id_col, "left")
    return out.select(id_col, *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in tags])


def top_ngrams_tfidf(df: DataFrame, n_max: int = 3, k: int = 30, id_col="essay_id", text_col="essay") -> DataFrame:
    """K5: n-grams (1..n_max) by summed tf-idf, the k best;
    idf = ln((1+N)/(1+df)) + 1, score = idf * total count.  Summaries with an
    error bound choose the candidates, which are then counted exactly; where
    even these are too many, all n-grams are counted."""
    best = NG.top_ngrams(df, n_max, k, text_col)
    return best if best is not None else count_all_ngrams(df, n_max, k, id_col, text_col)


def count_all_ngrams(df: DataFrame, n_max: int = 3, k: int = 30, id_col="essay_id", text_col="essay") -> DataFrame:
    """K5 by one aggregation of all n-grams.

    A document is one row, so it emits its n-grams with a mark on the first
    of each; one aggregation by n-gram then has both counts, and the number
    of documents is counted on the same scan."""
    toks = df.select(F.col(id_col), F.coalesce(T.keras_tokens(text_col), F.array().cast("array<string>")).alias("t"))
    grams = [F.col("t")]
    for n in range(2, n_max + 1):
        toks = NGram(n=n, inputCol="t", outputCol=f"_g{n}").transform(toks)
        grams.append(F.col(f"_g{n}"))
    total = F.concat(*grams)
    # a document's distinct n-grams count 1 for df, all of them 1 for the total
    marked = toks.select(F.explode(F.array(F.struct(total.alias("g"), F.lit(0).alias("d")), F.struct(F.array_distinct(total).alias("g"), F.lit(1).alias("d")))).alias("x"))
    rows = marked.select(F.explode("x.g").alias("ngram"), F.col("x.d").alias("d"))
    per_gram = rows.groupBy("ngram").agg(F.sum(1 - F.col("d")).alias("total"), F.sum("d").alias("df"))
    n_docs = df.count()  # one scalar to the driver
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    scored = per_gram.select("ngram", F.col("total").cast("long").alias("total"), F.round(idf * F.col("total"), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col("ngram")).limit(k)


def phrase_presence(
    df: DataFrame, phrases: DataFrame, id_col="essay_id", text_col="essay", key_col="key_id", phrase_col="phrase", set_col="essay_set"
) -> DataFrame:
    """K6: for every essay and phrase of its set 1 where the phrase's tokens
    occur contiguously in the essay's tokens, else 0 (a phrase without tokens
    occurs nowhere).  The texts stay where they were read."""
    ph = phrases.select(F.col(key_col).cast("long").alias("key_id"), F.col(set_col), T.keras_tokens(phrase_col).alias("tokens"))
    return NG.presence(df, ph, id_col, text_col, set_col).withColumnRenamed("key_id", key_col)
