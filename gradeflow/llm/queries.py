"""The registered queries: ``op<N>_<name>`` applies operator N, with its
production parameters, to its whole table.  ``ORACLE`` holds DuckDB SQL where
SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm import fill_middle, gru_lm, hnsw, merkle, quality, sentence_pieces, source_mix, token_rollup, url_cascade, vector_codes, warc
from gradeflow.llm.jaccard_join import jaccard_components
from gradeflow.llm.substring_dedup import kept_digests
from gradeflow.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kept_digests(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query("op8_source_mix", source_mix.oracle_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


@query("op7_merkle_fingerprint", merkle.oracle_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_warc", warc.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digests_match")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_token_rollup", token_rollup.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
    return token_rollup.corpus_history(table(spark, sf_dir, "documents"), token_rollup.Rollup(spark, root))


@query("op9_sentence_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentence_pieces.Pieces.load()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs, pieces), pieces)
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "piece_ids")


@query("op1_hnsw")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.self_search(table(spark, sf_dir, "embeddings"))


@query("op3_gru_lm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_texts(table(spark, sf_dir, "documents"))


@query("op11_url_cascade", url_cascade.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_cascade.rule_table(spark, url_cascade.RULES))


@query("op12_fill_middle", fill_middle.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"),
                      digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op13_vector_codes", vector_codes.oracle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
