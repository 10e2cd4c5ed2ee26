"""Sources/sinks round trips, the driver contract and the stream path."""

import os

from pyspark.sql import functions as F

from gradeflow.sources import io as IO


def test_latin1_tsv_roundtrip(spark):
    rows = [(1, "en", 'He said \u0093yes\u0094, "ok"\nnew line\u0085', 3), (2, "fr", "café\tx", None)]
    df = spark.createDataFrame(rows, IO.ESSAY_SCHEMA)
    path = IO.scratch_path(spark, "t")
    IO.write_delimited(df, path)
    back = sorted(IO.read_essays(spark, path).collect())
    assert [tuple(r) for r in back] == rows


def test_fold_files_and_vectors(spark):
    ids = spark.createDataFrame([(0, "dev", 5), (0, "test", 6), (1, "dev", 6)], "fold int, role string, essay_id long")
    folder = IO.scratch_path(spark, "f")
    IO.write_fold_ids(ids, folder)
    assert sorted(tuple(r) for r in IO.read_fold_ids(spark, folder).collect()) == [(0, "dev", 5), (0, "test", 6), (1, "dev", 6)]
    vec = spark.createDataFrame([("a", [0.5, -1.25])], "word string, vec array<float>")
    p = IO.scratch_path(spark, "v")
    IO.write_word_vectors(vec, p)
    assert IO.read_word_vectors(spark, p).first()["vec"] == [0.5, -1.25]


def test_prediction_lines(spark):
    df = spark.createDataFrame([(0, 1.23456, 3)], "i long, p double, y int")
    assert IO.prediction_lines(df, "regression", "i", "p", "y").first()["value"] == "0\t1.235\t3"


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() > 0 and "num_words" in out.columns
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_stream_features(spark):
    from gradeflow.streaming import features as ST

    stream = ST.stream_row_features(ST.stream_documents(spark, "/root/testdata/sf0.001"))
    out, ck = IO.scratch_path(spark, "so"), IO.scratch_path(spark, "sc")
    q = ST.run_to_parquet(stream, out, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.filter(F.col("num_words") > 0).count() == 200
