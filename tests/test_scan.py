"""The scan of a batch against the Column expressions, text by text."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gradeflow.functions import scan
from gradeflow.operators import features as FT

ODD = [None, "", " ", "?!...", "a", "Hello, world! Is this   fine? Yes, it is.", "é", "İa İİ xİ", "ÀÉ ñandú 12 x3y ½ ٣", "don't re-use; It's a dog's",
       "tab\tand\x0bvt\x1cfs\x85nel\xa0nbsp em　wide", "...a...", "word " * 150 + "End. More! " * 3, "a.b.c." * 60, "😀 x😀y 日本語 テスト", "x" * 3000,
       "ΣΑΣ ΟΔΟΣ", "the The THE can't can", "\n\n", "ǅ ʰ ª", "Straße MÜLLER", "beautiful aeiou yYy rhythm"]


def test_scan_matches_the_column_expressions(spark):
    rng = random.Random(1)
    chars = "aeiouyAEIOUYbcdz .,!?;\n\t'12éßñ😀 \xa0½"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 400))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "essay_id long, essay string")
    words = lambda *rows: spark.createDataFrame([(r,) for r in rows], "word string")
    lists = FT.WordLists(spark.createDataFrame([("the", "NOUN"), ("dog", "VERB")], "word string, tag string"), words("a", "the"), words("is", "the", "x"))
    names = [c for c in FT.FEATURE_COLUMNS if c in FT.row_features(df).columns]
    want = {r["essay_id"]: r for r in FT.row_features(df).select("essay_id", *names).collect()}
    got = {r["essay_id"]: r for r in FT.generate_features(df, lists).select("essay_id", *names).collect()}
    assert len(names) == 16
    for i in want:
        assert got[i] == want[i], (texts[i], got[i], want[i])
    joined = {r["essay_id"]: r for r in FT._joined_counts(df, FT.word_facts(lists), "essay_id", "essay").collect()}
    for r in FT.word_list_features(df, lists).collect():
        old = joined.get(r["essay_id"])
        assert tuple(r[c] for c in FT.COUNTS) == (tuple(old[c] for c in FT.COUNTS) if old else (0,) * len(FT.COUNTS)), texts[r["essay_id"]]


def test_scan_of_slices():
    column = pa.array(["skip", *ODD], pa.string()).slice(1)
    whole = scan.text_counts(column)
    parts = [scan.text_counts(column.slice(at, n)) for at, n in scan.slices(column, 50)]
    assert len(parts) > 5
    for i, x in enumerate(whole):
        assert [v for p in parts for v in p[i].tolist()] == x.tolist()
    assert all(len(x) == 0 for x in scan.text_counts(column.slice(0, 0)))
    words, rows = scan.streams(pa.array(["a b", None, "c,d"]))[0]
    assert words.to_pylist() == ["a", "b", "c", "d"] and rows.tolist() == [0, 0, 2, 2]
