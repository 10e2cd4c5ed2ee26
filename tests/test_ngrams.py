"""K5 and K6 where the texts are read, against counting everything."""

import random

import pytest

from gradeflow.operators import lexicon as L
from gradeflow.operators import ngrams as NG

WORDS = ["the", "cat", "sat", "on", "mat", "dog", "ran", "far", "Ähre", "x1"]


def _texts(spark, n=120):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[: rng.randint(2, 10)]) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "the cat sat on the mat", "a")]
    return spark.createDataFrame(rows, "essay_id long, essay string, essay_set string").repartition(5)


@pytest.mark.parametrize("keep", [4096, 3])
def test_top_ngrams_match_a_full_count(spark, keep):
    df = _texts(spark)
    for n_max, k in ((3, 30), (2, 5), (1, 50)):
        got = [tuple(r) for r in NG.top_ngrams(df, n_max, k, "essay", keep=keep).collect()]
        want = [tuple(r) for r in L.count_all_ngrams(df, n_max, k).select("ngram", "total", "score").collect()]
        assert sorted(got, key=lambda r: (-r[2], r[0])) == want
    assert NG.top_ngrams(df.limit(0), 3, 30, "essay").count() == 0


def test_presence_matches_a_search(spark, monkeypatch):
    df = _texts(spark)
    rng = random.Random(4)
    phrases = [(i, rng.choice(["a", "b", None, "c"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))) for i in range(40)]
    phrases += [(50, "a", "?!"), (51, "a", None), (52, "a", "The CAT, sat!"), (53, "b", "cat"), (54, "b", "cat"), (55, "a", "the cat sat on the mat"), (56, "a", "unheard of")]
    ph = spark.createDataFrame(phrases, "key_id long, essay_set string, phrase string")
    import re

    tokens = lambda t: re.findall(r"[^ ,!?\t\n]+", (t or "").lower())
    want = set()
    for i, text, name in df.collect():
        for key, of, phrase in phrases:
            if name is not None and of == name:
                p = " ".join(tokens(phrase))
                want.add((i, key, int(bool(p) and f" {p} " in f" {' '.join(tokens(text))} ")))
    assert {tuple(r) for r in L.phrase_presence(df, ph).collect()} == want
    assert {p for _, _, p in want} == {0, 1}
    spark.conf.set("gradeflow.broadcast.maxBytes", "1500")  # several parts
    try:
        assert {tuple(r) for r in L.phrase_presence(df, ph).collect()} == want
    finally:
        spark.conf.unset("gradeflow.broadcast.maxBytes")
    assert L.phrase_presence(df, ph.limit(0)).count() == 0
