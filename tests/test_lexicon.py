"""Quotes, lexicon counts and tf-idf n-grams against direct Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from gradeflow.operators import lexicon as L

TEXTS = [
    (1, 'The cat said "hello there" and the dog said \u0093bye\u0094.'),
    (2, "the cat, the cat! A dog?"),
    (3, ""),
]


def _df(spark):
    return spark.createDataFrame(TEXTS, "essay_id long, essay string").withColumn("essay_set", F.lit("en"))


def _keras(t):
    return [w for w in re.split(r'[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n ]+', t.lower()) if w]


def test_quotes(spark):
    got = {r["essay_id"]: r["quotes"] for r in L.extract_quotes(_df(spark)).collect()}
    assert got[1] == ["hello there", "bye"] and got[2] == [] and got[3] == []
    qs = L.quote_set(_df(spark)).collect()
    assert sorted(r["quote"] for r in qs) == ["bye", "hello there"] and {r["n_quotes"] for r in qs} == {2}


def test_lexicon_count(spark):
    lex = spark.createDataFrame([("cat", "ORG"), ("dog", "PERSON"), ("the", "LAW")], "word string, tag string")
    got = {r["essay_id"]: (r["ORG"], r["LAW"], r["PERSON"]) for r in L.lexicon_count(_df(spark), lex, ["ORG", "LAW", "PERSON"]).collect()}
    for eid, text in TEXTS:
        c = Counter(_keras(text))
        assert got[eid] == (c["cat"], c["the"], c["dog"])


def test_top_ngrams_tfidf(spark):
    got = [(r["ngram"], r["total"], r["score"]) for r in L.top_ngrams_tfidf(_df(spark), n_max=2, k=5).collect()]
    docs = [_keras(t) for _, t in TEXTS]
    total, df = Counter(), Counter()
    for toks in docs:
        grams = toks + [" ".join(toks[i:i + 2]) for i in range(len(toks) - 1)]
        total.update(grams)
        df.update(set(grams))
    n = len(docs)
    want = sorted(
        ((g, total[g], round((math.log((1 + n) / (1 + df[g])) + 1) * total[g], 6)) for g in total),
        key=lambda x: (-x[2], x[0]),
    )[:5]
    assert got == want
