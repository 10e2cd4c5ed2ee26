"""Operators 2 and 4 against brute force, over many small blocks."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeflow.llm import jaccard_join as J
from gradeflow.llm import substring_dedup as S
from gradeflow.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, id string, row_key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 7, "x", "k") for i, t in rows], SCHEMA)


def sets_of(rows, size=5):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, percent=75):
    sets = sets_of(rows)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def brute_kept(rows, window):
    docs = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(12):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 120, 300]))]
        if g % 3 == 0:
            base[5:5] = passage
        texts += near_copies(rng, base, 9, max(1, len(base) // 15))
    texts += [" ".join(passage[rng.randrange(20) :]) + f" tail{i}" for i in range(12)]
    texts += ["a b " * 40, "a b " * 40 + "c", "x " * 100, " ".join(["q r s t"] * 30)]  # periodic
    texts += [None, "", "  \t\n", "one", "One", "one two", "ONE two", "one two three four", "é à ü", "É à ü"]
    texts += [texts[0], texts[3], texts[3]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("light,chunk", [(None, 4096), (0, 2), (8, 3), (12, 4096)])
def test_components_match_brute_force(spark, corpus, monkeypatch, light, chunk):
    if light is not None:
        monkeypatch.setattr(J, "boundary", lambda counts, percent: light)
    got = J.jaccard_components(frame(spark, corpus), group_sets=chunk, block_bytes=4000)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(corpus)


@pytest.mark.parametrize("light", [0, 6, 12])
def test_small_sets(spark, monkeypatch, light):
    rng = random.Random(light)
    rows = []
    for i in range(300):
        start = rng.randrange(6)
        w = [f"v{(start + k) % 30}" for k in range(rng.randint(1, 16))]
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "z"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(J, "boundary", lambda counts, percent: light)
    got = J.jaccard_components(frame(spark, rows), block_bytes=1000)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows)


def test_boundary_prefers_subsets_for_tiny_sets_only():
    assert J.boundary({}, 75) == 0
    assert 1 <= J.boundary({1: 10, 2: 10, 3: 10}, 75) <= J.LARGEST_LIGHT
    assert J.boundary({n: 100 for n in range(1, 17)}, 75) < 12


def test_join_cases(spark):
    long_text = " ".join(f"l{i}" for i in range(30_000))
    rows = [(None, "n u l l id"), (5, "n u l l id"), (None, None), (7, ""), (3, long_text), (9, long_text + " x"), (3, long_text)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 1, 5), (5, 1, 5), (None, 0, None), (7, 0, 7), (3, 29_996, 3), (9, 29_997, 3), (3, 29_996, 3)], key=str)
    kept = J.one_per_component(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted([(r.doc_id, None if r.text is None else len(r.text)) for r in kept.collect()], key=str) == sorted(
        [(5, 10), (None, None), (7, 0), (3, len(long_text))], key=str)
    assert J.jaccard_components(frame(spark, [])).count() == 0
    assert J.one_per_component(frame(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


@pytest.mark.parametrize("window,gram,block", [(35, 16, 3000), (35, 16, 4 << 20), (12, 4, 2000)])
def test_spans_match_brute_force(spark, corpus, window, gram, block):
    got = S.kept_digests(frame(spark, corpus), window=window, gram=gram, block_bytes=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_kept(corpus, window)


def test_random_texts_with_few_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    got = S.kept_digests(frame(spark, rows), window=10, gram=4, block_bytes=500).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_kept(rows, 10)


@pytest.mark.parametrize("window,gram", [(35, 16), (12, 4), (10, 4), (6, 6), (5, 1)])
def test_periods_of_every_length_in_one_document(spark, window, gram):
    rows = []
    for period in range(1, window + 2):
        for repeats in (window // period + 1, window // period + 2, window // period + 4):
            i = len(rows)
            unit = [f"d{i}_{k}" for k in range(period)]
            rows.append((i, " ".join([f"d{i}_a", *unit * repeats, f"d{i}_z"])))
    got = S.kept_digests(frame(spark, rows), window=window, gram=gram, block_bytes=4000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_kept(rows, window)


def test_removal_keeps_columns_and_clean_texts(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"a  b\n{shared}"), (2, f"{shared} c"), (3, " clean \n text "), (4, None), (None, ""), (6, "Z " * 3)]
    df = frame(spark, rows)
    out = S.remove_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a b", 2: "c", 3: " clean \n text ", 4: None, None: "", 6: "Z Z Z "}
    spans = {r.doc_id: [(x.start, x.length) for x in r.spans] for r in S.duplicate_spans(df).collect()}
    assert spans[1] == [(2, 50)] and spans[2] == [(0, 50)] and spans[3] == []
    assert S.remove_duplicates(frame(spark, [])).count() == 0
    twice = S.duplicate_spans(frame(spark, [(1, shared), (1, shared)])).agg(F.sum("n_removed")).first()[0]
    assert twice == 100
