"""Operators 6, 7, 8, 10 and the pipeline: DuckDB over tables with odd rows,
exact round trips, and the contracts of the stages."""

import io
import re
import uuid
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeflow.llm import merkle, quality, sentence_pieces, source_mix, token_rollup, warc
from gradeflow.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "line of text here\n" * 4000


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None, "en", "b", 0), (2, "", "en", None, 0), (3, "a b c", None, "a", 5), (4, "a b c", "de", "é", 5), (5, LONG, "en", "Z", 1),
            (6, "one\ntwo\n\n", "en", "a", 3), (7, "é😀 ü", "fr", "", 4), (8, "\n", "en", "b", 1), (9, "x" * 1000, "en", "b", 1), (10, "a b c", "en", "a", 5)]
    rows += [(100 + i, f"doc {i} " + "word " * (i % 37), "en", f"s{i % 5}", 9) for i in range(200)]
    return spark.createDataFrame(rows, DOCS)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.sql(sql)
    return sorted(([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rel.fetchall()]), key=str), rel.columns


def spark_rows(df, columns):
    return sorted(([tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()]), key=str)


# operator 6

def test_warc_round_trip_with_payloads(spark):
    rows = [(1, "http://a/é \n b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "v", "é" * 70_000), (None, "n", "only"),
            (None, "m", "<p>x</p>"), (7, "w", "a\r\n\r\nb"), (7, "w", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, stored int")
    folder = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(manifest, with_payload=True).collect()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) == len(got)
    assert all(r.digests_match for r in got)
    assert sorted((r.page_id, r.url) for r in got if r.page_id) == sorted((i, u) for i, u, _ in rows if i)[: len(rows) - 2]
    whole = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert whole == {2: "<p>x</p>", 4: "", 5: "é" * 70_000, None: "only", 7: "a\r\n\r\nb"}
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 2), (3, 4), (None, 2)}
    want, cols = duck(warc.SQL, pages=pages)
    assert spark_rows(warc.round_trip(spark, pages), cols) == want
    assert {r.record_type for r in warc.round_trip(spark, pages.filter("page_id < 3")).collect()} == {"response", "revisit"}
    small = warc.write_archives(pages.filter("page_id < 3"), folder + "b", min_bytes=9)
    assert {r.record_type for r in warc.read_archives(small).collect()} == {"response"}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_reader_finds_damage():
    good = b"".join(warc.record(i, "u", b"body" * 50, warc.base32(__import__("hashlib").sha1(b"body" * 50).digest()), None, False, "d") for i in range(3))
    for chunk in (1, 7, 1 << 16):
        assert [r["page_id"] for r in warc.Reader(io.BytesIO(good), chunk=chunk).records()] == [0, 1, 2]
    with pytest.raises(ValueError, match="ends"):
        list(warc.Reader(io.BytesIO(good[:-20])).records())
    with pytest.raises(ValueError, match="bad gzip"):
        list(warc.Reader(io.BytesIO(good[: len(good) // 2] + b"\0\0\0\0" + good[len(good) // 2 + 4 :])).records())
    wrong = warc.record(1, None, b"body", warc.base32(b"0" * 20), None, False, "d")
    assert [r["digests_match"] for r in warc.Reader(io.BytesIO(wrong)).records()] == [False]


# operator 7

@pytest.mark.parametrize("range_bytes", [1 << 30, 2000])
def test_fingerprints_match_sql(spark, odd_docs, range_bytes):
    want, cols = duck(merkle.oracle_sql(), documents=odd_docs)
    got = merkle.fingerprints(odd_docs.withColumn("range", F.lit(1)).withColumn("id", F.lit("x")).withColumn("root", F.lit(0)), range_bytes=range_bytes)
    assert spark_rows(got, cols) == want


def test_fingerprint_cases(spark, odd_docs):
    one = spark.createDataFrame([(None, "abcd efgh\nx", "q", "s", 1)], DOCS)
    r = merkle.fingerprints(one).first()
    assert r.near_next == 1.0 and r.n_chars == 11
    assert merkle.fingerprints(odd_docs.limit(0)).count() == 0
    same = {r.doc_id: r.fingerprint for r in merkle.fingerprints(odd_docs).collect()}
    assert same[3] == same[4] == same[10] and len({same[1], same[3], same[6], same[8]}) == 4
    pair = spark.createDataFrame([("\n".join(f"p{i}" for i in range(40)), "\n".join(f"p{i}" if i != 21 else "new" for i in range(40)))], "a string, b string")
    assert pair.select(merkle.differing_paragraphs(F.col("a"), F.col("b"))).first()[0] == [21]
    assert pair.select(merkle.differing_paragraphs(F.col("a"), F.col("a"))).first()[0] == []


# operator 8

def test_mix_matches_sql_and_targets(spark, odd_docs):
    df = odd_docs.withColumn("row_key", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("sid", F.lit(0))
    got = source_mix.mix_report(df)
    want, cols = duck(source_mix.oracle_sql(), documents=odd_docs)
    assert spark_rows(got, cols) == want
    rows = got.join(odd_docs.select("doc_id", "source"), "doc_id").collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(r.target <= 3 * r.source_size + 1e-6 for r in rows)
    mixed = source_mix.mix_sources(df)
    assert mixed.columns == df.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in rows if r.copies}


def test_mix_cases(spark, odd_docs):
    assert source_mix.mix_report(odd_docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "e", None, 0), (None, " ", "e", "a", 0)], DOCS)
    assert {(r.size, r.target, r.taken) for r in source_mix.mix_report(blank).collect()} == {(0, 0.0, 0)}
    twice = spark.createDataFrame([(1, "a b", "e", "x", 0), (1, "a b", "e", "x", 0), (None, "c", "e", None, 0)], DOCS)
    rows = source_mix.mix_report(twice).collect()
    assert len(rows) == 3 and len({r.copies for r in rows if r.doc_id == 1}) == 1
    near = source_mix.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in near.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.03 * r.g


# operator 10

def test_rollup_commits(spark):
    root = f"{ensure_checkpoint_dir(spark)}/r-{uuid.uuid4().hex}"
    rollup = token_rollup.Rollup(spark, root)
    state = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer_version string, tokens long, documents int")
    a = state([(1, "s", "en", "v1", 10, 0), (2, "s", "en", "v1", 5, 0), (3, None, None, "v1", None, 0), (4, "t", "en", "v1", 7, 0)])
    b = state([(1, "s", "en", "v1", 12, 0), (3, None, None, "v1", None, 0), (4, "t", "de", "v1", 7, 0), (5, "s", "en", "v2", 1, 0)])
    none = a.limit(0)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_rollup.signed_changes(none, a))
    assert not rollup.commit("a", token_rollup.signed_changes(none, a))
    total = lambda: {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert total() == {("s", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("t", "en", "v1"): (1, 7)}
    assert rollup.commit("b", token_rollup.signed_changes(a, b))
    after = {("s", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0), ("t", "de", "v1"): (1, 7), ("s", "en", "v2"): (1, 1)}
    assert total() == after
    rollup.compact()
    assert total() == after and rollup.committed() == ["a", "b"]
    assert not token_rollup.Rollup(spark, root).commit("b", token_rollup.signed_changes(a, b))
    assert rollup.commit("c", token_rollup.signed_changes(b, none)) and total() == {}
    assert rollup.commit("d", token_rollup.signed_changes(none, none)) and total() == {}
    rollup.compact()
    assert total() == {}


def test_a_commit_during_compaction_counts_once(spark, monkeypatch):
    rollup = token_rollup.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/r-{uuid.uuid4().hex}")
    one = spark.createDataFrame([("s", "en", "v1", 1, 10)], token_rollup.SCHEMA)
    rollup.commit("a", one)
    plain = rollup._sum

    def late(base, names):
        rollup.commit("b", one)  # after the list is taken
        return plain(base, names)

    monkeypatch.setattr(rollup, "_sum", late)
    rollup.compact()
    monkeypatch.undo()
    assert [(r.documents, r.tokens) for r in rollup.totals().collect()] == [(2, 20)]
    rollup.compact()
    assert [(r.documents, r.tokens) for r in rollup.totals().collect()] == [(2, 20)] and rollup.committed() == ["a", "b"]


def test_history_matches_sql(spark, odd_docs):
    docs = odd_docs.unionAll(spark.createDataFrame([(None, "a b c", "en", "a", 1), (11, "dup, dup!\ndup, dup!", "en", "a", 1)], DOCS))
    want, cols = duck(token_rollup.SQL, documents=docs)
    root = f"{ensure_checkpoint_dir(spark)}/r-{uuid.uuid4().hex}"
    assert spark_rows(token_rollup.corpus_history(docs, token_rollup.Rollup(spark, root)), cols) == want


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mix", "sentence_pieces"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        if name != names[-1]:
            assert out.columns == docs.columns, name
            docs = out
        counts.append(out.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    before = texts.select("text").distinct().count()
    assert counts[2] <= before


def brute_near_duplicates(rows):
    """Ids that stay: the smallest of each group of linked sets; empty texts stay."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, holders, parent = {}, {}, {i: i for i in rows}
    for i, text in rows.items():
        w = word.findall((text or "").translate(lower))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in rows:
        for j, n in Counter(j for s in sets[i] for j in holders[s] if j < i).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i for i in rows if parent[i] == i}


def brute_passages(rows, window=35):
    """Texts without the words of windows that start more than once."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = {i: word.findall(t or "") for i, t in rows.items()}
    seen = Counter(tuple(w[j:j + window]) for w in words.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone.update(range(j, j + window))
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else rows[i]
    return out


def test_pipeline_matches_brute_force(spark):
    """Each stage after the classifier by a plain loop or SQL over what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    assert set(kept) == {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    alone = brute_near_duplicates(kept)
    texts = brute_passages({i: kept[i] for i in alone})
    assert len(alone) < len(kept) and any(texts[i] != kept[i] for i in alone)
    rest = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    rows = spark.createDataFrame([(i, t, *rest[i], len(t or "")) for i, t in texts.items()], DOCS)
    mixed, cols = duck(source_mix.oracle_sql(), documents=rows)
    copies = {r[cols.index("doc_id")]: r[cols.index("copies")] for r in mixed}
    want = Counter({(i, *rest[i], texts[i]): n for i, n in copies.items() if n})
    out = corpus_pipeline.run(spark, SF).toArrow()
    back = sentence_pieces.decode(out["piece_ids"], sentence_pieces.Pieces.load()).to_pylist()
    got = Counter(zip(*(out[c].to_pylist() for c in ("doc_id", "lang", "source")), back))
    assert got == want
    assert out["n_pieces"].to_pylist() == [len(x) for x in out["piece_ids"].to_pylist()]


def test_registry_has_all_queries():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in e.queries() and {"op7_merkle_fingerprint", "op11_url_cascade", "op12_fill_middle", "op13_vector_codes"} <= set(e.oracle_sql())
