"""Operators 1, 3, 5 and 9: recall, probabilities, held-out accuracy and exact
searches against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import gru_lm, hnsw, quality
from gradeflow.llm import sentence_pieces as P
from gradeflow.llm.words import Words, slices

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "   ", "\n\n", "a", "x" * 50_000, "é梦😀 ▁ ▁▁", "Word " * 30_000, "tab\tand\x0bvt", " lead", "trail "]


# words

def test_words_cut_and_hash_like_a_pattern():
    texts = [t for t in ODD] + ["A b", "a B"]
    words = Words(pa.array(texts), lower=True)
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(words.first).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    by_hash = {}
    for h, x in zip(words.hash.tolist(), flat):
        assert by_hash.setdefault(h, x) == x
    assert len(by_hash) == len(set(flat))
    sliced = pa.array(["skip me", *texts], pa.string()).slice(1)
    assert Words(sliced, lower=True).hash.tolist() == words.hash.tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    assert sum(s.num_rows for s in slices(batch, "text", 100)) == len(texts)


# operator 1

def brute_nearest(rows, q, k):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    mine = [v for i, v in fine if i == q][0]
    scored = [(-round(float(v @ mine / (np.linalg.norm(v) * np.linalg.norm(mine))), 12), i) for i, v in fine if i != q and len(v) == len(mine)]
    return [i for _, i in sorted(scored)[:k]]


def test_search_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    got = {}
    for r in hnsw.self_search(df, shard_rows=128, ef=64).collect():
        a, b = vec[r.query_id], vec[r.vec_id]
        assert r.score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == {i for i, _ in rows if i % 50 == 0}
    hits = sum(len(set(g.values()) & set(brute_nearest(rows, q, 5))) for q, g in got.items())
    assert hits >= 0.9 * 5 * len(got)
    assert all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())


def test_search_cases(spark):
    rng = np.random.default_rng(0)
    copy = [1.0, 2.0, 3.0]
    rows = [(i, copy) for i in range(0, 400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(2000, None), (2050, [0.0, 0.0, 0.0]), (2100, [1.0, None, 0.0]), (2150, [float("nan"), 1.0, 1.0]), (2200, [float("inf"), 1.0, 1.0]),
             (None, copy), (3000, [1.0, 1.0]), (3001, [2.0, 2.0]), (0, copy), (2250, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, shard int, dim int")
    got = {}
    for r in sorted(hnsw.self_search(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    assert got[3000] == [3001]
    assert not {2000, 2050, 2100, 2150, 2200, 2250} & set(got)
    assert not {2000, 2050, 2100, 2150, 2200, 2250} & {x for g in got.values() for x in g}
    assert hnsw.self_search(df.limit(0)).count() == 0


# operator 3

def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = gru_lm.Network(hidden=5, seed=1)
    net.w = [x.astype(np.float64) for x in net.w]
    x, y = rng.integers(0, gru_lm.CLASSES, (6, 3)), rng.integers(0, gru_lm.CLASSES, (6, 3))
    x[3, 1] = gru_lm.END
    h0 = np.zeros((3, 5))
    _, grads, _ = net.gradients(h0, x, y)
    for i, g in enumerate(grads):
        for at in rng.integers(0, g.size, 6):
            place = np.unravel_index(at, g.shape)
            old = net.w[i][place]
            net.w[i][place] = old + 1e-4
            up = net.gradients(h0, x, y)[0]
            net.w[i][place] = old - 1e-4
            down = net.gradients(h0, x, y)[0]
            net.w[i][place] = old
            assert g[place] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_state_is_carried_over_windows_and_reset_between_texts():
    rng = np.random.default_rng(3)
    net = gru_lm.Network(seed=2)
    sizes = [300, 1, 40, 3, 129]
    texts = [np.r_[rng.integers(0, gru_lm.END, n), gru_lm.END] for n in sizes]
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = net.log_probability(np.concatenate(texts), bounds, window=16, lanes=3)
    want = []
    for t in texts:
        h, last = np.zeros((1, net.hidden), np.float32), np.array([gru_lm.END])
        for c in t:
            h = net.step(h, last)[0]
            logp = net.log_classes(h)[0]
            assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)
            want.append(logp[c])
            last = np.array([c])
    assert np.allclose(got, want, atol=1e-4)


def test_scores_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (9000, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionAll(extra).withColumn("id", F.lit(1)).withColumn("score", F.lit("s"))
    rows = gru_lm.score_texts(df, block_bytes=100_000).collect()
    texts = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER)) + ["\0"]) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in texts if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in texts), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], atol=1e-4)
    assert all(np.isfinite(r.score) and r.score <= 1e-6 for r in rows)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 9000 and r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)
    assert gru_lm.score_texts(df.limit(0)).count() == 0


def same_weights(got, want):
    """Up to rounding, which grows with the steps."""
    moved = np.linalg.norm(want.flat() - gru_lm.Network().flat())
    return np.linalg.norm(got.flat() - want.flat()) < 0.05 * moved


def dealt(spark, texts, block=0):
    rows = [(block if isinstance(block, int) else block(i), i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in texts]
    return spark.createDataFrame(rows, "block int, id long, text string, held_out boolean")


def test_weights_learn_from_all_training_texts(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 28))
    texts = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([900, 30, 400, 1, 70, 250])] + [(6, ""), (7, None)]
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    classes, memory = gru_lm.token_classes(Words(pa.array(train, pa.string())))[0], {}
    want = gru_lm.Network()
    want.fit(classes, memory)
    assert same_weights(gru_lm.fit_network(dealt(spark, texts[::-1]), rounds=1), want)


def test_a_pass_goes_over_all_slices(spark):
    texts = [" ".join(f"{c}{i:060d}{c}" for i in range(20_000)) + " " for c in "ab"]  # a slice each
    assert len(list(slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), "text"))) == 2
    want, memory = gru_lm.Network(), {}
    for t in texts:
        want.fit(gru_lm.token_classes(Words(pa.array([t])))[0], memory)
    ids = [i for i in range(9) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert same_weights(gru_lm.fit_network(dealt(spark, list(zip(ids, texts))), rounds=1), want)


def test_blocks_are_averaged_by_their_tokens(spark):
    texts = [(i, f"word{i % 5} " * (40 + 7 * i)) for i in range(12) if zlib.crc32(str(i).encode()) % 7 != 2]
    total, sums = 0, 0.0
    for k in range(3):
        own = gru_lm.Network()
        classes = gru_lm.token_classes(Words(pa.array([t for i, t in texts if i % 3 == k], pa.string())))[0]
        own.fit(classes, {})
        total, sums = total + len(classes), sums + own.flat() * len(classes)
    want = gru_lm.Network().load(sums / total)
    assert same_weights(gru_lm.fit_network(dealt(spark, texts, lambda i: i % 3), rounds=1), want)


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r for r in gru_lm.score_texts(docs.repartition(n), block_bytes=100_000).collect()} for n in (1, 16))
    assert set(one) == set(many)
    assert all(abs(one[i].score - many[i].score) < 1e-6 * max(1, abs(one[i].score)) and one[i].base_score == pytest.approx(many[i].base_score) for i in one)


def test_counts_beyond_32_bits():
    key, count, cls = (np.array([7], t).tobytes() for t in (np.uint64, np.int32, np.uint8))
    most = np.array([2**31 - 1], np.int32).tobytes()
    first, second, tally = gru_lm._merge_counts([key, key], [most, most], [cls, cls])
    assert first.tolist() == second.tolist() == [2**32 - 2] and tally[0].sum() == 2**32 - 2


@pytest.mark.parametrize("size", [1, 31, 2048 + 63, 5000])
def test_a_pass_learns_the_last_tokens_too(size):
    classes = np.random.default_rng(size).integers(0, gru_lm.END, size)
    other = classes.copy()
    other[-1] = (other[-1] + 1) % gru_lm.END
    fitted = [gru_lm.Network() for _ in range(2)]
    for net, c in zip(fitted, (classes, other)):
        net.fit(c, {})
    assert not np.allclose(fitted[0].flat(), fitted[1].flat(), atol=1e-6)


# operator 5

def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(5)
    x, w, y = np.arange(50.0), rng.integers(1, 9, 50).astype(float), rng.random(50)
    at, level = quality.isotonic(x, w, y)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()
    assert quality.isotonic(x, w, np.sort(y))[1] == pytest.approx(np.sort(y))
    assert quality.isotonic(x, w, np.sort(y)[::-1])[1] == pytest.approx([(w * np.sort(y)[::-1]).sum() / w.sum()])


def test_statistics_do_not_depend_on_the_batch():
    whole = quality.statistics(pa.array(ODD, pa.string()))
    assert whole.shape == (len(ODD), len(quality.STATISTICS)) and np.isfinite(whole).all()
    for i, t in enumerate(ODD):
        assert np.allclose(whole[i], quality.statistics(pa.array([t], pa.string()))[0])


def test_quality_on_held_out_rows_and_cases(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, "x", 0) for i, t in enumerate(ODD)] + [(None, "no id", "en", None, None)], docs.schema)
    both = docs.unionAll(extra).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    odd_labels = labels.unionAll(spark.createDataFrame([(None, 1, 0), (-5, 1, 0), (3, None, 0)], labels.schema))
    rows = quality.classify(both, odd_labels).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    kept = quality.accepted(both, odd_labels)
    assert kept.columns == both.columns
    assert kept.count() == sum(r.predicted for r in rows)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).limit(20).collect()} == {0.5}
    unclear = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).unionAll(spark.createDataFrame([(1, float("nan"))], "doc_id long, quality double"))
    same = {r.doc_id: r.score for r in quality.classify(docs, unclear).collect()}
    plain = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert same == pytest.approx(plain)


def test_normal_equations_and_features_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs.repartition(5), labels)
    truth = {r.doc_id: float(r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(r.text, truth[r.doc_id]) for r in docs.collect() if r.doc_id in truth]
    x, y = quality.statistics(pa.array([t for t, _ in rows], pa.string())), np.array([v for _, v in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = model.features(x)
    assert np.allclose(z[:, :-1] if np.allclose(z[:, -1], 1) else z[:, 1:], np.sqrt(2 / quality.WIDTH) * np.cos(np.clip((x - model.mean) / model.scale, -5, 5) @ model.project + model.shift))
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weight, want, atol=1e-6 * np.abs(want).max())
    assert quality.classify(docs.limit(0), labels).count() == 0


# operator 9

@pytest.fixture(scope="module")
def pieces():
    return P.Pieces.load()


def brute_ids(text, pieces, table):
    text = (chr(P.MARK) + text.replace(chr(P.MARK), "").replace(" ", chr(P.MARK))) if text else ""
    out = []
    for word in re.findall(f"{chr(P.MARK)}+[^{chr(P.MARK)}]*", text):
        best, back = [0.0] + [-math.inf] * len(word), [None] * (len(word) + 1)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - pieces.longest), j):
                s = word[i:j]
                if s in table:
                    cost, ids = best[i] + table[s][1], [table[s][0]]
                elif j - i == 1:
                    raw = (chr(P.MARK) if s == "" else s).encode()
                    cost, ids = best[i] + len(raw) * pieces.byte_score, [int(pieces.byte_id[b]) for b in raw]
                else:
                    continue
                if cost > best[j]:
                    best[j], back[j] = cost, (i, ids)
        j, ids = len(word), []
        while j:
            j, part = back[j]
            ids = part + ids
        out += ids
    return out


def test_search_matches_brute_force_and_decodes(spark, pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)
    table = {model.id_to_piece(i): (i, -math.log(i + 1)) for i in range(model.vocab_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    texts += [t for t in ODD if t is None or len(t) < 1000] + ["a  b   c\nd", "ab" * 300]
    encoder = P.Encoder(pieces, cache_words=2000)
    for _ in range(2):  # the second time from the kept words
        lists = encoder.encode(pa.array(texts, pa.string()))
        got = lists.to_pylist()
        for t, ids in zip(texts, got):
            assert ids == (None if t is None else brute_ids(t, pieces, table))
            assert t is None or chr(P.MARK) in t or model.decode(ids) == t
        assert P.decode(lists, pieces).to_pylist() == texts


def test_round_trip_of_odd_texts_in_spark(spark, pieces):
    rows = [(i, t, [1], "d") for i, t in enumerate(ODD + ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    back = P.decode_documents(P.encode_documents(df, pieces), pieces, name="again")
    assert back.columns == ["doc_id", "text", "ids", "decoded", "piece_ids", "again"]
    assert {r.doc_id: r.again for r in back.collect()} == {i: t for i, t, _, _ in rows}
    assert P.encode_documents(df.limit(0), pieces).count() == 0


def test_hnsw_pairs_never_pass_the_driver(spark):
    """Blocks are small, blocks times shards are not: their join is never a broadcast."""
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = hnsw.self_search(table, every=5, k=3, shard_rows=8)
    assert out.count() == 12 * 3
    index = hnsw.build_index(table, "vec_id", "embedding", 4, 8)
    found = hnsw.nearest(table, index, "vec_id", "embedding", 3)
    assert len(found.collect()) == 60 * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
