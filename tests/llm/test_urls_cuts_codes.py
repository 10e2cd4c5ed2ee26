"""Operators 11, 12 and 13 against plain loops over odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import fill_middle, url_cascade, vector_codes

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


# operator 11

def judged(url, rules):
    """Host, path, rule and verdict of one url by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, action in rules:
        p = p or ""
        if h and action in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p) and p[:1] in ("", "/"):
            best = max(best or (-1,), (len(h + p), h.count("."), action, h + p))
    return host, path, best and best[3], best[2] if best else "allow"


ODD_URLS = [None, "", "no scheme", "http://", "http:///", "://a.b/x", "HTTP://A.B/X?q#f", "http://b#x/y", "http://b?x/y", "http://x..b/", "http://É.b/É",
            "http://u:p@b:80/x", "x://y://b/x", "http://b/x\ny", "http://b/" + "p" * 5000]


@pytest.mark.parametrize("part_bits", [url_cascade.PART_BITS, 256])
def test_urls_match_a_loop_over_the_rules(spark, part_bits):
    rng = random.Random(3)
    labels = ["a", "b", "c", "d", "ab"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/x", "/y", "z", "/"]) for _ in range(rng.randint(0, 3)))
    rules = [(host(), rng.choice(["", "/"]) + path().lstrip("/"), rng.choice(["allow", "block"])) for _ in range(25)]
    rules = [(h, p if not p or p[0] == "/" else "/" + p, a) for h, p, a in rules]
    rules += [(None, "/", "block"), ("", "/", "block"), ("b", "x", "block"), ("a.b", None, "block"), ("c", "/x", "other"), rules[0], (*rules[1][:2], "block"), (*rules[1][:2], "allow")]
    urls = ODD_URLS + [f"https://{host()}/{path().lstrip('/')}{rng.choice(['', '?q=1', '#f'])}" for _ in range(400)]
    urls += ["http://a.b/x"] * 50
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_cascade.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"), part_bits=part_bits)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [((i if i % 9 else None), *judged(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = universe.filter("crc32(key) % 7 = 0")
    levels = url_cascade.build_cascade(universe.union(universe.limit(900)), keys, 5000)
    assert [x.number for x in levels] == list(range(1, len(levels) + 1)) and len(levels) > 2
    wrong = universe.filter(url_cascade.listed(levels, F.col("key")) != (F.crc32("key") % 7 == 0))
    assert wrong.count() == 0
    bits = sum(x.bits for x in levels)
    assert bits < keys.count() * 12
    assert url_cascade.build_cascade(universe, keys.limit(0), 5000) == []


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    rules = url_cascade.rule_table(spark, url_cascade.RULES)
    assert url_cascade.judge_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_cascade.judge_urls(pages, rules.limit(0)).collect()] == [(1, "a", "/b", None, "allow")]


# operator 12

def cut(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_matches_a_loop(spark):
    rng = random.Random(5)
    odd = [None, "", "a", "é", "<P>", "x<M>y", "<", "<<S", "a" * 3000, "ab😀" * 2000, "\n" * 700, "word " * 40_000, "<S" * 300, "M>P>S>" * 50]
    odd += ["".join(rng.choice("ab<PSM>é😀 \n") for _ in range(rng.randint(0, 1500))) for _ in range(300)]
    rows = [(i if i != 7 else None, t, "clash", 5) for i, t in enumerate(odd)] + [(3, "é", "clash", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, x int")
    for seed, rate, spm in ((1, 90, 20), (8, 100, 50)):
        got = fill_middle.fill_in_middle(docs, seed=seed, rate=rate, spm=spm)
        assert got.columns == ["doc_id", "text", "x", *fill_middle.RESULTS]
        back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        want = [(i, t, *cut(i, t, seed, rate, spm)) for i, t, _, _ in rows]
        assert sorted(str((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in back) == sorted(map(str, want))
        assert all(r.back == (r.text or "") for r in back)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fenwick_descent():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 8, 65):
        counts = rng.integers(0, 4, (n, 2))
        tree, before = fill_middle.Fenwick(counts), np.r_[np.zeros((1, 2), int), counts.cumsum(axis=0)]
        assert (tree.before(np.arange(n + 1)) == before).all()
        wanted = np.arange(1, before[-1, 0] + 1)
        block, sums = tree.descend(wanted)
        assert block.tolist() == [int(np.flatnonzero(before[1:, 0] >= w)[0]) for w in wanted]
        assert (sums == before[block]).all()


def test_cuts_at_every_unit_and_block_size():
    texts = pa.array(["ab é😀c", None, "", "zz", "<" * 9, "é" * 40 + "abc" * 30])
    for block in (1, 3, 64):
        units = fill_middle.Units(texts, block)
        want = [UNIT.findall(t or "") for t in texts.to_pylist()]
        assert units.n_units.tolist() == [len(w) for w in want]
        for k in range(max(map(len, want)) + 1):
            at = np.array([min(k, len(w)) for w in want])
            assert units.points_before(at).tolist() == [len("".join(w[:c])) for w, c in zip(want, at)]


# operator 13

def lloyd_loop(rows, parts, entries, rounds):
    """Codes, errors and codebooks by trying every entry for every part."""
    kept = [r for r in rows if r[1] and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and len(r[1]) % parts == 0]
    out, digests = [], {}
    for length in sorted({len(r[1]) for r in kept}):
        mine = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        v = [[int(np.floor(1024 * float(np.float32(x)))) for x in r[1]] for r in mine]
        w = length // parts
        books = [[x[p * w : p * w + w] for x in v[:entries]] for p in range(parts)]
        for last in [False] * rounds + [True]:
            far = [[[sum((a - b) ** 2 for a, b in zip(x[p * w : p * w + w], c)) for c in books[p]] for p in range(parts)] for x in v]
            code = [[d.index(min(d)) for d in x] for x in far]
            if not last:
                for p in range(parts):
                    for e in range(len(books[p])):
                        held = [x[p * w : p * w + w] for x, c in zip(v, code) if c[p] == e]
                        if held:
                            books[p][e] = [sum(c) // len(held) for c in zip(*held)]
        digests[length] = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        out += [(r[0], r[2], "".join(f"{c:02x}" for c in cs), sum(map(min, f)), digests[length]) for r, cs, f in zip(mine, code, far)]
    return out


def vectors(n, length, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, length))
    return (middle[rng.integers(0, 6, n)] + rng.normal(scale=0.1, size=(n, length))).astype(np.float32).tolist()


@pytest.mark.parametrize("partitions,block_rows", [(1, 2048), (7, 16)])
def test_codes_match_a_loop(spark, partitions, block_rows):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(150, 8))] + [(500 + i, v, None) for i, v in enumerate(vectors(9, 4))]
    rows += [(3, rows[3][1], 1)] * 40 + [(None, rows[5][1], 2), (7, rows[20][1], 2), (601, [0.5] * 8, 9), (602, [0.5] * 8, 9)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 6, 1), (903, [float("nan")] * 8, 1), (904, [1.0, None] * 4, 1), (905, [float("inf")] * 8, 1)]
    table = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(partitions)
    want = lloyd_loop(rows, 4, 16, 3)
    codes, books = vector_codes.compress(table, entries=16, rounds=3, block_rows=block_rows)
    got = vector_codes.with_label_error(codes).collect()
    assert sorted(books) == [4, 8]
    assert sorted(str((r.vec_id, r.code, r.error, r.codebooks_sha256)) for r in got) == sorted(str((w[0], *w[2:])) for w in want)
    total = {}
    for w in want:
        total[w[1]] = total.get(w[1], 0) + w[3]
    assert all(r.label_error == total[int(r.label) if r.label is not None else None] for r in got)


def test_codes_of_empty_and_huge(spark):
    table = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.with_label_error(vector_codes.compress(table.limit(0))[0]).count() == 0
    with pytest.raises(Exception, match="would not fit a long"):
        vector_codes.compress(table)


@pytest.mark.parametrize("k,n,spread", [(1, 5, 1000), (5, 1, 1000), (16, 700, 2000), (37, 900, 3), (256, 2048, 300)])
def test_joint_descent_is_exact(k, n, spread):
    rng = np.random.default_rng(k)
    centre = rng.integers(-spread, spread, (12, 6))
    points = centre[rng.integers(0, 12, n)] + rng.integers(-spread // 50 - 1, spread // 50 + 2, (n, 6))
    entries = points[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, 6))
    batch = vector_codes._pack(list(range(n)), [None] * n, points, 1)
    tree = vector_codes._unpack({c: batch.column(c)[0].as_py() for c in batch.schema.names}, 1, 6)[0]
    codes = np.empty(len(tree["points"]), dtype=np.int64)
    sums, counts, whole = vector_codes.assign(tree, vector_codes.Book(entries), codes)
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    want = far.argmin(axis=1)
    got = np.empty(n, dtype=np.int64)
    got[tree["place"][tree["real"]]] = codes[tree["real"]]
    assert (got == want).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    assert (sums == np.stack([points[want == e].sum(axis=0) for e in range(k)])).all()
    if k == 16:
        assert whole > 0  # cached sums settled whole nodes
