"""K7-K9: attention between each essay and the rubric of its set.

The oracles score each essay's distinct words with their counts;
``tests/test_attention.py`` also checks the operators against a loop over
all word pairs on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import attention as A
from gradeflow.operators import attention_store as AS
from gradeflow.operators import vocab as V
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.registry import register
from gradeflow.session import keep_dictionaries
from gradeflow.sources import io as IO

CAP, DIM = 10000, 64


def _seq_sql(src, id_col, text_col, pos_name):
    """Capped V3 token ids with their position inside the id sequence (SQL)."""
    return f"""SELECT t.{id_col}, CAST(v."index" AS INTEGER) AS wid,
    CAST(row_number() OVER (PARTITION BY t.{id_col} ORDER BY t.p) - 1 AS INTEGER) AS {pos_name}
  FROM (SELECT {id_col}, unnest(tk) AS word, generate_subscripts(tk, 1) AS p
        FROM (SELECT {id_col}, {S.keras_tokens(text_col)} AS tk FROM {src})) t
  JOIN vocab v ON t.word = v.word WHERE v."index" < {CAP}"""


def inputs(spark, d, vocab=None):
    vocab = vocab if vocab is not None else B.corpus_vocab(spark, d)
    essays = B.texts(spark, d)
    seqs = V.texts_to_sequences(essays, vocab, num_words=CAP).select("essay_id", "essay_set", "seq")
    ph = B.phrases(spark, d)
    pseq = V.texts_to_sequences(ph, vocab, id_col="key_id", text_col="phrase", num_words=CAP).select("key_id", "essay_set", "seq")
    vectors = B.vectors_from(vocab, B.table(spark, d, "embeddings"))
    return seqs, pseq, vocab, vectors


def keyword_attention_query(spark, d):
    keep_dictionaries(spark)
    seqs, pseq, vocab, vectors = inputs(spark, d)
    return A.keyword_attention(seqs, pseq, vocab, vectors, DIM, CAP, decimals=6)


def _k7_sql(score="{z}", over_key="/ ps.m", over_words="/ ne.n", gate="1.0::DOUBLE", merged=None):
    """Attention from distinct words, dp / mean / concat unless said otherwise: ``score``
    of a product, the divisors of the pooling, the ``gate`` by the best score, the merge.  With c_w the count
    of word w in the essay, u = sum_w beta_w a_w with beta_w = mean over key
    words i of the softmax weight c_w e^{z_iw} / sum_w' c_w' e^{z_iw'}, and
    v = sum_i delta_i k_i with delta_i = sum_w c_w softmax_i(z_iw) / n.
    Words without a vector are folded into one zero word per essay."""
    dims = range(1, DIM + 1)
    u_vec = ", ".join(f"sum(b.b * av.vec[{d}])" for d in dims)
    v_vec = ", ".join(f"sum(dl.dlt * coalesce(p.kvec[{d}], 0.0))" for d in dims)
    product = score.format(z="list_dot_product(p.kvec, av.vec)")
    merged = merged or "list_concat({u}, {v})"
    zeros = f"list_resize(CAST([] AS DOUBLE[]), {DIM}, 0.0)"
    return S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS) + f""", vv AS (
  SELECT CAST(v."index" AS INTEGER) AS wid, list_transform(x.vec, lambda y: CAST(y AS DOUBLE)) AS vec
  FROM vocab v JOIN vectors x ON v.word = x.word WHERE v."index" < {CAP}),
es AS ({_seq_sql('essays', 'essay_id', 'essay', 'apos')}),
pt AS ({_seq_sql('phrases', 'key_id', 'phrase', 'kpos')}),
ne AS (SELECT essay_id, count(*) AS n FROM es GROUP BY essay_id),
cand AS (
  SELECT es.essay_id, es.wid, count(*) AS c FROM es JOIN vv ON es.wid = vv.wid GROUP BY es.essay_id, es.wid
  UNION ALL
  SELECT es.essay_id, -1 AS wid, count(*) AS c FROM es LEFT JOIN vv ON es.wid = vv.wid
  WHERE vv.wid IS NULL GROUP BY es.essay_id),
pk AS (SELECT pt.key_id, ph.essay_set, pt.kpos, vv.vec AS kvec FROM pt JOIN phrases ph ON pt.key_id = ph.key_id LEFT JOIN vv ON pt.wid = vv.wid),
psize AS (SELECT key_id, count(*) AS m FROM pt GROUP BY key_id),
z AS (
  SELECT c.essay_id, p.key_id, p.kpos, c.wid, c.c,
         CASE WHEN p.kvec IS NULL OR av.vec IS NULL THEN 0.0 ELSE {product} END AS z
  FROM cand c JOIN essays e ON c.essay_id = e.essay_id JOIN pk p ON e.essay_set = p.essay_set LEFT JOIN vv av ON c.wid = av.wid),
zm AS (SELECT *, max(z) OVER (PARTITION BY essay_id, key_id, kpos) AS mi,
                 max(z) OVER (PARTITION BY essay_id, key_id, wid) AS mw FROM z),
ze AS (SELECT *, c * exp(z - mi) AS an, exp(z - mw) AS gn FROM zm),
zs AS (SELECT *, sum(an) OVER (PARTITION BY essay_id, key_id, kpos) AS ad,
                 sum(gn) OVER (PARTITION BY essay_id, key_id, wid) AS gd FROM ze),
beta AS (SELECT zs.essay_id, zs.key_id, zs.wid, sum(an / ad * {gate.format(z='mi')}) {over_key} AS b
  FROM zs JOIN psize ps ON zs.key_id = ps.key_id WHERE zs.wid >= 0 GROUP BY zs.essay_id, zs.key_id, zs.wid, ps.m),
delta AS (SELECT zs.essay_id, zs.key_id, zs.kpos, sum(zs.c * gn / gd * {gate.format(z='mw')}) {over_words} AS dlt
  FROM zs JOIN ne ON zs.essay_id = ne.essay_id GROUP BY zs.essay_id, zs.key_id, zs.kpos, ne.n),
u AS (SELECT b.essay_id, b.key_id, [{u_vec}] AS u FROM beta b JOIN vv av ON b.wid = av.wid GROUP BY b.essay_id, b.key_id),
v AS (SELECT dl.essay_id, dl.key_id, [{v_vec}] AS v
  FROM delta dl JOIN pk p ON dl.key_id = p.key_id AND dl.kpos = p.kpos GROUP BY dl.essay_id, dl.key_id),
k7 AS (SELECT e.essay_id, k.key_id,
  list_transform({merged.format(u=f'coalesce(u.u, {zeros})', v=f'coalesce(v.v, {zeros})')},
                 lambda x: CASE WHEN round(x, 6) = 0 THEN 0.0 ELSE round(x, 6) END) AS f
FROM essays e JOIN phrases k ON e.essay_set = k.essay_set
LEFT JOIN u ON u.essay_id = e.essay_id AND u.key_id = k.key_id
LEFT JOIN v ON v.essay_id = e.essay_id AND v.key_id = k.key_id)
"""


K7_SQL = _k7_sql() + "SELECT essay_id, key_id, f FROM k7"
K8_SQL = _k7_sql() + "SELECT essay_id, flatten(list(f ORDER BY key_id)) AS keyword_features FROM k7 GROUP BY essay_id"

register("K7_keyword_attention", K7_SQL)(keyword_attention_query)


def with_options(**options):
    def query(spark, d):
        keep_dictionaries(spark)
        return A.keyword_attention(*inputs(spark, d), DIM, CAP, decimals=6, **options)

    return query


_NORM = "greatest(sqrt(list_dot_product({0}, {0})), sqrt(1e-7::DOUBLE))"
register(
    "K7_keyword_attention_cos_gate",
    _k7_sql(f"{{z}} / {_NORM.format('p.kvec')} / {_NORM.format('av.vec')}", gate="(1 / (1 + exp(-5 * {z})))") + "SELECT essay_id, key_id, f FROM k7",
)(with_options(op="cos", beta=True))

register(
    "K7_keyword_attention_sdp_sum",
    _k7_sql(f"{{z}} / sqrt({DIM}::DOUBLE)", "", "", merged=f"list_transform(range(1, {DIM + 1}), lambda i: (({{u}})[i] + ({{v}})[i]) / 2)")
    + "SELECT essay_id, key_id, f FROM k7",
)(with_options(op="sdp", pool="sum", merge="mean"))

# max pooling needs the vector that every phrase word sees, of every essay: too much for the SQL
register("K7_keyword_attention_max")(with_options(pool="max", beta=True))


def keyword_features_query(spark, d):
    keep_dictionaries(spark)
    seqs, pseq, vocab, vectors = inputs(spark, d)
    return A.answer_features(seqs, pseq, vocab, vectors, DIM, CAP, decimals=6)


register("K8_keyword_features", K8_SQL)(keyword_features_query)


def top_words_query(spark, d):
    seqs, pseq, vocab, vectors = inputs(spark, d)
    top = A.attention_top_words(seqs, pseq, vocab, vectors, DIM, CAP)
    # ids in sequences are below CAP, so CAP words at most go to all tasks and the many rows stay where they are
    words = vocab.filter(F.col("index") < CAP).select(F.col("index").cast("int").alias("word_id"), "word")
    return top.join(F.broadcast(words), "word_id", "left")


# The argmax over answer positions only needs, per essay, the first
# position of each distinct word that has a vector, plus the earliest word
# without one (all of those score exactly 0).
K9_SQL = S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS) + f""", vv AS (
  SELECT CAST(v."index" AS INTEGER) AS wid, list_transform(x.vec, lambda y: CAST(y AS DOUBLE)) AS vec
  FROM vocab v JOIN vectors x ON v.word = x.word WHERE v."index" < {CAP}),
es AS ({_seq_sql('essays', 'essay_id', 'essay', 'apos')}),
pt AS ({_seq_sql('phrases', 'key_id', 'phrase', 'kpos')}),
cand AS (
  SELECT es.essay_id, es.wid, min(es.apos) AS apos FROM es JOIN vv ON es.wid = vv.wid GROUP BY es.essay_id, es.wid
  UNION ALL
  SELECT es.essay_id, NULL AS wid, min(es.apos) AS apos FROM es LEFT JOIN vv ON es.wid = vv.wid
  WHERE vv.wid IS NULL GROUP BY es.essay_id),
pw AS (SELECT DISTINCT ph.essay_set, p.wid FROM pt p JOIN phrases ph ON p.key_id = ph.key_id),
sc AS MATERIALIZED (
  SELECT k.wid AS kwid, a.wid AS awid, list_dot_product(kv.vec, a.vec) AS z
  FROM (SELECT DISTINCT wid FROM pw) k JOIN vv kv ON k.wid = kv.wid, vv a),
scored AS (
  SELECT c.essay_id, w.wid AS kwid, c.apos, coalesce(sc.z, 0.0) AS z
  FROM cand c JOIN essays e ON c.essay_id = e.essay_id JOIN pw w ON e.essay_set = w.essay_set
  LEFT JOIN sc ON sc.kwid = w.wid AND sc.awid = c.wid),
top AS (SELECT essay_id, kwid, max(z) AS z FROM scored GROUP BY essay_id, kwid),
one AS (SELECT s.essay_id, s.kwid, min(s.apos) AS apos FROM scored s JOIN top t ON s.essay_id = t.essay_id AND s.kwid = t.kwid AND s.z = t.z
  GROUP BY s.essay_id, s.kwid),
best AS (
  SELECT o.essay_id, p.key_id, p.kpos, o.apos
  FROM one o JOIN essays e ON o.essay_id = e.essay_id JOIN phrases ph ON e.essay_set = ph.essay_set
  JOIN pt p ON p.key_id = ph.key_id AND p.wid = o.kwid)
SELECT b.essay_id, b.key_id, b.kpos, b.apos, es.wid AS word_id, v.word
FROM best b JOIN es ON b.essay_id = es.essay_id AND b.apos = es.apos
LEFT JOIN vocab v ON es.wid = v."index\""""

register("K9_attention_top_words", K9_SQL)(top_words_query)


def attention_weights_query(spark, d):
    """S10 with all weights: written as factors, restored and summed up for each
    essay and phrase."""
    path = IO.scratch_path(spark, "attention_weights")
    AS.write_attention_weights(*inputs(spark, d), path, DIM, CAP)
    sums = AS.attention_sums(spark, path)
    return sums.select("essay_id", "key_id", "n_key", "n_words", *[F.round(c, 6).alias(c) for c in ("z", "z_ans", "z_key", "beta_ans", "beta_key")])


_FLOOR = "sqrt(1e-7::DOUBLE)"
S10_WEIGHTS_SQL = _k7_sql().split("beta AS (SELECT zs.essay_id")[0].rstrip().rstrip(",") + f""",
norm AS (SELECT wid, greatest(sqrt(list_dot_product(vec, vec)), {_FLOOR}) AS nrm FROM vv),
cz AS (
  SELECT zs.*, zs.z / greatest(coalesce(nk.nrm, {_FLOOR}), {_FLOOR}) / coalesce(na.nrm, {_FLOOR}) AS cs
  FROM zs JOIN pt ON zs.key_id = pt.key_id AND zs.kpos = pt.kpos LEFT JOIN norm nk ON pt.wid = nk.wid LEFT JOIN norm na ON zs.wid = na.wid),
gi AS (SELECT essay_id, key_id, sum(g) AS beta_ans FROM (
  SELECT essay_id, key_id, kpos, 1 / (1 + exp(-5 * max(cs))) AS g FROM cz GROUP BY essay_id, key_id, kpos) GROUP BY essay_id, key_id),
gw AS (SELECT essay_id, key_id, sum(c * g) AS beta_key FROM (
  SELECT essay_id, key_id, wid, c, 1 / (1 + exp(-5 * max(cs))) AS g FROM cz GROUP BY essay_id, key_id, wid, c) GROUP BY essay_id, key_id),
zz AS (SELECT essay_id, key_id, sum(c * z) AS z, sum(c * (an / c / ad) * (an / c / ad)) AS z_ans, sum(c * (gn / gd) * (gn / gd)) AS z_key
  FROM zs GROUP BY essay_id, key_id)
SELECT e.essay_id, k.key_id, CAST(coalesce(m.m, 0) AS INTEGER) AS n_key, CAST(coalesce(ne.n, 0) AS INTEGER) AS n_words,
  {", ".join(S.r6(f"coalesce({c}, 0.0)") + f" AS {c.split('.')[1]}" for c in ("zz.z", "zz.z_ans", "zz.z_key", "gi.beta_ans", "gw.beta_key"))}
FROM essays e JOIN phrases k ON e.essay_set = k.essay_set
LEFT JOIN psize m ON m.key_id = k.key_id LEFT JOIN ne ON ne.essay_id = e.essay_id
LEFT JOIN zz ON zz.essay_id = e.essay_id AND zz.key_id = k.key_id
LEFT JOIN gi ON gi.essay_id = e.essay_id AND gi.key_id = k.key_id
LEFT JOIN gw ON gw.essay_id = e.essay_id AND gw.key_id = k.key_id"""

register("S10_write_attention_weights", S10_WEIGHTS_SQL)(attention_weights_query)
