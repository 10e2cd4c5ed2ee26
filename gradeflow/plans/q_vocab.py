"""V1-V11 over the essays, the phrases and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import vocab as V
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.registry import register

CAP = 10000  # num_words of the reference's tokenizer
DIM = 64

EV = S.with_(S.ESSAYS, S.PHRASES, S.VOCAB)

# essay token ids (capped), as SQL
SEQ_SQL = f""", et AS (
  SELECT essay_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos
  FROM (SELECT essay_id, {S.keras_tokens('essay')} AS t FROM essays)),
sq AS (
  SELECT et.essay_id, list(CAST(v."index" AS INTEGER) ORDER BY et.pos) AS seq
  FROM et JOIN vocab v ON et.word = v.word WHERE v."index" < {CAP} GROUP BY et.essay_id),
seqs AS (
  SELECT e.essay_id, coalesce(sq.seq, CAST([] AS INTEGER[])) AS seq FROM essays e LEFT JOIN sq ON e.essay_id = sq.essay_id)
"""


def _seqs(spark, d, cap=CAP):
    e = B.texts(spark, d)
    return V.texts_to_sequences(e.select("essay_id", "essay"), B.corpus_vocab(spark, d), num_words=cap)


register("V1_tokenize", S.with_(S.ESSAYS) + f"SELECT essay_id, {S.keras_tokens('essay')} AS tokens FROM essays")(
    lambda spark, d: V.tokenize(B.texts(spark, d)).select("essay_id", "tokens")
)

register("V2_fit_vocab", EV + 'SELECT word, count, "index" FROM vocab')(
    lambda spark, d: B.corpus_vocab(spark, d)
)

register("V3_texts_to_sequences", EV + SEQ_SQL + "SELECT essay_id, seq FROM seqs")(
    lambda spark, d: _seqs(spark, d).select("essay_id", "seq")
)

register("V4_pad_sequences", EV + SEQ_SQL + f"SELECT essay_id, list_resize(seq, (SELECT max(len(seq)) FROM seqs), 0) AS padded FROM seqs")(
    lambda spark, d: V.pad_sequences(_seqs(spark, d), "seq").select("essay_id", "padded")
)

register(
    "V5_token_mask",
    EV + SEQ_SQL + f"SELECT essay_id, list_transform(list_resize(seq, (SELECT max(len(seq)) FROM seqs), 0), lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END) AS mask FROM seqs",
)(lambda spark, d: V.token_mask(V.pad_sequences(_seqs(spark, d), "seq")).select("essay_id", "mask"))


def _r6_vec(c):
    return F.transform(F.col(c), lambda x: F.round(x.cast("double"), 6)).alias(c)


register(
    "V6_build_embedding_matrix",
    S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS)
    + f"""SELECT v."index", v.word,
  list_transform(coalesce(x.vec, list_resize(CAST([] AS FLOAT[]), {DIM}, 0.0)), lambda y: round(CAST(y AS DOUBLE), 6)) AS vec
FROM vocab v LEFT JOIN vectors x ON v.word = x.word WHERE v."index" < {CAP}""",
)(
    lambda spark, d: (
        lambda vocab: V.build_embedding_matrix(
            vocab, B.vectors_from(vocab, B.table(spark, d, "embeddings")), DIM, vocab_size=CAP
        ).select("index", "word", _r6_vec("vec"))
    )(B.corpus_vocab(spark, d))
)

register(
    "V7_embedding_coverage",
    S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS)
    + """SELECT CAST(count(*) AS BIGINT) AS vocab_size, CAST(count(x.word) AS BIGINT) AS with_vector,
  CAST(count(*) - count(x.word) AS BIGINT) AS without_vector FROM vocab v LEFT JOIN vectors x ON v.word = x.word""",
)(
    lambda spark, d: (
        lambda vocab: V.embedding_coverage(vocab, B.vectors_from(vocab, B.table(spark, d, "embeddings")))
    )(B.corpus_vocab(spark, d))
)


def _basic_english_sql(e):
    steps = [
        ("'", " '  "), ('"', ""), (r"\.", " . "), ("<br />", " "), (",", " , "), (r"\(", " ( "),
        (r"\)", " ) "), ("!", " ! "), (r"\?", " ? "), (";", " "), (":", " "), (r"[ \t\n\r\f\x{0B}]+", " "),
    ]
    x = f"lower({e})"
    for pat, rep in steps:
        x = f"regexp_replace({x}, {S.q(pat)}, {S.q(rep)}, 'g')"
    return f"list_filter(string_split(trim({x}), ' '), lambda w: w <> '')"


register(
    "V8_basic_english_vocab",
    S.with_(S.ESSAYS)
    + f""", bw AS (SELECT unnest({_basic_english_sql('essay')}) AS word FROM essays),
bc AS (SELECT word, count(*) AS cnt FROM bw GROUP BY word ORDER BY cnt DESC, word LIMIT {CAP})
SELECT '<unk>' AS word, CAST(NULL AS BIGINT) AS count, CAST(0 AS BIGINT) AS "index"
UNION ALL SELECT '<pad>', NULL, 1
UNION ALL SELECT word, CAST(cnt AS BIGINT), CAST(row_number() OVER (ORDER BY cnt DESC, word) + 1 AS BIGINT) FROM bc""",
)(lambda spark, d: V.basic_english_vocab(B.texts(spark, d), max_size=CAP))

register(
    "V9_clean_oov",
    EV
    + SEQ_SQL.replace(f'WHERE v."index" < {CAP}', "")
    + "SELECT essay_id, len(seq) AS n_ids FROM seqs WHERE NOT list_bool_or(list_transform(seq, lambda x: x >= 5000)) OR len(seq) = 0",
)(
    lambda spark, d: V.clean_oov(_seqs(spark, d, cap=None), "seq", 5000).select(
        "essay_id", F.size("seq").alias("n_ids")
    )
)

MAX_SENTS, MAX_WORDS = 50, 100
register(
    "V10_encode_hierarchical",
    EV
    + f""", sents AS (
  SELECT essay_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sp
  FROM (SELECT essay_id, regexp_split_to_array(essay, {S.q(S.P.SENTENCE_END)}) AS s FROM essays)),
st AS (SELECT essay_id, sp, unnest(t) AS word, generate_subscripts(t, 1) AS pos
  FROM (SELECT essay_id, sp, {S.keras_tokens('sentence')} AS t FROM sents WHERE sp <= {MAX_SENTS})),
rs AS (SELECT st.essay_id, st.sp, list(CAST(v."index" AS INTEGER) ORDER BY st.pos) AS r
  FROM st JOIN vocab v ON st.word = v.word WHERE v."index" < {CAP} GROUP BY st.essay_id, st.sp),
rows_ AS (SELECT s.essay_id, s.sp, list_resize(coalesce(rs.r, CAST([] AS INTEGER[])), {MAX_WORDS}, 0) AS r
  FROM sents s LEFT JOIN rs ON s.essay_id = rs.essay_id AND s.sp = rs.sp WHERE s.sp <= {MAX_SENTS})
SELECT essay_id, list_resize(list(r ORDER BY sp), {MAX_SENTS}, list_resize(CAST([] AS INTEGER[]), {MAX_WORDS}, 0)) AS matrix
FROM rows_ GROUP BY essay_id""",
)(
    lambda spark, d: V.encode_hierarchical(
        B.texts(spark, d).select("essay_id", "essay"), B.corpus_vocab(spark, d), max_sents=MAX_SENTS, max_words=MAX_WORDS
    )
)

register(
    "V11_mean_embedding",
    S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS)
    + f""", et AS (SELECT essay_id, unnest({S.keras_tokens('essay')}) AS word FROM essays),
nt AS (SELECT essay_id, count(*) AS n FROM et GROUP BY essay_id),
ev AS (SELECT et.essay_id, unnest(x.vec) AS v, generate_subscripts(x.vec, 1) AS d FROM et JOIN vectors x ON et.word = x.word),
sm AS (SELECT essay_id, d, sum(CAST(v AS DOUBLE)) AS s FROM ev GROUP BY essay_id, d),
mv AS (SELECT sm.essay_id, list({S.r6('sm.s / nt.n')} ORDER BY sm.d) AS mean_vec FROM sm JOIN nt ON sm.essay_id = nt.essay_id GROUP BY sm.essay_id)
SELECT e.essay_id, coalesce(mv.mean_vec, list_resize(CAST([] AS DOUBLE[]), {DIM}, 0.0)) AS mean_vec
FROM essays e LEFT JOIN mv ON e.essay_id = mv.essay_id""",
)(
    lambda spark, d: (
        lambda vocab: V.mean_embedding(
            B.texts(spark, d), B.vectors_from(vocab, B.table(spark, d, "embeddings")), DIM
        ).select("essay_id", _r6_vec("mean_vec"))
    )(B.corpus_vocab(spark, d))
)
