"""N1-N14 over the ``num`` (lineitem) and ``cat`` (orders) bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions.text import num_words
from gradeflow.operators import categorical as CT
from gradeflow.operators import numeric as NU
from gradeflow.operators import vocab as V
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.joins import lookup_join
from gradeflow.plans.registry import register
from gradeflow.session import keep_dictionaries

NUMK = ["l_orderkey", "l_linenumber", "split"]
WN = S.with_(S.NUM)
WC = S.with_(S.CAT)


def _r6(c, alias=None):
    return F.round(F.col(c), 6).alias(alias or c)


# ---------------------------------------------------------------- N1
register(
    "N1_impute_median",
    WN
    + """, med AS (SELECT split, quantile_cont(l_quantity, 0.5) AS m FROM num GROUP BY split)
SELECT l_orderkey, l_linenumber, num.split, round(coalesce(l_quantity, med.m), 6) AS l_quantity
FROM num JOIN med ON num.split = med.split""",
)(lambda spark, d: NU.impute_median(B.num(spark, d), ["l_quantity"], by="split").select(*NUMK, _r6("l_quantity")))


# ---------------------------------------------------------------- N2 / N3
def _grid_sql():
    return "[" + ", ".join(f"{x}::DOUBLE" for x in NU.LAMBDA_GRID) + "]"


def _yj_sql(x, lam):
    return (
        f"CASE WHEN {x} >= 0 THEN (CASE WHEN {lam} = 0 THEN ln({x} + 1) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END) "
        f"ELSE (CASE WHEN {lam} = 2 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END) END"
    )


def _bc_sql(x, lam):
    return f"CASE WHEN {lam} = 0 THEN ln({x}) ELSE (pow({x}, {lam}) - 1) / {lam} END"


def _power_sql(col, tr, jac):
    return (
        WN
        + f""", tr AS (SELECT CAST({col} AS DOUBLE) AS x FROM num WHERE split = 'train' AND {col} IS NOT NULL),
g AS (SELECT unnest({_grid_sql()}) AS lam),
ll AS (SELECT g.lam, -count(*) / 2.0 * ln(var_pop({tr('x', 'g.lam')})) + (g.lam - 1) * sum({jac}) AS ll
       FROM tr, g GROUP BY g.lam HAVING var_pop({tr('x', 'g.lam')}) > 0),
best AS (SELECT lam FROM ll ORDER BY ll DESC, lam LIMIT 1),
st AS (SELECT avg({tr('x', 'best.lam')}) AS m, coalesce(nullif(stddev_pop({tr('x', 'best.lam')}), 0), 1) AS s FROM tr, best)
SELECT l_orderkey, l_linenumber, split,
  round(({tr(f'CAST({col} AS DOUBLE)', 'best.lam')} - st.m) / st.s, 6) AS {col}
FROM num, best, st"""
    )


register("N2_yeo_johnson", _power_sql("l_quantity", _yj_sql, "sign(x) * ln(abs(x) + 1)"))(
    lambda spark, d: (
        lambda n: NU.power_transform(n, ["l_quantity"], "yeo-johnson", fit_on=n.filter(F.col("split") == "train"))
    )(B.num(spark, d)).select(*NUMK, _r6("l_quantity"))
)

register("N3_box_cox", _power_sql("l_extendedprice", _bc_sql, "ln(x)"))(
    lambda spark, d: (
        lambda n: NU.power_transform(n, ["l_extendedprice"], "box-cox", fit_on=n.filter(F.col("split") == "train"))
    )(B.num(spark, d)).select(*NUMK, _r6("l_extendedprice"))
)


# ---------------------------------------------------------------- N4
def _horner_sql(coefs, x):
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}) * {x} + {c!r}"
    return acc


def _probit_sql(p):
    qlo, qhi, q, r = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low = f"({_horner_sql(NU.ACKLAM_C, qlo)}) / (({_horner_sql(NU.ACKLAM_D, qlo)}) * {qlo} + 1)"
    high = f"-({_horner_sql(NU.ACKLAM_C, qhi)}) / (({_horner_sql(NU.ACKLAM_D, qhi)}) * {qhi} + 1)"
    mid = f"({_horner_sql(NU.ACKLAM_A, r)}) * {q} / (({_horner_sql(NU.ACKLAM_B, r)}) * {r} + 1)"
    return f"CASE WHEN {p} < {NU.P_LOW} THEN {low} WHEN {p} > 1 - {NU.P_LOW} THEN {high} ELSE {mid} END"


_EPS = NU.BOUND - 2.0**-52
# n_q = min(1000, n_train); the train split here holds far more than 1000 rows
_N4_SQL = (
    WN
    + f""", fit AS (
  SELECT list_transform(range(0, 1000), lambda i: i / 999.0) AS Q,
         quantile_cont(CAST(l_extendedprice AS DOUBLE), list_transform(range(0, 1000), lambda i: i / 999.0)) AS R
  FROM num WHERE split = 'train' AND l_extendedprice IS NOT NULL),
xs AS (SELECT l_orderkey, l_linenumber, split, CAST(l_extendedprice AS DOUBLE) AS x, Q, R,
  len(list_filter(R, lambda r: r < CAST(l_extendedprice AS DOUBLE))) AS lt,
  len(list_filter(R, lambda r: r <= CAST(l_extendedprice AS DOUBLE))) AS le FROM num, fit),
us AS (SELECT l_orderkey, l_linenumber, split, x, CASE
    WHEN x - {NU.BOUND!r} < R[1] THEN 0.0
    WHEN x + {NU.BOUND!r} > R[len(R)] THEN 1.0
    WHEN le > lt THEN (Q[lt + 1] + Q[greatest(le, 1)]) / 2
    ELSE Q[greatest(lt, 1)] + (x - R[greatest(lt, 1)]) / (R[least(lt + 1, len(R))] - R[greatest(lt, 1)])
         * (Q[least(lt + 1, len(R))] - Q[greatest(lt, 1)]) END AS u0 FROM xs),
uc AS (SELECT *, least(greatest(u0, {_EPS!r}), {1 - _EPS!r}) AS u FROM us)
SELECT l_orderkey, l_linenumber, split, CASE WHEN x IS NOT NULL THEN round({_probit_sql('u')}, 6) END AS l_extendedprice FROM uc"""
)

register("N4_quantile_normal", _N4_SQL)(
    lambda spark, d: (
        lambda n: NU.quantile_normal(n, ["l_extendedprice"], fit_on=n.filter(F.col("split") == "train"))
    )(B.num(spark, d)).select(*NUMK, _r6("l_extendedprice"))
)

# ---------------------------------------------------------------- N6-N11
# The categories of the two order columns.  A column list that
# follows the data cannot be a view, so the SQL writes the columns out.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


def _flags(col, values, name=str):
    return ", ".join(f"""CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS "{col}_{name(v)}\"""" for v in values)


register(
    "N6_one_hot",
    WC + f"SELECT o_orderkey, {_flags('o_orderpriority', PRIORITIES)} FROM cat",
)(lambda spark, d: CT.one_hot(B.cat(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"]))

register(
    "N7_label_encode",
    WC
    + """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_label FROM cat""",
)(
    lambda spark, d: CT.label_encode(B.cat(spark, d).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"]).select(
        "o_orderkey", "o_orderpriority_label"
    )
)

register(
    "N8_binary_encode",
    WC
    + """, b AS (SELECT o_orderkey, CASE WHEN u = (SELECT u FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END AS u, o_orderkey FROM cat)
      GROUP BY u ORDER BY min(o_orderkey) LIMIT 1 OFFSET 1) THEN 1 ELSE 0 END AS urgent_binary
  FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE 'no' END AS u FROM cat))
SELECT o_orderkey, urgent_binary, """
    + _flags("o_orderpriority", PRIORITIES, lambda v: v.lower().replace(", ", "_").replace(" ", "_"))
    + ", "
    + _flags("o_orderstatus", STATUSES, str.lower)
    + " FROM b JOIN cat USING (o_orderkey)",
)(
    lambda spark, d: CT.binary_encode(
        B.cat(spark, d).select(
            "o_orderkey", "o_orderstatus", "o_orderpriority",
            F.when(F.col("o_orderpriority") == "1-URGENT", "yes").otherwise("no").alias("urgent")),
        ["urgent", "o_orderstatus", "o_orderpriority"], id_col="o_orderkey")
)

register(
    "N10_category_na",
    S.with_(S.ESSAYS) + "SELECT essay_id, coalesce(CAST(domain1_score AS VARCHAR), 'nan') AS domain1_score FROM essays",
)(lambda spark, d: CT.category_na(B.essays(spark, d).select("essay_id", "domain1_score"), ["domain1_score"]))


def _n11(spark, d):
    c = B.cat(spark, d).select("o_orderkey", "o_orderstatus", "split")
    parts = {s: c.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    return CT.fit_on_all_splits(parts, ["o_orderstatus"], "ohe")


register(
    "N11_fit_on_all_splits",
    WC
    + f"SELECT o_orderkey, split, {_flags('o_orderstatus', STATUSES)} FROM cat",
)(_n11)

register(
    "N12_batch_normalise",
    WN
    + """SELECT l_orderkey, l_linenumber, split,
  round((l_quantity - avg(l_quantity) OVER ()) / sqrt(var_pop(l_quantity) OVER () + 1e-5), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / sqrt(var_pop(l_extendedprice) OVER () + 1e-5), 6) AS l_extendedprice
FROM num""",
)(
    lambda spark, d: NU.batch_normalise(B.num(spark, d), ["l_quantity", "l_extendedprice"]).select(
        *NUMK, _r6("l_quantity"), _r6("l_extendedprice")
    )
)


def _n13(spark, d):
    e = B.scored(spark, d)
    e = e.withColumn("num_words", num_words("essay"))
    e = V.texts_to_sequences(e, B.corpus_vocab(spark, d))
    e = V.token_mask(V.pad_sequences(e, "seq"))
    e = CT.one_hot(e, ["essay_set"])
    cats = sorted(c for c in e.columns if c.startswith("essay_set_"))
    return CT.assemble_row(e, "domain1_score", cats, ["num_words"], "padded", "mask", "essay", extra=["essay_id"])


def _n13_sql():
    from gradeflow.plans.q_vocab import SEQ_SQL

    return (
        S.with_(S.ESSAYS, S.SCORED, S.PHRASES, S.VOCAB)
        + SEQ_SQL
        + f""", cats AS (SELECT list(DISTINCT essay_set ORDER BY essay_set) AS c FROM scored)
SELECT s.essay_id, s.domain1_score AS labels,
  list_transform(cats.c, lambda v: CASE WHEN v = s.essay_set THEN 1.0 ELSE 0.0 END) AS cat_feats,
  [CAST({S.num_words('s.essay')} AS DOUBLE)] AS numerical_feats,
  list_resize(q.seq, (SELECT max(len(x.seq)) FROM seqs x JOIN scored y ON x.essay_id = y.essay_id), 0) AS input_ids,
  list_transform(list_resize(q.seq, (SELECT max(len(x.seq)) FROM seqs x JOIN scored y ON x.essay_id = y.essay_id), 0), lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END) AS attention_mask,
  s.essay AS text
FROM scored s JOIN seqs q ON s.essay_id = q.essay_id, cats"""
    )


register("N13_assemble_row", _n13_sql())(_n13)


def _n13_keywords(spark, d):
    """The row with the phrases of the essay's set, in key order."""
    vocab = B.corpus_vocab(spark, d)
    keys = V.texts_to_sequences(B.phrases(spark, d), vocab, id_col="key_id", text_col="phrase")
    keys = V.token_mask(V.pad_sequences(keys, "seq"))
    rubric = keys.groupBy("essay_set").agg(F.sort_array(F.collect_list(F.struct("key_id", "padded", "mask"))).alias("_k")).select(
        "essay_set", F.col("_k.padded").alias("keys"), F.col("_k.mask").alias("key_masks"))
    e = lookup_join(B.scored(spark, d), rubric, ["essay_set"], "left", salt_by=[F.col("essay_id")])
    e = V.token_mask(V.pad_sequences(V.texts_to_sequences(e, vocab), "seq"))
    return CT.assemble_row(e, "domain1_score", [], [], "padded", "mask", extra=["essay_id"], key_token_col="keys", key_mask_col="key_masks")


def _n13_keywords_sql():
    from gradeflow.plans.q_vocab import CAP, SEQ_SQL

    mask = "lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END"
    return (
        S.with_(S.ESSAYS, S.SCORED, S.PHRASES, S.VOCAB)
        + SEQ_SQL
        + f""", kt AS (SELECT key_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos
  FROM (SELECT key_id, {S.keras_tokens('phrase')} AS t FROM phrases)),
kq AS (SELECT kt.key_id, list(CAST(v."index" AS INTEGER) ORDER BY kt.pos) AS seq
  FROM kt JOIN vocab v ON kt.word = v.word WHERE v."index" < {CAP} GROUP BY kt.key_id),
kp AS (SELECT p.key_id, p.essay_set,
  list_resize(coalesce(kq.seq, CAST([] AS INTEGER[])), (SELECT max(len(seq)) FROM kq), 0) AS padded
  FROM phrases p LEFT JOIN kq ON p.key_id = kq.key_id),
kr AS (SELECT essay_set, list(padded ORDER BY key_id) AS keys FROM kp GROUP BY essay_set),
pe AS (SELECT s.essay_id, s.essay_set, s.domain1_score,
  list_resize(q.seq, (SELECT max(len(x.seq)) FROM seqs x JOIN scored y ON x.essay_id = y.essay_id), 0) AS ids
  FROM scored s JOIN seqs q ON s.essay_id = q.essay_id)
SELECT pe.essay_id, domain1_score AS labels, CAST([] AS DOUBLE[]) AS cat_feats, CAST([] AS DOUBLE[]) AS numerical_feats,
  ids AS input_ids, list_transform(ids, {mask}) AS attention_mask, keys AS key_input_ids,
  list_transform(keys, lambda k: list_transform(k, {mask})) AS key_attention_mask
FROM pe LEFT JOIN kr ON pe.essay_set = kr.essay_set"""
    )


register("N13_assemble_row_keywords", _n13_keywords_sql())(_n13_keywords)


def _n14_row(spark, d, keep_text_only=False, keywords=False):
    from gradeflow.plans.q_vocab import DIM

    e = B.texts(spark, d)
    vocab = B.corpus_vocab(spark, d)
    mv = V.mean_embedding(e, B.vectors_from(vocab, B.table(spark, d, "embeddings")), DIM)
    if keep_text_only:
        out = CT.combine_text_only(mv)
    else:
        j = e.join(mv, "essay_id").withColumn("num_words", num_words("essay"))
        j = j.drop("essay").checkpoint()  # read for the categories and for the rows
        j = CT.one_hot(j, ["essay_set"])
        cats = sorted(c for c in j.columns if c.startswith("essay_set_"))
        if keywords:
            from gradeflow.operators.attention import answer_features
            from gradeflow.plans.q_attention import CAP, inputs

            keep_dictionaries(spark)
            j = answer_features(*inputs(spark, d, vocab), DIM, CAP, rows=j)
        out = CT.combine_concat(j, "mean_vec", cats, ["num_words"], keyword_vec="keyword_features" if keywords else None)
    return out.select("essay_id", F.transform("combined", lambda x: F.round(x, 6)).alias("combined"))


_MEAN_SQL = f"""et AS (SELECT essay_id, unnest({S.keras_tokens('essay')}) AS word FROM essays),
nt AS (SELECT essay_id, count(*) AS n FROM et GROUP BY essay_id),
ev AS (SELECT et.essay_id, unnest(x.vec) AS v, generate_subscripts(x.vec, 1) AS d FROM et JOIN vectors x ON et.word = x.word),
sm AS (SELECT essay_id, d, sum(CAST(v AS DOUBLE)) AS s FROM ev GROUP BY essay_id, d),
mv AS (SELECT sm.essay_id, list(sm.s / nt.n ORDER BY sm.d) AS mean_vec FROM sm JOIN nt ON sm.essay_id = nt.essay_id GROUP BY sm.essay_id),
cats AS (SELECT list(DISTINCT essay_set ORDER BY essay_set) AS c FROM essays)
"""
_MEAN = "coalesce(mv.mean_vec, list_resize(CAST([] AS DOUBLE[]), 64, 0.0))"
_BLOCKS = f"""list_concat({_MEAN},
    list_transform(cats.c, lambda v: CASE WHEN v = e.essay_set THEN 1.0 ELSE 0.0 END),
    [CAST({S.num_words('e.essay')} AS DOUBLE)])"""
_N14_CTES = S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.VECTORS, _MEAN_SQL)

register(
    "N14_combine_concat",
    _N14_CTES + f"""SELECT e.essay_id, list_transform({_BLOCKS}, lambda y: CASE WHEN round(y, 6) = 0 THEN 0.0 ELSE round(y, 6) END) AS combined
FROM essays e LEFT JOIN mv ON e.essay_id = mv.essay_id, cats""",
)(_n14_row)

register(
    "N14_combine_text_only",
    _N14_CTES + f"""SELECT e.essay_id, list_transform({_MEAN}, lambda y: CASE WHEN round(y, 6) = 0 THEN 0.0 ELSE round(y, 6) END) AS combined
FROM essays e LEFT JOIN mv ON e.essay_id = mv.essay_id""",
)(lambda spark, d: _n14_row(spark, d, keep_text_only=True))


def _n14_keywords_sql():
    from gradeflow.plans.q_attention import _k7_sql

    return _k7_sql().rstrip() + f""", {_MEAN_SQL}, kf AS (SELECT essay_id, flatten(list(f ORDER BY key_id)) AS kw FROM k7 GROUP BY essay_id)
SELECT e.essay_id, list_concat(list_transform({_BLOCKS}, lambda y: CASE WHEN round(y, 6) = 0 THEN 0.0 ELSE round(y, 6) END), coalesce(kf.kw, CAST([] AS DOUBLE[]))) AS combined
FROM essays e LEFT JOIN mv ON e.essay_id = mv.essay_id LEFT JOIN kf ON e.essay_id = kf.essay_id, cats"""


register("N14_combine_concat_keywords", _n14_keywords_sql())(lambda spark, d: _n14_row(spark, d, keywords=True))
