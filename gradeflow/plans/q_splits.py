"""D1-D8 over the essays."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import splits as D
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.registry import register

E = S.with_(S.ESSAYS)
ES = S.with_(S.ESSAYS, S.SCORED)
SEED = 42


def _h(id_expr="essay_id", seed=SEED):
    return f"md5(CAST({id_expr} AS VARCHAR) || ':{seed}')"


register(
    "D1_apply_folds",
    S.with_(S.ESSAYS, S.FOLD_IDS)
    + """, pf AS (SELECT essay_id, unnest(range(0, 5)) AS fold FROM essays)
SELECT CAST(pf.fold AS INTEGER) AS fold, coalesce(f.role, 'train') AS split, pf.essay_id
FROM pf LEFT JOIN fold_ids f ON pf.fold = f.fold AND pf.essay_id = f.essay_id""",
)(lambda spark, d: D.apply_folds(B.texts(spark, d).select("essay_id"), B.fold_ids(spark, d)))

register(
    "D2_rotate_folds",
    E
    + f""", pf AS (SELECT essay_id, {S.bucket_of('essay_id')} AS b, unnest(range(0, 5)) AS fold FROM essays)
SELECT CAST(fold AS INTEGER) AS fold,
  CASE WHEN b = fold THEN 'test' WHEN b = (fold + 4) % 5 THEN 'dev' ELSE 'train' END AS split, essay_id FROM pf""",
)(lambda spark, d: D.rotate_folds(B.texts(spark, d).select("essay_id")))

register(
    "D3_kfold_split",
    E + f"SELECT essay_id, CAST(ntile(5) OVER (ORDER BY {_h()}, essay_id) - 1 AS INTEGER) AS fold FROM essays",
)(lambda spark, d: D.kfold_split(B.texts(spark, d).select("essay_id"), 5, SEED))

register(
    "D4_holdout_then_kfold",
    E
    + f""", r AS (SELECT essay_id, row_number() OVER (ORDER BY {_h()}, essay_id) AS rn, count(*) OVER () AS n FROM essays),
v AS (SELECT *, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS nv FROM r)
SELECT essay_id, CASE WHEN rn <= nv THEN 'val' ELSE 'cv' END AS role,
  CASE WHEN rn > nv THEN CAST(ntile(5) OVER (PARTITION BY rn > nv ORDER BY rn) - 1 AS INTEGER) END AS fold FROM v""",
)(lambda spark, d: D.holdout_then_kfold(B.texts(spark, d).select("essay_id"), 0.2, 5, SEED))

register(
    "D5_stratified_downsample",
    ES
    + f""", cnt AS (SELECT domain1_score AS c, count(*) AS nc FROM scored GROUP BY domain1_score),
q0 AS (SELECT c, nc, 0.5::DOUBLE * nc AS ex, floor(0.5::DOUBLE * nc) AS fl FROM cnt),
lf AS (SELECT CAST(ceil(0.5::DOUBLE * (SELECT sum(nc) FROM cnt)) AS BIGINT) - (SELECT sum(fl) FROM q0) AS lft),
q AS (SELECT c, fl + CASE WHEN row_number() OVER (ORDER BY ex - fl DESC, c) <= (SELECT lft FROM lf) THEN 1 ELSE 0 END AS quota FROM q0),
rk AS (SELECT essay_id, domain1_score, row_number() OVER (PARTITION BY domain1_score ORDER BY {_h()}, essay_id) AS pos FROM scored)
SELECT essay_id, domain1_score FROM rk JOIN q ON rk.domain1_score = q.c WHERE pos > quota""",
)(lambda spark, d: D.stratified_downsample(B.scored(spark, d).select("essay_id", "domain1_score"), 0.5, seed=SEED))

register(
    "D6_pad_to_multiple",
    ES
    + """, r AS (SELECT essay_id, domain1_score, row_number() OVER (ORDER BY essay_id) AS rn, count(*) OVER () AS n FROM scored)
SELECT essay_id, domain1_score, 0 AS copy FROM r
UNION ALL SELECT essay_id, domain1_score, 1 FROM r WHERE rn <= (32 - n % 32) % 32""",
)(lambda spark, d: D.pad_to_multiple(B.scored(spark, d).select("essay_id", "domain1_score"), 32))

# the list form cycles: a multiple above the number of rows repeats them several times
register(
    "D6_pad_to_multiple_list",
    ES
    + """, r AS (SELECT essay_id, domain1_score, row_number() OVER (ORDER BY essay_id) AS rn, count(*) OVER () AS n FROM scored),
t AS (SELECT *, n + (4096 - n % 4096) % 4096 AS target FROM r)
SELECT essay_id, domain1_score, CAST(unnest(range(0, CAST(floor((target - rn) / n::DOUBLE) AS BIGINT) + 1)) AS INTEGER) AS copy FROM t""",
)(lambda spark, d: D.pad_to_multiple(B.scored(spark, d).select("essay_id", "domain1_score"), 4096, form="list"))

PLAN = {2: (200, 2), 3: (300, 3)}
register(
    "D7_oversample_by_class",
    ES
    + f""", rk AS (SELECT essay_id, domain1_score, row_number() OVER (PARTITION BY domain1_score ORDER BY {_h()}, essay_id) AS pos
  FROM scored WHERE domain1_score IN (2, 3))
SELECT essay_id, domain1_score, 0 AS variant, CAST(NULL AS INTEGER) AS applied, CAST(NULL AS INTEGER) AS length FROM scored
UNION ALL
SELECT essay_id, domain1_score, unnest(range(1, CASE domain1_score WHEN 2 THEN 2 ELSE 3 END + 1)) AS variant, 1, 0
FROM rk WHERE pos <= CASE domain1_score WHEN 2 THEN 200 ELSE 300 END""",
)(
    lambda spark, d: D.oversample_by_class(B.scored(spark, d).select("essay_id", "domain1_score"), PLAN, seed=SEED).select(
        "essay_id", "domain1_score", "variant", "applied", "length"
    )
)

register(
    "D8_synonym_substitute",
    S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.SYNONYMS)
    + f""", syn AS (SELECT word, min(synonym) AS synonym FROM synonyms GROUP BY word),
tk AS (SELECT essay_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT essay_id, {S.ws_tokens('essay')} AS t FROM essays)),
rp AS (SELECT tk.essay_id, tk.pos, CASE WHEN s.synonym IS NOT NULL AND
    CAST(('0x' || substr(md5(CAST(tk.essay_id AS VARCHAR) || ':1:' || CAST(tk.pos AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 3
    THEN s.synonym ELSE tk.tok END AS out
  FROM tk LEFT JOIN syn s ON lower(tk.tok) = s.word),
tx AS (SELECT essay_id, string_agg(out, ' ' ORDER BY pos) AS essay FROM rp GROUP BY essay_id)
SELECT e.essay_id, coalesce(tx.essay, '') AS essay FROM essays e LEFT JOIN tx ON e.essay_id = tx.essay_id""",
)(
    lambda spark, d: D.synonym_substitute(
        B.texts(spark, d).select("essay_id", "essay"), B.synonyms_from(B.corpus_vocab(spark, d))
    ).select("essay_id", "essay")
)
