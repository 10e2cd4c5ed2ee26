"""DuckDB twins of the bindings and text rules, for the oracle SQL.

Built from the same pattern constants as the Spark code; DuckDB 2 lambda
syntax (``lambda x: ...``)."""

from __future__ import annotations

from gradeflow.functions import patterns as P
from gradeflow.plans.bindings import GAZETTEER_FAMILIES, LEXICON_TAGS, RUBRIC_SETS

q = P.sql_str
q_list = P.sql_str_list


def r6(e: str) -> str:
    """Round to 6 places like Spark's ``round``: DuckDB can return -0.0 where
    Spark's decimal rounding gives 0.0, so zero is normalised."""
    return f"(CASE WHEN round(CAST({e} AS DOUBLE), 6) = 0 THEN 0.0 ELSE round(CAST({e} AS DOUBLE), 6) END)"


# ---------------------------------------------------------------- text rules
def ws_tokens(e):
    return f"regexp_extract_all({e}, {q(P.WS_TOKEN)})"


def letter_words(e):
    return f"regexp_extract_all({e}, {q(P.WORD)})"


def lemma_tokens(e):
    return f"regexp_extract_all({e}, {q(P.LEMMA_TOKEN)})"


def keras_tokens(e):
    return f"regexp_extract_all(lower({e}), {q(P.KERAS_TOKEN)})"


def syllables(e):
    return f"greatest(1, len(regexp_extract_all(lower({e}), {q(P.SYLLABLE)})))"


def num_words(e):
    return f"CAST(len({ws_tokens(e)}) AS BIGINT)"


def num_sentences(e):
    return f"CAST(greatest(1, len(regexp_extract_all({e}, {q(P.SENTENCE_END)}))) AS BIGINT)"


def num_lemmas(e):
    return f"CAST(len({lemma_tokens(e)}) AS BIGINT)"


def count_char(e, ch):
    return f"CAST(length({e}) - length(replace({e}, {q(ch)}, '')) AS BIGINT)"


def average_word_length(e):
    return f"CAST(length(regexp_replace({e}, {q(P.WS_CLASS)}, '', 'g')) AS DOUBLE) / nullif({num_words(e)}, 0)"


def average_sentence_length(e):
    return f"CAST({num_words(e)} AS DOUBLE) / {num_sentences(e)}"


def num_stopwords(e):
    stop = P.sql_str_list(P.english_stop_words())
    return f"CAST(len(list_filter({lemma_tokens(e)}, lambda x: list_contains({stop}, lower(x)))) AS BIGINT)"


def first_100_sentences(e):
    return f"greatest(1, len(regexp_extract_all(regexp_extract({e}, {q(P.FIRST_100_WORDS)}, 0), {q(P.SENTENCE_END)})))"


def clean_text(e):
    collapsed = f"regexp_replace({e}, {q(P.BLANK_RUN)}, ' ', 'g')"
    return f"regexp_replace({collapsed}, {q(P.CLEAN_DROP)}, '', 'g')"


def quotes(e):
    return f"regexp_extract_all({e}, {q(P.QUOTE)}, 1)"


def readability_cte(src: str, text: str = "essay") -> str:
    """SELECT over ``src`` adding _words, _syl, _s, _s100 (like readability_parts)."""
    return (
        f"SELECT *, {letter_words(text)} AS _words, "
        f"list_transform({letter_words(text)}, lambda w: {syllables('w')}) AS _syl, "
        f"CAST({num_sentences(text)} AS DOUBLE) AS _s, {first_100_sentences(text)} AS _s100 FROM {src}"
    )


def readability_exprs() -> dict[str, str]:
    w = "CAST(nullif(len(_words), 0) AS DOUBLE)"
    c = "CAST(length(array_to_string(_words, '')) AS DOUBLE)"
    y = "CAST(coalesce(list_sum(_syl), 0) AS BIGINT)"
    h = "CAST(len(list_filter(_syl, lambda x: x >= 3)) AS DOUBLE)"
    easy = "len(list_filter(_syl[1:100], lambda x: x < 3))"
    hard = "len(list_filter(_syl[1:100], lambda x: x >= 3))"
    r = f"(({easy} + 3 * {hard}) / CAST(_s100 AS DOUBLE))"
    return {
        "automated_readability_index": f"4.71::DOUBLE * {c} / {w} + 0.5::DOUBLE * {w} / _s - 21.43::DOUBLE",
        "coleman_liau_index": f"0.0588::DOUBLE * (100 * {c} / {w}) - 0.296::DOUBLE * (100 * _s / {w}) - 15.8::DOUBLE",
        "flesch_kincaid_grade": f"0.39::DOUBLE * {w} / _s + 11.8::DOUBLE * {y} / {w} - 15.59::DOUBLE",
        "gunning_fog": f"0.4::DOUBLE * ({w} / _s + 100 * {h} / {w})",
        "linsear_write_formula": f"CASE WHEN {w} IS NOT NULL THEN CASE WHEN {r} > 20 THEN {r} / 2 ELSE ({r} - 2) / 2 END END",
        "smog_index": f"CASE WHEN {w} IS NOT NULL THEN CASE WHEN _s < 3 THEN 0.0::DOUBLE ELSE 1.043::DOUBLE * sqrt(30 * {h} / _s) + 3.1291::DOUBLE END END",
        "syllables_count": y,
    }


# ---------------------------------------------------------------- bindings
ESSAYS = """essays AS (
  SELECT d.doc_id AS essay_id, d.lang AS essay_set, d.text AS essay,
         CAST(2 * l.quality + 1 - l.toxic AS INTEGER) AS domain1_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SCORED = "scored AS (SELECT * FROM essays WHERE domain1_score IS NOT NULL)"

PHRASES = f"""phrases AS (
  SELECT item_id AS key_id, {q_list(RUBRIC_SETS)}[item_id % {len(RUBRIC_SETS)} + 1] AS essay_set, text AS phrase FROM benchmark)"""

VOCAB = f"""vtok AS (
  SELECT 0 AS src, essay_id AS tid, unnest(t) AS word, generate_subscripts(t, 1) AS pos
  FROM (SELECT essay_id, {keras_tokens('essay')} AS t FROM essays)
  UNION ALL
  SELECT 1 AS src, key_id AS tid, unnest(t) AS word, generate_subscripts(t, 1) AS pos
  FROM (SELECT key_id, {keras_tokens('phrase')} AS t FROM phrases)),
vagg AS (
  SELECT word, count(*) AS cnt, min(src) AS fs FROM vtok GROUP BY word),
vfirst AS (
  SELECT v.word, min(v.tid) AS ft FROM vtok v JOIN vagg a ON v.word = a.word AND v.src = a.fs GROUP BY v.word),
vpos AS (
  SELECT v.word, min(v.pos) AS fp FROM vtok v JOIN vagg a ON v.word = a.word AND v.src = a.fs
  JOIN vfirst f ON v.word = f.word AND v.tid = f.ft GROUP BY v.word),
vocab AS (
  SELECT a.word, CAST(a.cnt AS BIGINT) AS count,
         CAST(row_number() OVER (ORDER BY a.cnt DESC, a.fs, f.ft, p.fp) AS BIGINT) AS "index"
  FROM vagg a JOIN vfirst f ON a.word = f.word JOIN vpos p ON a.word = p.word)"""

_lex_case = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in LEXICON_TAGS.items())
_gaz_case = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in GAZETTEER_FAMILIES.items())

LISTS = f"""lexicon AS (
  SELECT word, tag FROM (SELECT word, CASE "index" % 8 {_lex_case} END AS tag FROM vocab) WHERE tag IS NOT NULL),
gazetteer AS (
  SELECT word, tag FROM (SELECT word, CASE "index" % 11 {_gaz_case} END AS tag FROM vocab) WHERE tag IS NOT NULL),
dictionary AS (SELECT word FROM vocab WHERE count >= 5),
easy_words AS (SELECT word FROM vocab WHERE "index" <= 500)"""

VECTORS = """vectors AS (
  SELECT v.word, e.embedding AS vec FROM vocab v JOIN embeddings e ON v."index" - 1 = e.vec_id)"""

SYNONYMS = """synonyms AS (
  SELECT a.word, b.word AS synonym FROM vocab a JOIN vocab b ON b."index" = a."index" + 1
  WHERE a."index" % 2 = 0)"""

LOGITS = """logits AS (
  SELECT vec_id AS row_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS logits,
         CAST(label AS INTEGER) AS label FROM embeddings)"""

BINARY = """bin AS (
  SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS score, CAST(label % 2 AS INTEGER) AS label
  FROM embeddings)"""

BINARY_TIES = """bin AS (
  SELECT d.doc_id AS row_id, CAST(floor(d.n_chars / 500) AS DOUBLE) AS score, CAST(l.quality AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

REGRESS = """regress AS (
  SELECT o.o_orderkey AS row_id, o.o_totalprice AS label, p.pred
  FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS pred
                      FROM lineitem GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey)"""

NUM = """num AS (
  SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1.0) AS l_quantity, l_extendedprice,
         CASE WHEN l_orderkey % 5 = 0 THEN 'test' WHEN l_orderkey % 5 = 1 THEN 'val' ELSE 'train' END AS split
  FROM lineitem)"""

CAT = """cat AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus,
         CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 5 = 1 THEN 'val' ELSE 'train' END AS split
  FROM orders)"""


def bucket_of(e: str, k: int = 5) -> str:
    return f"CAST(CAST(('0x' || substr(md5(CAST({e} AS VARCHAR)), 1, 8)) AS BIGINT) % {k} AS INTEGER)"


FOLD_IDS = f"""fold_ids AS (
  SELECT fold, role, essay_id FROM (
    SELECT f.fold, CASE WHEN d.b = f.fold THEN 'test' WHEN d.b = (f.fold + 4) % 5 THEN 'dev' END AS role, d.essay_id
    FROM (SELECT doc_id AS essay_id, {bucket_of('doc_id')} AS b FROM documents) d
    JOIN (SELECT unnest(range(0, 5)) AS fold) f ON d.b = f.fold OR d.b = (f.fold + 4) % 5))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
