"""Essay features over the ``essays`` binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions import text as T
from gradeflow.operators import features as FT
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.registry import register

DOUBLE_FEATURES = {
    "average_word_length", "average_sentence_length", "automated_readability_index",
    "coleman_liau_index", "dale_chall_index", "flesch_kincaid_grade", "gunning_fog",
    "linsear_write_formula", "smog_index",
}


def _r6(name):
    return F.round(F.col(name), 6).alias(name) if name in DOUBLE_FEATURES else F.col(name).cast("long").alias(name)


def word_lists(spark, sf_dir, vocab=None) -> FT.WordLists:
    vocab = vocab if vocab is not None else B.corpus_vocab(spark, sf_dir)
    return FT.WordLists(
        lexicon=B.lexicon_from(vocab), dictionary=B.dictionary_from(vocab), easy_words=B.easy_words_from(vocab)
    )


def _row_query(name):
    def q(spark, sf_dir):
        out = FT.row_features(B.texts(spark, sf_dir))
        return out.select("essay_id", _r6(name))

    return q


def _row_sql(name, expr):
    body = S.readability_cte("essays")
    return S.with_(S.ESSAYS, f"fb AS ({body})") + f"SELECT essay_id, {expr} AS {name} FROM fb"


_simple_sql = {
    "num_words": S.num_words("essay"),
    "num_sentences": S.num_sentences("essay"),
    "num_lemmas": S.num_lemmas("essay"),
    "num_commas": S.count_char("essay", ","),
    "num_exclamation_marks": S.count_char("essay", "!"),
    "num_question_marks": S.count_char("essay", "?"),
    "average_word_length": S.r6(S.average_word_length("essay")),
    "average_sentence_length": S.r6(S.average_sentence_length("essay")),
    "num_stopwords": S.num_stopwords("essay"),
}
for _k, _v in S.readability_exprs().items():
    _simple_sql[_k] = _v if _k == "syllables_count" else S.r6(_v)

_IDS = {
    "num_words": "F1", "num_sentences": "F2", "num_lemmas": "F3", "num_commas": "F4",
    "num_exclamation_marks": "F5", "num_question_marks": "F6", "average_word_length": "F7",
    "average_sentence_length": "F8", "num_stopwords": "F15", "automated_readability_index": "F16",
    "coleman_liau_index": "F17", "flesch_kincaid_grade": "F20", "gunning_fog": "F21",
    "linsear_write_formula": "F22", "smog_index": "F23", "syllables_count": "F24",
}
for _name, _fid in _IDS.items():
    register(f"{_fid}_{_name}", _row_sql(_name, _simple_sql[_name]))(_row_query(_name))


# ---------------------------------------------------------------- word-list features
WORD_LIST_SQL = f"""wtok AS (
  SELECT essay_id, 1 AS kind, w AS word FROM (SELECT essay_id, unnest({S.keras_tokens('essay')}) AS w FROM essays)
  UNION ALL SELECT essay_id, 2, lower(w) FROM (SELECT essay_id, unnest({S.ws_tokens('essay')}) AS w FROM essays)
  UNION ALL SELECT essay_id, 3, lower(w) FROM (SELECT essay_id, unnest({S.letter_words('essay')}) AS w FROM essays)),
pw AS (SELECT essay_id, kind, word, count(*) AS n FROM wtok GROUP BY essay_id, kind, word),
lexagg AS (SELECT word, list(tag) AS tags FROM lexicon GROUP BY word),
pwf AS (
  SELECT p.*, x.tags, d.word IS NOT NULL AS in_dict, e.word IS NOT NULL AS is_easy
  FROM pw p LEFT JOIN lexagg x ON p.word = x.word
  LEFT JOIN (SELECT DISTINCT word FROM dictionary) d ON p.word = d.word
  LEFT JOIN (SELECT DISTINCT word FROM easy_words) e ON p.word = e.word),
wl AS (
  SELECT essay_id,
    {", ".join(
        f"CAST(sum(CASE WHEN kind = 1 AND list_has_any(tags, {S.P.sql_str_list(tags)}) THEN n ELSE 0 END) AS BIGINT) AS {name}"
        for name, tags in FT.POS_FEATURES.items())},
    CAST(count(*) FILTER (WHERE kind = 2 AND NOT in_dict) AS BIGINT) AS num_spelling_errors,
    CAST(sum(CASE WHEN kind = 3 AND NOT is_easy THEN n ELSE 0 END) AS BIGINT) AS _not_easy,
    CAST(count(*) FILTER (WHERE kind = 3 AND NOT is_easy AND {S.syllables('word')} >= 2) AS BIGINT) AS difficult_word_count
  FROM pwf GROUP BY essay_id)"""

_WL_PREFIX = S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.LISTS, WORD_LIST_SQL)

_WL_IDS = {
    "num_nouns": "F9", "num_verbs": "F10", "num_adjectives": "F11", "num_adverbs": "F12",
    "num_conjunctions": "F13", "num_spelling_errors": "F14", "difficult_word_count": "F19",
}


def _wl_query(name):
    def q(spark, sf_dir):
        e = B.texts(spark, sf_dir)
        got = FT.word_list_features(e, word_lists(spark, sf_dir))
        j = e.select("essay_id").join(got, "essay_id", "left")
        return j.select("essay_id", F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name))

    return q


for _name, _fid in _WL_IDS.items():
    register(
        f"{_fid}_{_name}",
        _WL_PREFIX
        + f"SELECT e.essay_id, CAST(coalesce(wl.{_name}, 0) AS BIGINT) AS {_name} FROM essays e LEFT JOIN wl ON e.essay_id = wl.essay_id",
    )(_wl_query(_name))


_FULL_SQL = (
    S.with_(
        S.ESSAYS, S.PHRASES, S.VOCAB, S.LISTS, WORD_LIST_SQL,
        f"fb AS ({S.readability_cte('essays')})",
        """fj AS (SELECT fb.*, coalesce(wl.num_nouns, 0) AS num_nouns, coalesce(wl.num_verbs, 0) AS num_verbs,
            coalesce(wl.num_adjectives, 0) AS num_adjectives, coalesce(wl.num_adverbs, 0) AS num_adverbs,
            coalesce(wl.num_conjunctions, 0) AS num_conjunctions,
            coalesce(wl.num_spelling_errors, 0) AS num_spelling_errors, coalesce(wl._not_easy, 0) AS _not_easy,
            coalesce(wl.difficult_word_count, 0) AS difficult_word_count,
            100 * coalesce(wl._not_easy, 0) / CAST(nullif(len(fb._words), 0) AS DOUBLE) AS _d
          FROM fb LEFT JOIN wl ON fb.essay_id = wl.essay_id)""",
    )
)
_dale = "0.1579::DOUBLE * _d + 0.0496::DOUBLE * CAST(nullif(len(_words), 0) AS DOUBLE) / _s + CASE WHEN _d > 5 THEN 3.6365::DOUBLE ELSE 0.0::DOUBLE END"


def _full_select():
    cols = []
    for name in FT.FEATURE_COLUMNS:
        if name in _simple_sql:
            cols.append(f"{_simple_sql[name]} AS {name}")
        elif name == "dale_chall_index":
            cols.append(f"{S.r6(_dale)} AS {name}")
        else:
            cols.append(f"CAST({name} AS BIGINT) AS {name}")
    return "SELECT essay_id, essay_set, essay, domain1_score, " + ", ".join(cols) + " FROM fj"


register("F18_dale_chall_index", _FULL_SQL + "SELECT essay_id, " + S.r6(_dale) + " AS dale_chall_index FROM fj")(
    lambda spark, sf_dir: FT.generate_features(B.texts(spark, sf_dir), word_lists(spark, sf_dir)).select(
        "essay_id", F.round("dale_chall_index", 6).alias("dale_chall_index")
    )
)


def generate_features_query(spark, sf_dir):
    out = FT.generate_features(B.essays(spark, sf_dir), word_lists(spark, sf_dir))
    return out.select("essay_id", "essay_set", "essay", "domain1_score", *[_r6(c) for c in FT.FEATURE_COLUMNS])


register("F25_generate_features", _FULL_SQL + _full_select())(generate_features_query)
