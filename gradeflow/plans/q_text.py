"""P1-P11, G1-G6, K1-K6 over the bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions import text as T
from gradeflow.operators import clean as C
from gradeflow.operators import lexicon as L
from gradeflow.operators import stats as G
from gradeflow.operators import validate as VAL
from gradeflow.plans import bindings as B
from gradeflow.plans import sql as S
from gradeflow.plans.registry import register

E = S.with_(S.ESSAYS)
EP = S.with_(S.ESSAYS, S.PHRASES)

# ---------------------------------------------------------------- P
register("P1_filter_set", E + "SELECT essay_id, essay_set, domain1_score FROM essays WHERE essay_set = 'en'")(
    lambda spark, d: C.filter_set(B.essays(spark, d), "en").select("essay_id", "essay_set", "domain1_score")
)

register("P2_filter_score", E + "SELECT essay_id, domain1_score FROM essays WHERE domain1_score = 3")(
    lambda spark, d: C.filter_score(B.essays(spark, d), 3).select("essay_id", "domain1_score")
)

_P3_COLS = ["essay_id", "essay_set", "essay", "domain1_score"]
# the columns that hold a null (scores of unlabelled essays) are gone
register(
    "P3_drop_null_columns",
    E + "SELECT essay_id, essay_set, essay FROM essays",
)(lambda spark, d: C.drop_null_columns(B.essays(spark, d)))

register("P5_clean_text", E + f"SELECT essay_id, {S.clean_text('essay')} AS essay FROM essays")(
    lambda spark, d: C.clean_text(B.texts(spark, d)).select("essay_id", "essay")
)

register(
    "P6_normalize_quotes",
    E + "SELECT essay_id, translate(essay, chr(147) || chr(148) || chr(133), '\"\"') AS essay FROM essays",
)(lambda spark, d: C.normalize_quotes(B.texts(spark, d)).select("essay_id", "essay"))

# the rule of the set that keeps its ellipses
register(
    "P6_normalize_quotes_keep_ellipsis",
    E + "SELECT essay_id, translate(essay, chr(147) || chr(148), '\"\"') AS essay FROM essays",
)(lambda spark, d: C.normalize_quotes(B.texts(spark, d), keep_ellipsis=True).select("essay_id", "essay"))

register(
    "P7_combine_text_columns",
    E
    + "SELECT essay_id, array_to_string(list_filter([coalesce(CAST(essay_set AS VARCHAR), 'nan'), "
    "coalesce(CAST(domain1_score AS VARCHAR), 'nan'), coalesce(essay, 'nan')], "
    "lambda x: x NOT IN ('nan', 'None')), ' [SEP] ') AS text FROM essays",
)(
    lambda spark, d: C.combine_text_columns(B.essays(spark, d), ["essay_set", "domain1_score", "essay"]).select(
        "essay_id", "text"
    )
)

register("P8_add_constants", E + "SELECT essay_id, 1 AS temp_cat, essay AS lemmatized FROM essays")(
    lambda spark, d: C.add_constants(B.texts(spark, d)).select("essay_id", "temp_cat", "lemmatized")
)

register("P9_debug_limit", E + "SELECT essay_id, essay_set FROM essays ORDER BY essay_id LIMIT 500")(
    lambda spark, d: C.debug_limit(B.texts(spark, d).select("essay_id", "essay_set"), 500)
)

_NAMES = ["zero", "one", "two", "three"]
register(
    "P10_map_label_names",
    S.with_(S.ESSAYS, S.SCORED)
    + f"SELECT essay_id, domain1_score AS label, {S.P.sql_str_list(_NAMES)}[domain1_score + 1] AS label_name FROM scored",
)(
    lambda spark, d: C.map_label_names(
        B.scored(spark, d).select("essay_id", F.col("domain1_score").alias("label")), _NAMES
    )
)

register(
    "P11_sample_row",
    S.with_(S.ESSAYS, S.SCORED)
    + "SELECT essay_id, domain1_score FROM scored WHERE domain1_score = 3 "
    "ORDER BY md5(CAST(essay_id AS VARCHAR) || ':42'), essay_id LIMIT 1",
)(
    lambda spark, d: C.sample_row(
        C.filter_score(B.scored(spark, d), 3).select("essay_id", "domain1_score"), seed=42
    )
)

# ---------------------------------------------------------------- G
register(
    "G1_set_stats",
    E
    + "SELECT essay_set, CAST(count(*) AS BIGINT) AS n_essays, CAST(("
    + " + ".join(f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 1 ELSE 0 END" for c in _P3_COLS)
    + ") AS BIGINT) AS n_attributes, min(domain1_score) AS min_score, max(domain1_score) AS max_score "
    "FROM essays GROUP BY essay_set",
)(lambda spark, d: G.set_stats(B.essays(spark, d)))

register(
    "G2_score_histogram",
    E + "SELECT domain1_score, CAST(count(*) AS BIGINT) AS count FROM essays WHERE domain1_score IS NOT NULL "
    "GROUP BY domain1_score ORDER BY count DESC, domain1_score",
)(lambda spark, d: G.score_histogram(B.essays(spark, d)).withColumn("count", F.col("count").cast("long")))

register(
    "G3_mean_words",
    E + f"SELECT essay_set, {S.r6('avg(' + S.num_words('essay') + ')')} AS mean_words FROM essays GROUP BY essay_set",
)(lambda spark, d: G.mean_words(B.texts(spark, d)).withColumn("mean_words", F.round("mean_words", 6)))

register(
    "G4_max_words",
    E + f"SELECT essay_set, max({S.num_words('essay')}) AS max_words FROM essays GROUP BY essay_set",
)(lambda spark, d: G.max_words(B.texts(spark, d)))

register(
    "G5_max_phrase_words",
    EP + f"SELECT CAST(max(len({S.ws_tokens('phrase')})) AS BIGINT) AS max_phrase_words FROM phrases",
)(lambda spark, d: G.max_phrase_words(B.phrases(spark, d)))

register(
    "G6_count_classes",
    E + "SELECT CAST(count(DISTINCT domain1_score) AS BIGINT) AS n_classes FROM essays",
)(lambda spark, d: G.count_classes(B.essays(spark, d)))

# ---------------------------------------------------------------- K1-K6
_NQ = "translate(essay, chr(147) || chr(148) || chr(133), '\"\"')"
register("K1_extract_quotes", E + f"SELECT essay_id, {S.quotes(_NQ)} AS quotes FROM essays")(
    lambda spark, d: L.extract_quotes(B.texts(spark, d)).select("essay_id", "quotes")
)

register(
    "K2_quote_set",
    E
    + f""", q AS (SELECT DISTINCT essay_set, unnest({S.quotes(_NQ)}) AS quote FROM essays)
SELECT q.essay_set, q.quote, n.n_quotes FROM q
JOIN (SELECT essay_set, CAST(count(*) AS BIGINT) AS n_quotes FROM q GROUP BY essay_set) n ON q.essay_set = n.essay_set""",
)(lambda spark, d: L.quote_set(B.texts(spark, d)).select("essay_set", "quote", "n_quotes"))

# one set takes the quotes of its best essays only
register(
    "K2_quote_set_of_score",
    E
    + f""", q AS (SELECT DISTINCT essay_set, unnest({S.quotes(_NQ)}) AS quote FROM essays WHERE essay_set <> 'en' OR domain1_score = 3)
SELECT q.essay_set, q.quote, n.n_quotes FROM q
JOIN (SELECT essay_set, CAST(count(*) AS BIGINT) AS n_quotes FROM q GROUP BY essay_set) n ON q.essay_set = n.essay_set""",
)(lambda spark, d: L.quote_set(B.essays(spark, d), only_score={"en": 3}).select("essay_set", "quote", "n_quotes"))

register(
    "K3_phrase_union",
    EP + f"SELECT phrase FROM phrases UNION SELECT unnest({S.quotes(_NQ)}) AS phrase FROM essays",
)(
    lambda spark, d: L.phrase_union(
        B.phrases(spark, d),
        B.texts(spark, d).select(F.explode(T.quotes(T.normalize_quotes("essay"))).alias("phrase")),
    )
)

register(
    "K4_lexicon_count",
    S.with_(S.ESSAYS, S.PHRASES, S.VOCAB, S.LISTS)
    + f"""SELECT e.essay_id, {", ".join(f"CAST(coalesce(sum(t.n) FILTER (WHERE g.tag = '{x}'), 0) AS BIGINT) AS {x}" for x in B.GAZETTEER_FAMILIES.values())}
FROM essays e LEFT JOIN (
  SELECT essay_id, w AS word, count(*) AS n FROM (SELECT essay_id, unnest({S.keras_tokens('essay')}) AS w FROM essays)
  GROUP BY essay_id, w) t ON e.essay_id = t.essay_id
LEFT JOIN gazetteer g ON t.word = g.word
GROUP BY e.essay_id""",
)(
    lambda spark, d: L.lexicon_count(
        B.texts(spark, d), B.gazetteer_from(B.corpus_vocab(spark, d)), list(B.GAZETTEER_FAMILIES.values())
    )
)


def _ngram_sql(n):
    t = S.keras_tokens("essay")
    return (
        f"SELECT essay_id, array_to_string(t[i + 1:i + {n}], ' ') AS ngram FROM "
        f"(SELECT essay_id, t, unnest(range(0, len(t) - {n} + 1)) AS i FROM (SELECT essay_id, {t} AS t FROM essays))"
    )


register(
    "K5_top_ngrams_tfidf",
    E
    + f""", g AS ({" UNION ALL ".join(_ngram_sql(n) for n in (1, 2, 3))}),
pd AS (SELECT essay_id, ngram, count(*) AS tf FROM g GROUP BY essay_id, ngram),
pg AS (SELECT ngram, sum(tf) AS total, count(*) AS df FROM pd GROUP BY ngram)
SELECT ngram, CAST(total AS BIGINT) AS total,
  round((ln((1 + (SELECT count(*) FROM essays)) / (1 + df)) + 1) * total, 6) AS score
FROM pg ORDER BY score DESC, ngram LIMIT 30""",
)(lambda spark, d: L.top_ngrams_tfidf(B.texts(spark, d)))

_PH_TOK = S.keras_tokens("phrase")
register(
    "K6_phrase_presence",
    EP
    + f""", ph AS (SELECT key_id, essay_set, array_to_string({_PH_TOK}, ' ') AS ngram FROM phrases),
et AS (SELECT essay_id, essay_set, array_to_string({S.keras_tokens('essay')}, ' ') AS t FROM essays)
SELECT essay_id, key_id, CASE WHEN ngram <> '' AND contains(' ' || t || ' ', ' ' || ngram || ' ') THEN 1 ELSE 0 END AS present
FROM et JOIN ph ON et.essay_set = ph.essay_set""",
)(lambda spark, d: L.phrase_presence(B.texts(spark, d), B.phrases(spark, d)))


# ---------------------------------------------------------------- Q17 (validation before a fit)
_Q17_FEATS = ["num_exclamation_marks", "num_question_marks"]
register(
    "Q17_validate_inputs",
    E
    + f"""SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE domain1_score IS NULL) AS BIGINT) AS n_null_labels,
  CAST(count(*) FILTER (WHERE {S.count_char('essay', '!')} = 0 AND {S.count_char('essay', '?')} = 0) AS BIGINT) AS n_all_zero_rows
FROM essays""",
)(
    lambda spark, d: VAL.validate_inputs(
        B.essays(spark, d).select(
            "domain1_score",
            T.num_exclamation_marks("essay").alias("num_exclamation_marks"),
            T.num_question_marks("essay").alias("num_question_marks"),
        ),
        "domain1_score",
        _Q17_FEATS,
    )
)
