"""Block B: the 24 essay features.

Each row-local feature is a Column expression evaluated in the scan stage.  The
word-list features (parts of speech, spelling, Dale-Chall, difficult words)
need lookups.  Word tables of a measured size are broadcast and an Arrow
function counts the tokens of each text in place, so nothing is shuffled; the
full build takes all other counts from the same scan of the text.
Larger ones are looked up by chunks of texts (``plans/chunks.py``), which ask once
for each distinct word; the counts of each text are worked out by the same code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from gradeflow.functions import patterns as P
from gradeflow.functions import scan
from gradeflow.functions import text as T
from gradeflow.plans.chunks import with_word_facts
from gradeflow.plans.joins import fits_broadcast

FEATURE_COLUMNS = [
    "num_words", "num_sentences", "num_lemmas", "num_commas", "num_exclamation_marks",
    "num_question_marks", "average_word_length", "average_sentence_length", "num_nouns",
    "num_verbs", "num_adjectives", "num_adverbs", "num_conjunctions", "num_spelling_errors",
    "num_stopwords", "automated_readability_index", "coleman_liau_index", "dale_chall_index",
    "difficult_word_count", "flesch_kincaid_grade", "gunning_fog", "linsear_write_formula",
    "smog_index", "syllables_count",
]

ROW_LOCAL = {
    "num_words": T.num_words,
    "num_sentences": T.num_sentences,
    "num_lemmas": T.num_lemmas,
    "num_commas": T.num_commas,
    "num_exclamation_marks": T.num_exclamation_marks,
    "num_question_marks": T.num_question_marks,
    "average_word_length": T.average_word_length,
    "average_sentence_length": T.average_sentence_length,
}

POS_FEATURES = {
    "num_nouns": ("NOUN", "PROPN"),
    "num_verbs": ("VERB",),
    "num_adjectives": ("ADJ",),
    "num_adverbs": ("ADV",),
    "num_conjunctions": ("CCONJ",),
}


@dataclass
class WordLists:
    """User-given word tables.  ``lexicon``: (word, tag); ``dictionary`` and
    ``easy_words``: (word).  A feature whose list is missing raises."""

    lexicon: DataFrame | None = None
    dictionary: DataFrame | None = None
    easy_words: DataFrame | None = None


def row_features(df: DataFrame, text_col: str = "essay") -> DataFrame:
    """One select, no shuffle."""
    parts = T.readability_parts(text_col)
    out = df.withColumns({k: f(text_col) for k, f in ROW_LOCAL.items()})
    out = out.withColumn("num_stopwords", T.num_stopwords(text_col))
    out = out.withColumns(parts).withColumns(T.readability_from_parts())
    return out


def _need(x, name):
    if x is None:
        raise ValueError(f"word list '{name}' is required for this feature")
    return x


#: What the word lists give per text.
COUNTS = [*POS_FEATURES, "num_spelling_errors", "_not_easy", "difficult_word_count"]


IN_DICT, IS_EASY = len(POS_FEATURES), len(POS_FEATURES) + 1


def word_facts(lists: WordLists) -> DataFrame:
    """One row per listed word with ``bits``: bit i for the tags of feature i of
    ``POS_FEATURES``, then one for the dictionary and one for the easy words.
    A union and one aggregation, no outer joins."""
    of_tag = F.lit(0)
    for i, tags in enumerate(POS_FEATURES.values()):
        of_tag = F.when(F.col("tag").isin(*tags), F.lit(1 << i)).otherwise(of_tag)
    lex = _need(lists.lexicon, "lexicon").select("word", of_tag.alias("bits"))
    dic = _need(lists.dictionary, "dictionary").select("word", F.lit(1 << IN_DICT).alias("bits"))
    easy = _need(lists.easy_words, "easy_words").select("word", F.lit(1 << IS_EASY).alias("bits"))
    listed = lex.unionByName(dic).unionByName(easy).filter(F.col("word").isNotNull())
    return listed.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _counter(with_facts: bool, counts: list[str]):
    """A function of texts, their lower-cased form and the facts of words (the
    words, and a row of flags for each plus one for words not listed) that
    gives a struct of ``counts`` for each text from one scan."""
    n_tags, pattern = len(POS_FEATURES), P.SYLLABLE
    stop = pa.array([w for w in P.english_stop_words() if w.isalpha()], pa.large_string())
    names = ["num_stopwords", *(COUNTS if with_facts else [])]
    whole = any(c in scan.TEXT_COUNTS for c in counts)

    def of_lists(low: pa.Array, facts) -> list[np.ndarray]:
        n = len(low)
        lists = scan.streams(low)
        coded = pa.concat_arrays([words for words, _ in lists]).dictionary_encode()
        code = coded.indices.to_numpy()
        ends = np.cumsum([len(words) for words, _ in lists])
        keras, blank, letters = np.split(code, ends[:-1])
        rows = [row for _, row in lists]
        size = max(len(coded.dictionary), 1)
        total = lambda row, wanted: np.bincount(row[wanted], minlength=n)

        def once(row, code):
            pairs = np.unique(row * size + code)
            return pairs // size, pairs % size

        stops = total(rows[2], pc.is_in(coded.dictionary, value_set=stop).to_numpy(zero_copy_only=False)[letters])
        if not with_facts:
            return [stops]
        words, flags = facts
        fact = flags[pc.index_in(coded.dictionary, value_set=words).fill_null(len(words)).to_numpy()]
        out = [total(rows[0], fact[keras, i]) for i in range(n_tags)]
        row, code = once(rows[1], blank)
        out.append(total(row, ~fact[code, IN_DICT]))
        hard = ~fact[:, IS_EASY]
        out.append(total(rows[2], hard[letters]))
        hard &= pc.count_substring_regex(coded.dictionary, pattern).to_numpy() >= 2
        row, code = once(rows[2], letters)
        out.append(total(row, hard[code]))
        return [stops, *out]

    def count(text: pa.Array, low: pa.Array, facts) -> pa.Array:
        done = []
        for at, n in scan.slices(text):
            got = dict(zip(names, of_lists(low.slice(at, n), facts)))
            if whole:
                got.update(zip(scan.TEXT_COUNTS, scan.text_counts(text.slice(at, n))))
            done.append(np.stack([got[c] for c in counts]))
        held = np.concatenate(done, axis=1) if done else np.zeros((len(counts), 0), dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in held], counts)

    return count


def _flags(bits: np.ndarray) -> np.ndarray:
    """A row of flags for each word's ``bits``; the last one stands for words not listed."""
    return (np.r_[bits, 0][:, None] >> np.arange(IS_EASY + 1) & 1).astype(bool)


def _scan_column(facts: DataFrame, text_col: str, counts: list[str]) -> Column:
    """A struct of ``counts`` for each text, from one scan of the texts and of
    their words, given word facts that are small enough to be broadcast."""
    table, counted = facts.toArrow(), _counter(True, counts)
    shared = facts.sparkSession.sparkContext.broadcast((table["word"].combine_chunks().cast(pa.large_string()), _flags(table["bits"].to_numpy())))

    @F.arrow_udf(", ".join(f"{c} long" for c in counts))
    def count(text: pa.Array, low: pa.Array) -> pa.Array:
        return counted(text, low, shared.value)

    return count(F.col(text_col), F.lower(F.col(text_col)))


def _chunked_counts(df: DataFrame, facts: DataFrame, id_col: str, text_col: str, counts: list[str], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``df`` with the struct ``_n`` of ``counts``, for word facts
    of any size.  Where the text is not kept, its lower-cased form alone is shuffled."""
    counted = _counter(True, counts)

    def use(texts: pa.Table, found: pa.Table) -> pa.Table:
        held = (found["word"].combine_chunks().cast(pa.large_string()), _flags(found["bits"].to_numpy()))
        low = texts["_low"].combine_chunks()
        text = texts[text_col].combine_chunks() if text_col in kept else low
        return texts.select(kept).append_column("_n", counted(text, low, held))

    low = df.withColumn("_low", F.lower(F.col(text_col))).select(*kept, "_low")
    schema = T_.StructType([*[df.schema[c] for c in kept], T_.StructField("_n", T_.StructType([T_.StructField(c, T_.LongType()) for c in counts]))])
    return with_word_facts(low, "_low", [F.col(id_col), F.col("_low")], facts, (0, 1, 2), use, schema)


def _joined_counts(df: DataFrame, facts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    counted = _chunked_counts(df, facts, id_col, text_col, COUNTS, [id_col])  # none of these reads the text as it is
    return counted.select(id_col, *[F.col("_n")[c].alias(c) for c in COUNTS])


def word_list_features(df: DataFrame, lists: WordLists, id_col="essay_id", text_col="essay") -> DataFrame:
    """Per row: id, POS counts (F9-F13), spelling errors (F14), words outside the
    easy list and difficult words (F18/F19 inputs)."""
    facts = word_facts(lists).persist()  # measured, then sent or joined
    if not fits_broadcast(facts):
        return _joined_counts(df, facts, id_col, text_col)
    counted = df.select(id_col, _scan_column(facts, text_col, COUNTS).alias("_wl"))
    facts.unpersist()
    return counted.select(id_col, *[F.col("_wl")[c].alias(c) for c in COUNTS])


def generate_features(df: DataFrame, lists: WordLists, id_col="essay_id", text_col="essay") -> DataFrame:
    """the input row plus the 24 features in the reference's order.

    One scan of the texts gives all counts (``functions/scan.py``), and the
    formulas are built on them."""
    counts = [*scan.TEXT_COUNTS, "num_stopwords", *COUNTS]
    facts = word_facts(lists).persist()  # measured, then sent or joined
    if fits_broadcast(facts):
        j = df.withColumn("_n", _scan_column(facts, text_col, counts))
        facts.unpersist()
    else:
        j = _chunked_counts(df, facts, id_col, text_col, counts, df.columns)
    # a null text has no counts but one sentence and no listed words, as in ``row_features``
    known = F.col(text_col).isNotNull()
    j = j.select(*df.columns, *[(F.col("_n")[c] if c in (*COUNTS, "num_sentences") else F.when(known, F.col("_n")[c])).alias(c) for c in counts])
    words, sentences = F.col("num_words").cast("double"), F.col("num_sentences")
    j = j.withColumns({
        "average_word_length": F.try_divide(F.col("_word_chars").cast("double"), words),
        "average_sentence_length": F.try_divide(words, sentences),
        **T.readability_formulas(F.col("_w"), sentences.cast("double"), F.col("_c"), F.col("_y"), F.col("_h"),
                                 F.col("_easy100"), F.col("_hard100"), F.col("_s100")),
    })
    w = F.nullif(F.col("_w"), F.lit(0)).cast("double")
    d = 100 * F.col("_not_easy") / w
    j = j.withColumn("dale_chall_index", 0.1579 * d + 0.0496 * w / sentences + F.when(d > 5, F.lit(3.6365)).otherwise(F.lit(0.0)))
    return j.select(*df.columns, *FEATURE_COLUMNS)
