"""Row-local text expressions (Block B features F1-F8, F16-F24, cleaning,
tokenising).  All are built-in Column expressions, so they run in the scan
stage with no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.functions import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- tokens
def ws_tokens(text) -> Column:
    """Python ``str.split()`` tokens."""
    return F.regexp_extract_all(_c(text), F.lit(P.WS_TOKEN), 0)


def letter_words(text) -> Column:
    """``\\p{L}+`` runs, the word unit of the readability formulas."""
    return F.regexp_extract_all(_c(text), F.lit(P.WORD), 0)


def lemma_tokens(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(P.LEMMA_TOKEN), 0)


def keras_tokens(text) -> Column:
    """V1: lower-case, Keras filter characters and blanks split, empties dropped."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(P.KERAS_TOKEN), 0)


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit(P.SYLLABLE)))


# ---------------------------------------------------------------- F1-F8
def num_words(text) -> Column:
    # a count of matches: no token array is built
    return F.regexp_count(_c(text), F.lit(P.WS_TOKEN)).cast("long")


def num_sentences(text) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(_c(text), F.lit(P.SENTENCE_END))).cast("long")


def num_lemmas(text) -> Column:
    return F.regexp_count(_c(text), F.lit(P.LEMMA_TOKEN)).cast("long")


def num_stopwords(text) -> Column:
    """Lemma tokens that are stop words: one regex pass over the lower-cased
    text (a stop word must be a whole letter run; words with an apostrophe
    can never be a letter-run token)."""
    words = sorted((w for w in P.english_stop_words() if w.isalpha()), key=lambda w: (-len(w), w))
    pattern = r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})"
    return F.regexp_count(F.lower(_c(text)), F.lit(pattern)).cast("long")


def count_char(text, ch: str) -> Column:
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))).cast("long")


def num_commas(text) -> Column:
    return count_char(text, ",")


def num_exclamation_marks(text) -> Column:
    return count_char(text, "!")


def num_question_marks(text) -> Column:
    return count_char(text, "?")


def average_word_length(text) -> Column:
    """Characters of the whitespace tokens / their number (null for no token)."""
    t = _c(text)
    chars = F.length(t) - F.regexp_count(t, F.lit(P.WS_CLASS))
    return F.try_divide(chars.cast("double"), num_words(t))


def average_sentence_length(text) -> Column:
    return F.try_divide(num_words(text).cast("double"), num_sentences(text))


# ---------------------------------------------------------------- readability
def readability_parts(text) -> dict[str, Column]:
    """W, S, C, Y, H and the Linsear parts, from one word extraction.

    The caller materialises ``_words``/``_syl`` once (``withColumns``) and
    builds the formulas on top, so the regex runs once per text.
    """
    t = _c(text)
    words = letter_words(t)
    return {
        "_words": words,
        "_syl": F.transform(words, syllables),
        "_s": num_sentences(t),
        "_s100": F.greatest(
            F.lit(1), F.regexp_count(F.regexp_extract(t, P.FIRST_100_WORDS, 0), F.lit(P.SENTENCE_END))
        ),
    }


def readability_from_parts() -> dict[str, Column]:
    """Formulas over the columns of :func:`readability_parts`."""
    words, syl = F.col("_words"), F.col("_syl")
    first = F.slice(syl, 1, 100)
    return readability_formulas(
        F.size(words), F.col("_s").cast("double"), F.length(F.array_join(words, "")),
        F.aggregate(syl, F.lit(0).cast("long"), lambda acc, x: acc + x), F.size(F.filter(syl, lambda x: x >= 3)),
        F.size(F.filter(first, lambda x: x < 3)), F.size(F.filter(first, lambda x: x >= 3)), F.col("_s100"))


def readability_formulas(n_words, s, n_letters, y, n_hard, easy100, hard100, s100) -> dict[str, Column]:
    """The indices from the number of words, sentences, letters, syllables and
    words of three syllables or more, and the Linsear parts."""
    w = F.nullif(n_words, F.lit(0)).cast("double")
    c, h = n_letters.cast("double"), n_hard.cast("double")
    r = (easy100 + 3 * hard100) / s100
    return {
        "automated_readability_index": 4.71 * c / w + 0.5 * w / s - 21.43,
        "coleman_liau_index": 0.0588 * (100 * c / w) - 0.296 * (100 * s / w) - 15.8,
        "flesch_kincaid_grade": 0.39 * w / s + 11.8 * y / w - 15.59,
        "gunning_fog": 0.4 * (w / s + 100 * h / w),
        "linsear_write_formula": F.when(w.isNotNull(), F.when(r > 20, r / 2).otherwise((r - 2) / 2)),
        "smog_index": F.when(w.isNotNull(), F.when(s < 3, F.lit(0.0)).otherwise(1.043 * F.sqrt(30 * h / s) + 3.1291)),
        "syllables_count": y.cast("long"),
    }


# ---------------------------------------------------------------- cleaning
def clean_text(text) -> Column:
    """P5: blank runs -> one blank, then drop characters outside the kept set."""
    collapsed = F.regexp_replace(_c(text), F.lit(P.BLANK_RUN), F.lit(" "))
    return F.regexp_replace(collapsed, F.lit(P.CLEAN_DROP), F.lit(""))


def normalize_quotes(text, keep_ellipsis: bool = False) -> Column:
    """cp1252 curly quotes read as Latin-1 -> '"'; the ellipsis byte is
    removed (set 3 keeps it: ``keep_ellipsis``)."""
    if keep_ellipsis:
        return F.translate(_c(text), "\u0093\u0094", '""')
    return F.translate(_c(text), "\u0093\u0094\u0085", '""')


def quotes(text) -> Column:
    """K1: every ``"..."`` span, inner text."""
    return F.regexp_extract_all(_c(text), F.lit(P.QUOTE), 1)
