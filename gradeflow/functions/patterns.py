"""Text patterns shared by the Spark code and the DuckDB oracle SQL.

Every pattern here is valid in both Java regex and RE2: no look-around, no
``\\w`` (ASCII in Java and RE2, Unicode in Python), ``\\x{..}`` escapes.
"""

from __future__ import annotations

# Characters Python's str.split() treats as blanks.
WS_CLASS = (
    r"[ \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_TOKEN = (
    r"[^ \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
SENTENCE_END = r"[.!?]+"
WORD = r"\p{L}+"
# word-or-number-or-single-symbol token (stands in for a linguistic tokenizer)
LEMMA_TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\r\f\x{0B}]"
SYLLABLE = r"[aeiouy]+"
# the first 100 letter-words with what precedes them
FIRST_100_WORDS = r"^([^\p{L}]*\p{L}+){0,100}"
QUOTE = r'"([^"]*)"'

# The Keras default filter set of text_to_word_sequence
# (the characters !"#$%&()*+,-./:;<=>?@[\]^_`{|}~ plus tab and newline), and
# the blank it splits on.  The class below lists them escaped for regex.
KERAS_TOKEN = r'[^!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n ]+'

# Cleaning rule (P5): characters kept after collapsing blanks.
CLEAN_DROP = r'[^\p{L}\p{N}_,.:;\[\]()/!@#$%^&*+{}<>=?~|" \-]'
BLANK_RUN = r"[ \t\n\r\f\x{0B}]+"


# The default English stop-word list of Spark ML (181 words), kept
# as text so that loading the registry needs no file.
_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
"""


def english_stop_words() -> tuple[str, ...]:
    """The stop words, one list for the Spark side and the SQL oracle."""
    return tuple(_STOP_WORDS.split())


def sql_str(s: str) -> str:
    """SQL string literal (standard quoting, no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


def sql_str_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"
