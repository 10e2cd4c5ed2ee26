"""One scan of a batch of texts that yields the counts behind all 24 features.

Every byte of the batch gets a set of classes: a table lookup for ASCII, the
Unicode category for the bytes of longer characters.  Tokens are runs of a class,
so the three token streams, syllables, sentence ends and marks all come from the
same array, without a regex or a Python loop per text or word.  The results
equal those of the Column expressions in ``functions/text.py``; the classes are
those of ``functions/patterns.py``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, WS, KERAS_SEP, BLANK, STOP, VOWEL, POINT = (1 << i for i in range(8))

# Blanks of Python's str.split(), the blanks of the lemma pattern,
# the separators of the Keras tokenizer, the ends of a sentence.
_PY_BLANKS = [*range(9, 14), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LEMMA_BLANKS = " \t\n\r\f\x0b"
_KERAS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n '
_SENTENCE = ".!?"
_DOTTED_I = 0x130  # its lower case is a vowel and a combining dot, which ends a run of vowels


def _class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))[0]
    out = LETTER if kind == "L" else NUMBER if kind == "N" else 0
    out |= WS if code in _PY_BLANKS else 0
    c = chr(code)
    out |= KERAS_SEP if c in _KERAS else 0
    out |= BLANK if c in _LEMMA_BLANKS else 0
    out |= STOP if c in _SENTENCE else 0
    return out | (VOWEL if c in "aeiouyAEIOUY" or code == _DOTTED_I else 0)


_ASCII = np.array([_class_of(c) | POINT for c in range(128)] + [0] * 128, dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and each row's offset (nulls are empty)."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Scan:
    """Classes of every byte of a batch; all bytes of a character have its
    classes, its first byte has POINT too."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        data = self.data
        self.rows = len(self.offsets) - 1
        self.classes = _ASCII[data]
        self.dotted = np.empty(0, dtype=np.int64)
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            code = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
            for k in range(1, 4):
                more = size > k
                code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
            kinds, which = np.unique(code, return_inverse=True)
            kind = np.array([_class_of(c) for c in kinds.tolist()], dtype=np.uint8)[which]
            self.classes[lead] = kind | POINT
            for k in range(1, 4):
                more = size > k
                self.classes[lead[more] + k] = kind[more]
            self.dotted = lead[code == _DOTTED_I] + 1
        self.edge = np.zeros(len(data) + 1, dtype=bool)
        self.edge[self.offsets] = True

    def has(self, bits: int) -> np.ndarray:
        return (self.classes & bits) != 0

    def starts(self, inside: np.ndarray) -> np.ndarray:
        """Marks of the first byte of each run of ``inside`` within a row."""
        out = inside.copy()
        if len(out):
            out[1:] &= ~inside[:-1] | self.edge[1:-1]
        return out

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = inside.copy()
        if len(ends):
            ends[:-1] &= ~inside[1:] | self.edge[1:-1]
        return np.flatnonzero(self.starts(inside)), np.flatnonzero(ends) + 1

    def per_row(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of each row."""
        return np.diff(self.before(marks)[self.offsets])

    def before(self, marks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(marks, out=out[1:])
        return out

    def char(self, c: str) -> np.ndarray:
        return self.per_row(self.data == ord(c))

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1

    def tokens(self, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The runs of ``inside`` as strings, and the row of each."""
        start, end = self.runs(inside)
        offsets = np.zeros(len(start) + 1, dtype=np.int64)
        np.cumsum(end - start, out=offsets[1:])
        body = pa.py_buffer(np.ascontiguousarray(self.data[inside]))
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), body), self.row_of(start)


#: What a text gives without word lists.
TEXT_COUNTS = ["num_words", "num_sentences", "num_lemmas", "num_commas", "num_exclamation_marks", "num_question_marks",
               "_word_chars", "_w", "_c", "_y", "_h", "_easy100", "_hard100", "_s100"]


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The values of ``TEXT_COUNTS`` for each text."""
    s = Scan(column)
    point, letter, number = s.has(POINT), s.has(LETTER), s.has(NUMBER)
    others = point & ~s.has(LETTER | NUMBER | BLANK)
    stop = s.starts(s.has(STOP))
    start, end = s.runs(letter)
    vowel = s.has(VOWEL)
    groups = s.starts(vowel)
    after = s.dotted[s.dotted + 1 <= len(vowel) - 1] + 1 if len(vowel) else s.dotted
    groups[after] |= vowel[after]  # what follows a dotted capital i begins a group of its own
    seen = s.before(groups)
    syllables = np.maximum(seen[end] - seen[start], 1)
    row = s.row_of(start)
    words = np.bincount(row, minlength=s.rows)
    first = np.cumsum(words) - words
    total = lambda w: np.bincount(row[w], minlength=s.rows)
    early = np.arange(len(row)) - first[row] < 100
    last = np.minimum(words, 100) + first - 1  # the 100th word or the last
    stops = s.before(stop)
    some = words > 0
    s100 = np.zeros(s.rows, dtype=np.int64)
    s100[some] = stops[end[last[some]]] - stops[s.offsets[:-1][some]]
    return [
        s.per_row(s.starts(~s.has(WS))), np.maximum(1, s.per_row(stop)),
        words + s.per_row(s.starts(number)) + s.per_row(others), s.char(","), s.char("!"), s.char("?"),
        s.per_row(point & ~s.has(WS)), words, s.per_row(letter & point), np.bincount(row, weights=syllables, minlength=s.rows).astype(np.int64),
        total(syllables >= 3), total(early & (syllables < 3)), total(early & (syllables >= 3)), np.maximum(1, s100),
    ]


def streams(lower: pa.Array) -> list[tuple[pa.Array, np.ndarray]]:
    """(words, rows) of the three token streams of lower-cased texts: Keras
    tokens, blank-separated tokens, runs of letters."""
    s = Scan(lower)
    return [s.tokens(~s.has(KERAS_SEP)), s.tokens(~s.has(WS)), s.tokens(s.has(LETTER))]


def slices(column: pa.Array, limit: int = 4 << 20):
    """(start, length) of runs of rows with about ``limit`` bytes of text."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to - at
        at = to
