"""Operator 9, SentencePiece encoding and decoding by a batched Viterbi search.

A text gets a leading space, spaces become the piece mark (U+2581), and the
text is cut before each run of marks.  No piece has a mark after another
character, so the best segmentation of a text is that of its words one by one.
Each distinct word of a batch is segmented once, and a bounded table keeps the
words of earlier batches.

Words of equal length advance together.  For each end position all words probe
their substrings at once: 64-bit hashes of the substrings are looked up in the
sorted keys of the pieces, the maximum over the starts is one vector operation,
and its argument is the back pointer (the longest last piece wins a tie).  A
character that is no piece becomes its UTF-8 bytes as byte pieces, which cost
``BYTE_PENALTY`` more than the rarest piece.

Scores.  A unigram model's pieces keep their log probabilities.  The scores of
a BPE model are ranks, so rank r gets -log(r + 1), the log probability of
Zipf's law up to a constant.  ``Pieces.load`` takes the path of the model file.

Decoding joins the pieces' bytes, turns marks into spaces and drops the leading
one.  It gives back every text exactly; a mark character in the text itself is
kept as bytes for that.

Cases.  A null text has null pieces, an empty one none.  Lone surrogates cannot
occur in Spark strings.  Very long words without a space are segmented like
others, in time that grows with their length.  Repeated rows are encoded alike.
Other columns are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradeflow.llm.words import Ranges, mix, powers, slices, text_bytes

MARK = 0x2581
KEPT_MARK = 0x110000  # stands for a mark that was in the text; no piece has it
BYTE_PENALTY = 10.0
CACHE_WORDS = 1_000_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_BASE = 0xC2B2AE3D27D4EB4F


@dataclass
class Pieces:
    """A vocabulary as arrays: ``keys`` ascending with ``ids`` and ``scores``
    beside them, the ``byte_id`` of each byte, and each id's ``spelling``."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_id: np.ndarray
    byte_score: float
    spelling: np.ndarray
    spelling_at: np.ndarray
    likely: np.ndarray

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        raw = [model.get_score(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranked = any(raw[i] < -1000 for i in plain)  # log probabilities are never that low
        score = {i: -math.log(i + 1) if ranked else raw[i] for i in plain}
        text = [model.id_to_piece(i) for i in range(size)]
        spelling = []
        byte_id = np.zeros(256, dtype=np.int32)
        for i in range(size):
            if model.is_byte(i):
                value = int(text[i][1:-1], 16)
                byte_id[value] = i
                spelling.append(bytes([value]))
            else:
                spelling.append(text[i].replace(chr(MARK), " ").encode() if i in score else b"")
        return cls.build({text[i]: (i, s) for i, s in score.items()}, byte_id, spelling)

    @classmethod
    def build(cls, pieces: dict[str, tuple[int, float]], byte_id: np.ndarray, spelling: list[bytes]) -> Pieces:
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in pieces):
            raise ValueError("a piece has a mark after another character; its texts can't be cut into words")
        longest = max(map(len, pieces))
        up, _ = powers(_BASE, longest)
        keys = mix(np.array([_sum(p, up) for p in pieces], dtype=np.uint64) + np.array([len(p) for p in pieces], dtype=np.uint64))
        order = np.argsort(keys)
        ids = np.array([i for i, _ in pieces.values()], dtype=np.int32)[order]
        scores = np.array([s for _, s in pieces.values()])[order]
        likely = np.zeros(1 << 20, dtype=bool)
        likely[keys >> np.uint64(44)] = True
        at = np.r_[0, np.cumsum([len(s) for s in spelling])]
        return cls(keys[order], ids, scores, longest, byte_id, float(scores.min()) - BYTE_PENALTY,
                   np.frombuffer(b"".join(spelling), dtype=np.uint8), at, likely)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the substrings with these keys are pieces, and which."""
        maybe = np.flatnonzero(self.likely[key >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == key[maybe]
        return maybe[hit], at[hit]


def _char_values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _sum(piece: str, up: np.ndarray) -> int:
    codes = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
    return int((_char_values(codes) * up[: len(codes)]).sum(dtype=np.uint64))


def utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def segment(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of equal-length words, one per row of ``codes``.  Returns
    flat ids in order and the number of ids of each word; a character without
    a piece is given as -1 - its code."""
    w, n = codes.shape
    up, down = powers(_BASE, n)
    sums = np.zeros((n + 1, w), dtype=np.uint64)
    np.cumsum(_char_values(codes.T) * up[:n, None], axis=0, out=sums[1:])
    best = np.full((n + 1, w), -np.inf)
    best[0] = 0.0
    back = np.zeros((n + 1, w), dtype=np.int32)
    used = np.zeros((n + 1, w), dtype=np.int32)
    for j in range(1, n + 1):
        low = max(0, j - pieces.longest)
        lengths = np.arange(j - low, 0, -1, dtype=np.uint64)[:, None]
        hit, at = pieces.find(mix((sums[j] - sums[low:j]) * down[low:j, None] + lengths).ravel())
        total = np.full((j - low) * w, -np.inf)
        which = np.zeros((j - low) * w, dtype=np.int32)
        total[hit] = best[low:j].ravel()[hit] + pieces.scores[at]
        which[hit] = pieces.ids[at]
        total, which = total.reshape(-1, w), which.reshape(-1, w)
        last = total[-1]
        bare = np.isneginf(last)
        if bare.any():
            code = codes[bare, j - 1].astype(np.int64)
            last[bare] = best[j - 1, bare] + utf8_length(code) * pieces.byte_score
            which[-1, bare] = -1 - code
        top = np.argmax(total, axis=0)
        row = np.arange(w)
        best[j], back[j], used[j] = total[top, row], low + top, which[top, row]
    path = np.zeros((n, w), dtype=np.int32)
    count = np.zeros(w, dtype=np.int64)
    at = np.full(w, n)
    row = np.arange(w)
    while len(row):
        path[count[row], row] = used[at[row], row]
        count[row] += 1
        at[row] = back[at[row], row]
        row = row[at[row] > 0]
    place = np.repeat(count, count) - 1 - _ramp(count)  # the path was found from its end
    return path[place, np.repeat(np.arange(w), count)], count


def _ramp(length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)


def spell_bytes(ids: np.ndarray, count: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by their byte pieces."""
    bare = ids < 0
    if not bare.any():
        return ids, count
    code = np.where(bare, -1 - ids.astype(np.int64), 0)
    code[code == KEPT_MARK] = MARK
    size = np.where(bare, utf8_length(code), 1)
    at = np.repeat(np.arange(len(ids)), size)
    k = _ramp(size)
    out = ids[at]
    b, c, s = bare[at], code[at], size[at]
    shift = 6 * (s - 1 - k)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[s]
    byte = np.where(k == 0, lead | (c >> shift), 0x80 | ((c >> shift) & 0x3F))
    out[b] = pieces.byte_id[byte[b]]
    word = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(word, weights=size, minlength=len(count)).astype(np.int64)


class Encoder:
    """Encodes batch after batch; keeps up to ``CACHE_WORDS`` segmented words."""

    def __init__(self, pieces: Pieces, cache_words: int = CACHE_WORDS):
        self.pieces, self.cache_words = pieces, cache_words
        self._clear()

    def _clear(self):
        self.known = np.empty(0, dtype=np.uint64)
        self.first = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.int32)

    def _learn(self, keys, codes, start, size):
        """Segment new words; ``keys`` ascending."""
        flats, counts, order = [], [], []
        by_size = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[by_size])) + 1
        for group in np.split(by_size, cuts):
            n = int(size[group[0]])
            for part in np.array_split(group, max(1, len(group) * n >> 17)):
                flat, count = segment(codes[start[part][:, None] + np.arange(n)], self.pieces)
                flat, count = spell_bytes(flat, count, self.pieces)
                flats.append(flat)
                counts.append(count)
                order.append(part)
        order, count, flat = np.concatenate(order), np.concatenate(counts), np.concatenate(flats)
        first = np.cumsum(count) - count + len(self.flat)
        known = np.concatenate([self.known, keys[order]])
        sort = np.argsort(known)
        self.known = known[sort]
        self.first = np.concatenate([self.first, first])[sort]
        self.count = np.concatenate([self.count, count])[sort]
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, column) -> pa.ListArray:
        data, offsets = text_bytes(column)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
        begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        codes[codes == MARK] = KEPT_MARK
        codes[codes == 32] = MARK
        full = np.diff(begins) > 0
        codes = np.insert(codes, begins[:-1][full], MARK)
        begins = begins + np.r_[0, np.cumsum(full)]
        cut = codes == MARK
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[begins] = True
        cut[1:] &= (codes[:-1] != MARK) | edge[1:-1]
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, len(codes)])
        keys, index, inverse = np.unique(
            Ranges(_char_values(codes)).of(start, start + size), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > self.cache_words:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[at] != keys if len(self.known) else np.ones(len(keys), dtype=bool)
        if new.any():
            self._learn(keys[new], codes, start[index[new]], size[index[new]])
        place = np.searchsorted(self.known, keys)[inverse]
        count = self.count[place]
        ids = self.flat[_ramp(count) + np.repeat(self.first[place], count)]
        word_of = np.searchsorted(start, begins)
        bounds = np.r_[0, np.cumsum(count)][word_of]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        null = column.is_null()
        return pa.compute.if_else(null, pa.scalar(None, lists.type), lists) if column.null_count else lists


def decode(lists, pieces: Pieces) -> pa.Array:
    """Texts of lists of ids."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids = lists.flatten().to_numpy().astype(np.int64)
    size = np.diff(pieces.spelling_at)[ids]
    data = pieces.spelling[_ramp(size) + np.repeat(pieces.spelling_at[:-1][ids], size)]
    n_ids = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
    ends = np.r_[0, np.cumsum(size)][np.cumsum(n_ids)]
    begins = np.r_[0, ends[:-1]]
    raw = data.tobytes()
    null = lists.is_null().to_pylist()
    return pa.array([None if z else raw[s + 1 if e > s else s : e].decode("utf-8") for s, e, z in zip(begins, ends, null)], pa.string())


def encode_documents(docs: DataFrame, pieces: Pieces, text_col: str = "text", name: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of its texts added (a column of that name is replaced)."""
    rest = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # its size is the vocabulary's

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            yield pa.RecordBatch.from_arrays([*batch.columns, encoder.encode(batch.column(text_col))], [*batch.schema.names, name])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def decode_documents(docs: DataFrame, pieces: Pieces, ids_col: str = "piece_ids", name: str = "decoded", rows: int = 512) -> DataFrame:
    """``docs`` with the text of its ids added."""
    rest = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, decode(batch.column(ids_col), shared.value)], [*batch.schema.names, name])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(name, StringType())]))
