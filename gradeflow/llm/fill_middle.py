"""Operator 12, fill-in-middle: documents cut at random units into prefix,
middle and suffix, and put together with markers.

A unit is a run of ASCII letters or any other single code point.  The texts of
a batch (2 MB of them at a time) lie one after the other in a byte buffer that is cut into blocks of
``BLOCK`` bytes.  A Fenwick tree over the blocks stores how many units and how
many code points begin in each.  A cut after k units of a document is the k-th
unit start behind the units of the documents before it: a binary-lifting descent
finds the last block with fewer unit starts before it, for all cuts of the batch
in one pass over the levels of the tree, and carries the code points on the
way.  Inside the block the place is found from its own unit starts.

Only the numbers leave Python (units, code points of prefix and middle); texts
are cut and joined by Spark.  h1 to h4 are the first four groups of eight hex
digits of the SHA-256 of ``<seed>:<id>``: h1 and h2 choose the cuts, h3 whether
the text is cut at all (``rate`` in a hundred), h4 the order of the parts.  A
text that holds one of the markers stays plain, so ``restored`` finds each
marker at one place only: no marker overlaps with itself or another.

Cases.  A null text is empty and stays plain.  The id may be null (it counts as
an empty string).  Repeated rows are cut alike.  All other columns are kept,
except those whose names are among the results.  A text of any length is cut as a
whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.words import slices, text_bytes

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")

_CUTS = "n long, prefix_chars long, middle_chars long"
_CUT_TYPE = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


class Fenwick:
    """Prefix sums of several counts over blocks; ``counts`` is (blocks, kinds)."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        before = np.zeros((self.n + 1, counts.shape[1]), dtype=np.int64)
        np.cumsum(counts, axis=0, out=before[1:])
        at = np.arange(self.n + 1)
        self.tree = before - before[at - (at & -at)]

    def before(self, block: np.ndarray) -> np.ndarray:
        """Sums over the blocks ahead of each ``block``."""
        out = np.zeros((len(block), self.tree.shape[1]), dtype=np.int64)
        at = block.copy()
        while at.any():
            out += self.tree[at]  # tree[0] is zero
            at &= at - 1
        return out

    def descend(self, wanted: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each ``wanted`` (from 1) the block in which the running count of
        ``kind`` reaches it, and the sums over the blocks ahead of that block."""
        at = np.zeros(len(wanted), dtype=np.int64)
        sums = np.zeros((len(wanted), self.tree.shape[1]), dtype=np.int64)
        step = 1 << (self.n.bit_length() - 1) if self.n else 0
        while step:
            to = at + step
            fine = to <= self.n
            more = self.tree[np.where(fine, to, 0)]
            fine &= sums[:, kind] + more[:, kind] < wanted
            at[fine] = to[fine]
            sums[fine] += more[fine]
            step >>= 1
        return at, sums


class Units:
    """Unit and code-point starts of the texts of one batch."""

    def __init__(self, column, block: int = BLOCK):
        self.data, self.offsets = text_bytes(column)
        self.block = block
        data = self.data
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        self.point = (data & 0xC0) != 0x80
        self.unit = self.point.copy()
        if len(data):
            inner = letter[1:] & letter[:-1]
            first = self.offsets[:-1]
            inner[first[(first > 0) & (first < len(data))] - 1] = False  # a text's first byte begins a unit
            self.unit[1:] &= ~inner
        starts = np.arange(0, len(data), block)
        count = lambda x: np.add.reduceat(x, starts, dtype=np.int64) if len(data) else np.empty(0, np.int64)
        self.tree = Fenwick(np.stack([count(self.unit), count(self.point)], axis=1))
        ahead = self._ahead(self.offsets)
        self.n_units, self.n_points = np.diff(ahead[:, 0]), np.diff(ahead[:, 1])
        self.ahead = ahead[:-1]

    def _ahead(self, place: np.ndarray) -> np.ndarray:
        """(units, code points) that begin before each byte position."""
        block = place // self.block
        out = self.tree.before(block)
        return out + self._local(block, place - block * self.block)

    def _local(self, block: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Starts among the first ``size`` bytes of each block."""
        out = np.zeros((len(block), 2), dtype=np.int64)
        for s in range(0, len(block), 4096):
            part = slice(s, s + 4096)
            at = block[part, None] * self.block + np.arange(self.block)
            inside = (np.arange(self.block) < size[part, None]) & (at < len(self.data))
            at = np.where(inside, at, 0)
            for k, flags in enumerate((self.unit, self.point)):
                if len(flags):
                    out[part, k] = (flags[at] & inside).sum(axis=1)
        return out

    def points_before(self, k: np.ndarray) -> np.ndarray:
        """Code points of each text ahead of its unit number ``k`` (from 0);
        all of them for the number of its units."""
        out = self.n_points.copy()
        inner = np.flatnonzero(k < self.n_units)
        wanted = self.ahead[inner, 0] + k[inner] + 1
        block, sums = self.tree.descend(wanted)
        left = wanted - sums[:, 0]  # the unit start inside the block, from 1
        for s in range(0, len(inner), 4096):
            part = slice(s, s + 4096)
            at = block[part, None] * self.block + np.arange(self.block)
            inside = at < len(self.data)
            at = np.where(inside, at, 0)
            reached = np.cumsum(self.unit[at] & inside, axis=1)
            place = (reached < left[part, None]).sum(axis=1)
            points = (self.point[at] & (np.arange(self.block) < place[:, None])).sum(axis=1)
            out[inner[part]] = sums[part, 1] + points - self.ahead[inner[part], 1]
        return out


def cut_points(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """(units, code points of the prefix, of the middle) of each text, for a few
    MB of texts at a time."""
    done = [np.empty((3, 0), dtype=np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([text, h1, h2], ["text", "h1", "h2"]), "text"):
        units = Units(part.column("text"))
        n = units.n_units
        a, b = (part.column(h).to_numpy(zero_copy_only=False) % (n + 1) for h in ("h1", "h2"))
        low, high = units.points_before(np.minimum(a, b)), units.points_before(np.maximum(a, b))
        done.append(np.stack([n, low, high - low]))
    return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(done, axis=1)], fields=list(_CUT_TYPE))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """The columns of ``docs`` with ``n`` (units), ``form`` (plain, psm or spm),
    ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``."""
    cut = F.arrow_udf(cut_points, _CUTS)
    kept = docs.drop(*[c for c in RESULTS if c not in (id_col, text_col)])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("_fim_digest", 8 * i + 1, 8), 16, 10).cast("long")
    out = kept.withColumn("_fim_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_fim_digest", digest)
    out = out.withColumn("_fim", cut("_fim_text", number(0), number(1)))
    text = F.col("_fim_text")
    plain = (text == "") | (number(2) % 100 >= rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(marker))
    form = F.when(plain, "plain").when(number(3) % 100 < spm, "spm").otherwise("psm")
    out = out.withColumn("_fim_form", form)
    a, b = F.col("_fim.prefix_chars"), F.col("_fim.middle_chars")
    prefix, middle = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), b.cast("int"))
    suffix = F.substring(text, (a + b + 1).cast("int"), F.length(text))
    put = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    output = (F.when(F.col("_fim_form") == "plain", text)
              .when(F.col("_fim_form") == "psm", put(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
              .otherwise(put(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    shown = lambda c: F.when(F.col("_fim_form") != "plain", c)
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("_fim.n").alias("n"), F.col("_fim_form").alias("form"),
                      shown(a).alias("prefix_chars"), shown(b).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    after = lambda x, m: F.substring_index(x, m, -1)
    ahead = lambda x, m: F.substring_index(x, m, 1)
    middle = after(output, MIDDLE)
    body = ahead(output, MIDDLE)
    psm = F.concat(after(ahead(body, SUFFIX), PREFIX), middle, after(body, SUFFIX))
    spm = F.concat(after(body, PREFIX), middle, after(ahead(body, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u
), p AS (
  SELECT doc_id, t, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
