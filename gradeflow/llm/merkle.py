"""Operator 7, document fingerprints: a Merkle tree over paragraphs and
sections, in DataFrame operations only.

Leaves are runs of at most ``LEAF`` code points of a paragraph (a line), so
that texts with few line breaks have branches too.  A paragraph's node is the
digest of its leaves, a section's that of ``SECTION`` consecutive paragraphs,
the root that of all sections.  Equal roots mean equal texts.  Where roots
differ the sections, then the paragraphs with differing nodes locate the edit
(``differing_paragraphs``).

The fingerprint is the root, a colon, and eight hex digits of every leaf.  The
likeness of two fingerprints is 1 for equal roots, else the share of distinct
leaves that both have among those that either has.

Documents are ordered by id for the successor of each.  A range of ids is a
window of its own, so one shuffle brings neighbours together; the first row of
each range follows the last of the range before.  The bounds of the ranges are
quantiles, one number for ``RANGE_BYTES`` of text.

Cases.  A null text is empty.  Null ids come first; rows with equal ids are
ordered by their text.  A table of one row is its own successor.  Other columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.blocks import partitions

LEAF = 64
SECTION = 8
RANGE_BYTES = 8 << 20


def paragraphs(text: Column) -> Column:
    """Per paragraph the digests of its leaves."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit("((?s).{1,%d})" % LEAF)), lambda x: F.md5(x))
    return F.transform(F.split(text, "\n"), leaves)


def paragraph_nodes(tree: Column) -> Column:
    return F.transform(tree, lambda p: F.md5(F.array_join(p, "")))


def section_nodes(nodes: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / SECTION).cast("int"))
    return F.transform(starts, lambda i: F.md5(F.array_join(F.slice(nodes, i * SECTION + 1, SECTION), "")))


def root(sections: Column) -> Column:
    return F.md5(F.concat(F.array_join(sections, ""), F.lit(":"), F.size(sections).cast("string")))


def short_leaves(tree: Column) -> Column:
    return F.transform(F.flatten(tree), lambda x: F.substring(x, 1, 8))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    either = F.size(F.array_union(leaves_a, leaves_b))
    both = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(root_a == root_b, 1.0).when(either == 0, 0.0).otherwise(both / either)


def differing_paragraphs(text_a: Column, text_b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``text_a`` that are in a section
    that differs and that differ themselves from the same place of ``text_b``."""
    a, b = paragraph_nodes(paragraphs(text_a)), paragraph_nodes(paragraphs(text_b))
    sa, sb = section_nodes(a), section_nodes(b)
    places = F.sequence(F.lit(0), F.size(a) - 1)
    section = lambda s, i: F.get(s, F.floor(i / SECTION).cast("int"))
    return F.filter(places, lambda i: ~section(sa, i).eqNullSafe(section(sb, i)) & ~F.get(a, i).eqNullSafe(F.get(b, i)))


def _with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    df = df.withColumn(f"_{prefix}tree", paragraphs(F.col(text)))
    df = df.withColumn(f"{prefix}root", root(section_nodes(paragraph_nodes(F.col(f"_{prefix}tree")))))
    return df.withColumn(f"{prefix}leaves", short_leaves(F.col(f"_{prefix}tree"))).drop(f"_{prefix}tree")


def _ranges(docs: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """Add ``range``, rising with ``id``; every range holds a row."""
    seen = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("id").alias("low")).first()
    n = max(1, math.ceil((seen["bytes"] or 0) / range_bytes))
    as_double = F.col("id").cast("double")
    if n == 1 or seen["low"] is None:
        return docs.withColumn("range", F.lit(0)), 1
    cuts = docs.agg(F.percentile_approx(as_double, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("c")).first()["c"]
    cuts = sorted({c for c in cuts if c > float(seen["low"])})
    if not cuts:
        return docs.withColumn("range", F.lit(0)), 1
    bucket = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_range")
    dealt = bucket.transform(docs.withColumn("_id", F.coalesce(as_double, F.lit(-math.inf))))
    return dealt.withColumn("range", F.col("_range").cast("int")).drop("_id", "_range"), len(cuts) + 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: id, ``n_chars``, the digest of the edited text, ``fingerprint``
    and ``edited_fingerprint``, and the likeness to the edited text and to the
    next document."""
    thin = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged, n = _ranges(thin, range_bytes)
    held = _with_tree(ranged.repartition(partitions(docs), "range"), "text", "")
    order = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "text")
    neighbour = lambda c: F.lead(c).over(order)
    near = (
        held.withColumn("_next", neighbour(F.struct("text", "root", "leaves")))
        .withColumn("_place", F.row_number().over(order))
    )
    first = near.filter(F.col("_place") == 1).select(
        F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.struct("text", "root", "leaves").alias("_over"))
    near = near.join(first, "range", "left").withColumn("_next", F.coalesce("_next", "_over")).drop("_over", "_place")
    chars = F.length("text")
    k = F.floor(chars / 4).cast("int")
    edited = near.withColumn("n_chars", chars.cast("long")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), chars - k), F.substring(F.col("_next.text"), F.lit(1), k)))
    done = _with_tree(edited, "edited", "edited_")
    print_of = lambda p: F.concat(F.col(f"{p}root"), F.lit(":"), F.array_join(F.col(f"{p}leaves"), ""))
    return done.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        print_of("").alias("fingerprint"), print_of("edited_").alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("_next.root"), F.col("_next.leaves")).alias("near_next"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nxt,
    length(coalesce(text, '')) AS n
  FROM documents WINDOW o AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, substr(text, 1, n - n // 4) || substr(nxt, 1, n // 4) AS edited FROM d
), p AS (
  SELECT doc_id, n, edited, @TREE(text)@ AS t, @TREE(edited)@ AS te, @TREE(nxt)@ AS tn FROM e
), q AS (
  SELECT doc_id, n, edited, @LEAVES(t)@ AS l, @LEAVES(te)@ AS le, @LEAVES(tn)@ AS ln,
    @NODES(t)@ AS a, @NODES(te)@ AS ae, @NODES(tn)@ AS an FROM p
), r AS (
  SELECT doc_id, n, edited, l, le, ln, @ROOT(a)@ AS r, @ROOT(ae)@ AS re, @ROOT(an)@ AS rn FROM q
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  r || ':' || array_to_string(l, '') AS fingerprint, re || ':' || array_to_string(le, '') AS edited_fingerprint,
  @LIKE(r,l,re,le)@ AS near_edited, @LIKE(r,l,rn,ln)@ AS near_next
FROM r
"""


def oracle_sql() -> str:
    import re

    rules = {
        "TREE": r"list_transform(string_split({0}, chr(10)), lambda x: list_transform(regexp_extract_all(x, '(?s).{{1,%d}}'), lambda y: md5(y)))" % LEAF,
        "LEAVES": "list_transform(flatten({0}), lambda x: substr(x, 1, 8))",
        "NODES": "list_transform({0}, lambda x: md5(array_to_string(x, '')))",
        "ROOT": "md5(array_to_string(list_transform(range(0, (len({0}) + %d) // %d), lambda i: md5(array_to_string({0}[i * %d + 1 : i * %d + %d], ''))), '') || ':' || ((len({0}) + %d) // %d)::VARCHAR)"
        % (SECTION - 1, SECTION, SECTION, SECTION, SECTION, SECTION - 1, SECTION),
        "LIKE": "CASE WHEN {0} = {2} THEN 1.0::DOUBLE WHEN len({1}) + len({3}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({1}, {3}))::DOUBLE / len(list_distinct(list_concat({1}, {3}))) END",
    }
    return re.sub(r"@(\w+)\(([^)]*)\)@", lambda m: rules[m[1]].format(*m[2].split(",")), SQL)
