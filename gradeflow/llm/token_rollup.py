"""Operator 10, token counts: rollups maintained by signed deltas.

Totals of documents and tokens by source, language and tokenizer version are
additive.  ``signed_changes`` compares two states of the per-document counts:
an inserted count adds, a deleted one subtracts, a revised one does both.
``commit`` aggregates the changes of a batch (map-side first, so a hot source
is a few rows per task) and writes them as that batch's delta.  A batch is
committed once Spark's ``_SUCCESS`` file is in its folder: committing it again
does nothing, and a batch that was cut short is written anew.  ``totals`` adds
up the committed deltas.  ``compact`` replaces the deltas so far by their sum.

Cases.  Null sources, languages and versions are groups of their own.  Null
counts are 0 tokens.  Rows that repeat a key are summed before they are
compared.  A group whose documents all went has no row.  Empty states give
empty deltas, and no committed batch gives empty totals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, documents long, tokens long"

#: Token patterns of the versions counted by ``count_tokens``.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-1": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"}


def count_tokens(text, version: str):
    """Tokens of a text column under one of ``VERSIONS`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def signed_changes(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both states have ``key``, the group columns and ``tokens``.  Returns
    group columns, ``documents`` and ``tokens`` with signs."""
    cols = [key, *GROUP]
    sign = lambda df, s: df.select(*cols, F.lit(s).cast("long").alias("documents"), (F.coalesce("tokens", F.lit(0)) * s).cast("long").alias("tokens"))
    both = sign(before, -1).unionAll(sign(after, 1))
    net = both.groupBy(*cols).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return net.filter((F.col("documents") != 0) | (F.col("tokens") != 0)).select(*GROUP, "documents", "tokens")


class Rollup:
    """A rollup kept under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, name: str) -> bool:
        path, store = self._path(f"{name}/_SUCCESS")
        return store.exists(path)

    def _names(self) -> list[str]:
        path, store = self._path("")
        if not store.exists(path):
            return []
        return sorted(s.getPath().getName() for s in store.listStatus(path) if self._done(s.getPath().getName()))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest sum of older batches and the batches that it covers."""
        bases = [n for n in self._names() if n.startswith("base-")]
        if not bases:
            return None, set()
        covered = self.spark.read.text(f"{self.root}/{bases[-1].replace('base', 'covers')}").collect()
        return bases[-1], {r["value"] for r in covered}

    def committed(self) -> list[str]:
        live = {n.removeprefix("batch-") for n in self._names() if n.startswith("batch-")}
        return sorted(live | self._base()[1])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before."""
        if batch in self.committed():
            return False
        delta = changes.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        base, covered = self._base()
        return self._sum(base, [n for n in self._names() if n.startswith("batch-") and n.removeprefix("batch-") not in covered])

    def _sum(self, base: str | None, names: list[str]) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in ([base] if base else []) + names]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        total = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return total.filter((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Write the sum of all deltas listed now as one; these are not read
        again.  Batches committed meanwhile stay beside it, and each of two
        compactions at once has a name and a list of its own."""
        base, covered = self._base()
        names = [n for n in self._names() if n.startswith("batch-") and n.removeprefix("batch-") not in covered]
        number = f"{len([n for n in self._names() if n.startswith('base-')]):09d}-{uuid.uuid4().hex}"
        listed = self.spark.createDataFrame([(n,) for n in sorted(covered | {n.removeprefix("batch-") for n in names})], "value string")
        listed.write.mode("overwrite").text(f"{self.root}/covers-{number}")
        self._sum(base, names).write.mode("overwrite").parquet(f"{self.root}/base-{number}")


def without_repeated_lines(text):
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def corpus_history(docs: DataFrame, rollup: Rollup) -> DataFrame:
    """Totals after a corpus's life: all documents are inserted, their counts
    are revised once repeated lines are gone, exact copies of a document with a
    smaller id are deleted, and a second tokenizer version is added for the
    rest.  The revision is committed twice, as by a driver that retries."""
    clean = without_repeated_lines(F.col("text"))
    old, new = VERSIONS
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.when(F.length("text") > 0, F.md5("text")).alias("digest"), count_tokens(F.col("text"), old).alias("raw"),
        count_tokens(clean, old).alias("revised"), count_tokens(clean, new).alias("second")).checkpoint()
    # found again by digest and id, so the copies of one text are not one task
    least = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(least, ["digest", "doc_id"], "left").withColumn(
        "copy", F.col("digest").isNotNull() & F.col("doc_id").isNotNull() & F.col("first").isNull())
    state = lambda df, version, tokens: df.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), F.col(tokens).alias("tokens"))
    none = state(rows, old, "raw").limit(0)
    rollup.commit("1-insert", signed_changes(none, state(rows, old, "raw")))
    revision = signed_changes(state(rows, old, "raw"), state(rows, old, "revised"))
    rollup.commit("2-revise", revision)
    rollup.commit("3-delete", signed_changes(state(marked.filter("copy"), old, "revised"), none))
    rollup.commit("4-version", signed_changes(none, state(marked.filter("NOT copy"), new, "second")))
    rollup.commit("2-revise", revision)
    return rollup.totals()


SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, CASE WHEN length(text) > 0 AND doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS copy,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), c AS (
  SELECT doc_id, source, lang, array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), chr(10)) AS text
  FROM d WHERE copy = 0
), v AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM c
  UNION ALL
  SELECT source, lang, 'marks-1', len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) FROM c
)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS documents, sum(n)::BIGINT AS tokens FROM v GROUP BY ALL
"""
