"""Operator 8, mixing sources to target weights by Pareto order sampling, in
DataFrame operations only.

Targets.  The sources share the total size by their weights.  A target stops
at ``most`` times its source's size, and the excess goes to the other sources
by weight until no target is above.

Sample.  A source with target f times its size takes floor(f) copies of each
document for certain; the rest r of f is the inclusion probability of one more
copy.  A document's rank is its random odds u / (1 - u) over its inclusion odds
r / (1 - r), smallest first.  u is a hash of the id and a seed, so reruns agree.
The sample has a fixed size in words: documents are taken in rank order as long
as they fit into what is left of the target.  ``rounds - 1`` further passes
offer the remaining gap, in rank order, to the documents that fit into it.

A source may hold a third of all rows.  Its running sum over the ranks is two
sums: over ``BUCKETS`` ranges of the rank (one aggregated row each), and inside
one range.

Cases.  Null or empty text has size 0 and is taken 0 times.  A null source is a
source of its own and comes last.  Rows that repeat id, text and source are
decided together.  Null ids are ranked like an id of their own.  ``mix_sources``
keeps other columns, whatever their names.  With no words at all every target is 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.plans.rank import global_rank
from gradeflow.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
ROUNDS = 5
BUCKETS = 4096
SALT = 64
SEED = "mix-1"


def random_unit(id_col: Column, seed: str) -> Column:
    """48 bits of a digest of the id, as a number strictly between 0 and 1."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(units: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target): one row per source.  Each round of
    the resharing is one aggregate over the sources."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], name="sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = ranked.withColumn("weight", weight).checkpoint()
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    share, cap = 0.0, F.col("source_size") * most
    full = F.lit(False)
    capped = -1
    while True:
        now = table.select(F.when(full, cap).otherwise(0).alias("c"), F.when(full, 0).otherwise(F.col("weight")).alias("w")).agg(
            F.sum("c").alias("c"), F.sum("w").alias("w"), F.count(F.when(F.col("w") == 0, 1)).alias("n")).first()
        if not now["w"] or now["n"] == capped:
            break
        capped = now["n"]
        share = (total - now["c"]) / now["w"]
        full = F.lit(share) * F.col("weight") > cap
    # a source that is above its cap for a smaller share is above it for a larger one
    return table.select("source", "sid", "source_size",
                        F.when(full, cap.cast("double")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def _fit(items: DataFrame, left: Column) -> DataFrame:
    """Mark ``take``: the rows whose running sum in rank order is at most
    ``left``, a column that is the same for all rows of a source."""
    sums = items.groupBy("sid", "bucket").agg(F.sum("words").alias("_sum"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("q", "id", "row_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = items.join(base, ["sid", "bucket"]).withColumn("_run", F.col("_base") + F.sum("words").over(inside))
    return run.withColumn("take", F.col("_run") <= left).drop("_base", "_run")


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.xxhash64(id_col, text_col, source_col)


def choose_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, most: int = MOST, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """One row per distinct (id, text, source): ``row_key``, ``size``,
    ``source_size``, ``target`` and ``copies``."""
    ensure_checkpoint_dir(docs.sparkSession)
    units = docs.select(
        row_key(id_col, text_col, source_col).alias("row_key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).groupBy("row_key", "id", "source", "size").agg(F.count("*").alias("m")).checkpoint()
    targets = source_targets(units, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = random_unit(F.col("id"), seed)
    rows = (
        units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("rest", rate - F.floor(rate))
        .withColumn("words", F.col("size") * F.col("m"))
        .withColumn("odds", u / (1 - u))
        .withColumn("q", F.when(F.col("rest") > 0, F.col("odds") / (F.col("rest") / (1 - F.col("rest")))))
        # u itself is uniform and rises with q inside a source
        .withColumn("bucket", F.floor(u * BUCKETS).cast("int"))
        .withColumn("extra", F.lit(0).cast("long"))
        .select("row_key", "id", "sid", "size", "source_size", "target", "whole", "words", "q", "bucket", "extra")
        .checkpoint()
    )
    for _ in range(rounds):
        gap = rows.groupBy("sid").agg(
            (F.first("target") - F.sum(F.col("words") * (F.col("whole") + F.col("extra")))).alias("left"))
        # salted by rank, so that a large source is not one task
        salted = gap.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        offered = rows.withColumn("salt", F.pmod("bucket", F.lit(SALT))).join(salted, ["sid", "salt"]).drop("salt").withColumn(
            "open", (F.col("extra") == 0) & F.col("q").isNotNull() & (F.col("words") > 0) & (F.col("words") <= F.col("left")))
        chosen = _fit(offered.filter("open"), F.col("left")).filter("take").select("row_key", "sid", F.lit(1).cast("long").alias("_one"))
        rows = rows.join(chosen, ["row_key", "sid"], "left").withColumn(
            "extra", F.col("extra") + F.coalesce("_one", F.lit(0))).drop("_one").checkpoint()
    return rows.select("row_key", "size", "source_size", "target",
                       F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long").alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, copies and taken."""
    chosen = choose_copies(docs, id_col, text_col, source_col, **kw)
    keys = docs.select(F.col(id_col), row_key(id_col, text_col, source_col).alias("row_key"))
    return keys.join(chosen, "row_key").select(
        id_col, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    chosen = choose_copies(docs, id_col, text_col, source_col, **kw).filter(F.col("copies") > 0).select("row_key", "copies")
    whole = docs.select(row_key(id_col, text_col, source_col).alias("row_key"), F.struct("*").alias("whole"))
    taken = whole.join(chosen, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col("whole")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER a, 0) AS cap_before, sum(weight) OVER b AS weight_left,
    (SELECT sum(size) FROM d) AS total
  FROM w
  WINDOW a AS (ORDER BY 3.0 * source_size / weight, source_size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (ORDER BY 3.0 * source_size / weight, source_size, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), share AS (
  SELECT max((total - cap_before)::DOUBLE / weight_left) AS share FROM o
), t AS (
  SELECT source, source_size, least((SELECT share FROM share) * weight, 3.0::DOUBLE * source_size)::DOUBLE AS target FROM w
), i AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    (('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r0 AS (
  SELECT *, floor(rate)::BIGINT AS whole, 0::BIGINT AS extra,
    CASE WHEN rate > floor(rate) THEN (u / (1 - u)) / ((rate - floor(rate)) / (1 - (rate - floor(rate)))) END AS q FROM i
), @ROUNDS@
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN whole + extra ELSE 0 END AS copies,
  size * CASE WHEN size > 0 THEN whole + extra ELSE 0 END AS taken
FROM r@LAST@
"""

_ROUND = """g@N@ AS (
  SELECT *, target - sum(size * (whole + extra)) OVER (PARTITION BY source) AS gap FROM r@P@
), h@N@ AS (
  SELECT *, extra = 0 AND q IS NOT NULL AND size > 0 AND size <= gap AS offered FROM g@N@
), r@N@ AS (
  SELECT * EXCLUDE (gap, offered, extra), extra + CASE WHEN offered AND sum(CASE WHEN offered THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= gap THEN 1 ELSE 0 END AS extra
  FROM h@N@
)"""


def oracle_sql(rounds: int = ROUNDS) -> str:
    steps = ", ".join(_ROUND.replace("@N@", str(n)).replace("@P@", str(n - 1)) for n in range(1, rounds + 1))
    return SQL.replace("@ROUNDS@", steps).replace("@LAST@", str(rounds))
