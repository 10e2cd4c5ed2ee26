"""Operator 11, URL filters: a cascade of Bloom filters over the keys of a
corpus, in DataFrame operations only.

A key is a host suffix followed by a prefix of the path (``example.org/es/``).
A rule lists one key; it fits an url that has its key.  Of an url only the keys
are made whose shape (number of labels, length of the path prefix) some rule
has, so that their number does not depend on the length of the path.  All these
keys of all urls are the universe.

Level 1 of a cascade is a Bloom filter of the listed keys, level 2 one of the
keys of the universe that level 1 holds by mistake, level 3 one of the listed
keys that level 2 holds by mistake, and so on until a level makes no mistake.
A key is listed if the first level that lacks it is an even one, or if none
lacks it and the last one is odd.  For keys of the universe this is exact, so
the urls are judged row by row without a join.  Every level has hashes of its
own.  Level 1 lets sqrt(1/2) * listed / universe of the other keys through, the
others half of them, so the levels shrink geometrically and all together take
about 1.44 * log2(universe / listed) + 4 bits a listed key.

There is one cascade of the blocked and one of the allowed keys.  The longest
rule wins (ties: more labels); a key that is both allowed and blocked is
blocked.  An url with a listed key gets its rule's verdict, one without any gets
``allow``: what no list holds passes.

Filters reach the tasks as scalar subqueries of at most ``part_bits`` bits in
level 1.  Longer lists are dealt by hash into parts with a cascade each; the
parts are asked one after the other and the best rule so far is written down in
between, so memory holds one part at a time.  The plan grows with the number of
different shapes of the rules, the data in it does not.

Cases.  A null url, or one without ``://``, has an empty host and path and no
rule.  Rules with a null or empty host, or with a path that is neither empty
nor begins with a slash, fit nothing; a null path is empty; other actions than
allow and block are ignored; repeated rules count once.  Repeated rows and null
ids are judged row by row.  Other columns are not read.  Empty tables of pages
or rules work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART_BITS = 1 << 27
MOST_PROBES = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small table of rules given as (host, path, action)."""
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, labels, chars, action) of the rules that can fit an url, each key
    once; block goes before allow."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    fine = rules.select(host.alias("host"), path.alias("path"), "action").filter(
        (F.length("host") > 0) & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("action").isin("allow", "block"))
    return fine.groupBy(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"),
                        F.length("path").alias("chars")).agg(F.max("action").alias("action"))


@dataclass
class Level:
    """A Bloom filter; ``words`` is a table of one row with its 64-bit words."""

    number: int
    bits: int
    probes: int
    words: DataFrame

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number), F.lit(i), key), F.lit(self.bits).cast("long")) for i in range(self.probes)]

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        out = F.lit(True)
        for p in self.places(key):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            out = out & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def _level(keys: DataFrame, count: int, number: int, share: float) -> Level:
    """A filter of ``keys`` that holds ``share`` of the others by mistake."""
    probes = min(MOST_PROBES, max(1, round(-math.log2(share))))
    bits = max(64, math.ceil(-probes * count / math.log(1 - share ** (1 / probes))))
    level = Level(number, bits, probes, keys)
    one = F.lit(1).cast("long")
    place = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    bit = F.call_function("shiftleft", one, F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    unset = keys.sparkSession.range(math.ceil(bits / 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = place.select(F.shiftright("p", 6).alias("word"), bit.alias("bit")).unionByName(unset).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bit"))).alias("w")).select(F.col("w.bit").alias("words"))
    level.words = row.checkpoint()
    return level


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is one of those that the levels encode."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def build_cascade(universe: DataFrame, keys: DataFrame, n_universe: int) -> list[Level]:
    """The levels for the distinct ``keys`` among all keys of ``universe``, two
    tables with a column ``key``.  Copies in the universe do no harm."""
    n = keys.count()
    if not n:
        return []
    share = min(0.5, math.sqrt(0.5) * n / max(1, n_universe))
    levels = [_level(keys, n, 1, share)]
    wrong = universe.filter(levels[0].holds(F.col("key"))).distinct().join(keys, "key", "left_anti").checkpoint()
    encoded = keys
    while n := wrong.count():
        levels.append(_level(wrong, n, len(levels) + 1, 0.5))
        encoded, wrong = wrong, encoded.filter(levels[-1].holds(F.col("key"))).checkpoint()
    return levels


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The key of each shape, null where the url is shorter."""
    labels = F.split("host", r"\.")
    each = []
    for n, chars in shapes:
        suffix = F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n))
        fits = (F.size(labels) >= n) & (F.length("path") >= chars)
        each.append(F.when(fits, F.concat(suffix, F.substring("path", 1, chars))))
    return F.array(*each) if each else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", part_bits: int = PART_BITS) -> DataFrame:
    """Per row of ``pages``: its id, ``host``, ``path``, ``rule`` (the key of the
    longest rule that fits, else null) and ``verdict``.  ``rules`` has the
    columns host, path and action (allow or block)."""
    ensure_checkpoint_dir(pages.sparkSession)
    rules = rule_keys(rules).checkpoint()
    seen = rules.agg(F.collect_set(F.struct("labels", "chars")).alias("shapes"), F.count(F.lit(1)).alias("n")).first()
    shapes = sorted((s.labels, s.chars) for s in seen["shapes"])
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    held = urls.withColumn("keys", _keys(shapes)).withColumn("best", F.lit(None).cast("struct<chars:int,labels:int,key:string,verdict:string>"))
    universe = held.select(F.explode("keys").alias("key")).filter("key is not null")
    n_universe = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    parts = math.ceil(seen["n"] * (1.44 * math.log2(max(2, n_universe) / max(1, seen["n"]) + 1) + 4) / part_bits)
    of_part = lambda df, i: df.filter(F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(parts)) == i) if parts > 1 else df
    for i in range(parts):
        found = []
        for action in ("block", "allow"):
            mine = of_part(rules.filter(F.col("action") == action), i).select("key")
            levels = build_cascade(of_part(universe, i), mine, n_universe // parts)
            for j, (labels, _) in enumerate(shapes if levels else []):
                key = F.get("keys", F.lit(j))
                asked = key.isNotNull() if parts == 1 else key.isNotNull() & (F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)) == i)
                hit = F.struct(F.length(key).alias("chars"), F.lit(labels).alias("labels"), key.alias("key"), F.lit(action).alias("verdict"))
                found.append(F.when(asked & listed(levels, key), hit))
        if found:
            held = held.withColumn("best", F.array_max(F.array("best", *found)))
        if parts > 1:
            held = held.checkpoint()
    return held.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"),
                       F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


# Fixed rules of the registered query (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL = """
WITH rules(host, path, action) AS (VALUES %s),
p AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '%s', '%s') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), best AS (
  SELECT u.r, arg_max(struct_pack(rule := k.host || k.path, verdict := k.action), length(k.host || k.path)) AS b
  FROM u JOIN rules k ON (u.host = k.host OR ends_with(u.host, '.' || k.host)) AND starts_with(u.path, k.path)
  GROUP BY u.r
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (r)
""" % (", ".join(str(x) for x in RULES), UPPER, LOWER)
