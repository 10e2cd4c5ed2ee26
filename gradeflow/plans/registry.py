"""Query registry: every operator of SURVEY §2 as ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, the DuckDB oracle over the same tables.

Keys carry the survey id (``F1_num_words``) so the inventory can be checked
line by line.  Doubles are rounded to 6 places on both sides, counts are
bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the query modules (they register on import)."""
    from gradeflow.plans import (  # noqa: F401
        q_features,
        q_text,
        q_vocab,
        q_prep,
        q_splits,
        q_metrics,
        q_attention,
        q_models,
        q_io,
    )
