"""Registry of named queries (one per operator of the inventory) and their
DuckDB oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame over the driver
tables.  Doubles are rounded to 6 places on both sides, since summation
order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def finish(df: DataFrame) -> DataFrame:
    """Round every double column to DIGITS places (names unchanged); adding
    0.0 turns a rounded -0.0 into 0.0."""
    cols = [
        (F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that they register."""
    from equitext.plans import (  # noqa: F401
        q_bow,
        q_chain,
        q_debias,
        q_model,
        q_probes,
        q_profile,
        q_split,
        q_text,
        q_tries,
        q_vectors,
    )
