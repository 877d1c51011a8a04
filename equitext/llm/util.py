"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equitext.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back:
    lineage ends there, and no executor's local disk holds the only copy."""
    return materialize(df, f"llm-{name}")


def id_type(df: DataFrame, col: str = "doc_id") -> str:
    return dict(df.dtypes)[col]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod`` (NULL id: NULL)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` is the fast path of pure ASCII text;
    other text goes through ``translate``, which leaves all else alone."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )
