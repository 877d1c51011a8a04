"""Joins of the comment pipeline (J1-J6) and the size-checked lookup join.

The original scripts join by list position and dictionary lookups; here every join
is an equi-join on an explicit key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its rows times its row width stay below this.
BROADCAST_BYTES = 64 << 20
# Share of the rows above which a key of a shuffle join is broadcast instead.
HEAVY_SHARE = 1e-3
# Assumed widths in bytes (values plus row overhead) of columns by type.
_FIXED_WIDTH = {"boolean": 8, "int": 8, "bigint": 8, "double": 8, "float": 8}
_STRING_WIDTH = 64
_ROW_OVERHEAD = 48


def row_width(df: DataFrame, dim: int | None = None) -> int | None:
    """Bytes of a row of ``df``; array columns hold ``dim`` eight-byte items.
    None where a column's width is not known."""
    total = _ROW_OVERHEAD
    for _, t in df.dtypes:
        if t in _FIXED_WIDTH:
            total += _FIXED_WIDTH[t]
        elif t == "string":
            total += _STRING_WIDTH
        elif (t.startswith("array<") or t.startswith("vector")) and dim is not None:
            total += 16 + 8 * dim
        else:
            return None
    return total


def fits(small: DataFrame, bound_rows: int | None, dim: int | None = None) -> bool:
    """Whether ``lookup_join`` broadcasts ``small`` behind this bound."""
    width = row_width(small, dim)
    return bound_rows is not None and width is not None and bound_rows * width <= BROADCAST_BYTES


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str = "inner",
    bound_rows: int | None = None,
    dim: int | None = None,
    heavy_share: float | None = None,
) -> DataFrame:
    """Join ``big`` to a lookup table, broadcasting it only behind a size bound.

    ``bound_rows`` is a proven upper bound on the rows of ``small`` (e.g. the
    number of embedding rows, the length of a word list); times the row width
    (``dim``: items of its array columns) it must stay below BROADCAST_BYTES.
    Without a bound, or above the limit, it is a shuffle join: AQE may still
    switch to a broadcast from runtime sizes and splits skewed keys.  With
    ``heavy_share`` (single key, inner or left join) keys that hold more than
    that share of ``big`` are joined apart, see ``heavy_join``.
    """
    if fits(small, bound_rows, dim):
        return big.join(F.broadcast(small), on, how)
    if heavy_share is not None and isinstance(on, str) and how in ("inner", "left"):
        return heavy_join(big, small, on, how, heavy_share)
    return big.join(small, on, how)


def heavy_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", share: float = HEAVY_SHARE) -> DataFrame:
    """J5 for a skewed vocabulary: a join whose frequent keys are broadcast.

    ``freqItems`` names every key with more than ``share`` of the rows (and at
    most 1 / share keys, some of them less frequent, which does no harm).  Their
    rows of ``big`` stay where they are and meet their rows of ``small``, a
    broadcast of at most 1 / share keys; the other rows are shuffled, and none
    of their keys holds more than ``share`` of them.
    """
    heavy = [k for k in big.select(on).freqItems([on], share).first()[0] or [] if k is not None]
    is_heavy = F.coalesce(F.col(on).isin(heavy), F.lit(False))
    rest = big.where(~is_heavy).join(small, on, how)
    if not heavy:
        return rest
    return big.where(is_heavy).join(F.broadcast(small.where(is_heavy)), on, how).unionByName(rest)


def attach_predictions(rows: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Attach predictions (id, pred) to labelled rows by key."""
    return rows.join(preds, key, "inner")


def residual_rows(rows: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in none of ``taken`` (left anti join)."""
    return rows.join(taken.select(key), key, "left_anti")


def lookup_rows(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``keys`` (left semi join)."""
    return rows.join(keys.select(key), key, "left_semi")
