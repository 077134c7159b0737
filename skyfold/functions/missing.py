"""Missing-data rules: the storage sentinel outside, NULL inside, never NaN."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.constants import SENTINEL, SENTINEL_TOL


def numeric_columns(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    wanted = set(df.columns if names is None else names)
    return [f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, T.NumericType)]


def _fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_sentinel(c: Column, sentinel: float = SENTINEL) -> Column:
    return F.abs(c - F.lit(sentinel)) < F.lit(SENTINEL_TOL)


def present(c: Column, sentinel: float = SENTINEL) -> Column:
    """Neither NULL, the sentinel nor NaN (exact comparisons first, so that Parquet can skip row groups)."""
    return c.isNotNull() & (c != F.lit(sentinel)) & ~F.isnan(c)


def finite(c: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def has_original(c: Column, sentinel: float = SENTINEL) -> Column:
    """A usable original value: not NULL, outside the sentinel tolerance and positive."""
    return F.coalesce(~is_sentinel(c, sentinel) & (c > 0) & ~F.isnan(c), F.lit(False))


def nullify_sentinel(df: DataFrame, columns: Iterable[str] | None = None, sentinel: float = SENTINEL) -> DataFrame:
    """Sentinel and NaN become NULL in the numeric columns."""
    changed = {}
    for name in numeric_columns(df, columns):
        c = F.col(name)
        bad = is_sentinel(c, sentinel)
        if _fractional(df, name):
            bad = bad | F.isnan(c)
        changed[name] = F.when(~bad, c)
    return df.withColumns(changed) if changed else df


def fill_sentinel(df: DataFrame, columns: Iterable[str], sentinel: float = SENTINEL) -> DataFrame:
    """NULL becomes the sentinel in the given numeric columns; their types are kept."""
    changed = {
        name: F.coalesce(F.col(name), F.lit(sentinel).cast(df.schema[name].dataType))
        for name in numeric_columns(df, columns)
    }
    return df.withColumns(changed) if changed else df
