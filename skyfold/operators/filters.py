"""Row filters. Simple comparisons stay simple, so that they reach the Parquet scan."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.constants import SENTINEL, TEFF_MAX, TEFF_MIN
from skyfold.functions.missing import finite, is_sentinel, present

log = logging.getLogger(__name__)


def range_filters(df: DataFrame, ranges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Inclusive ranges, all of which must hold; columns the table lacks are skipped."""
    for name, (lo, hi) in ranges.items():
        if name not in df.columns:
            log.warning("range filter on absent column %s skipped", name)
            continue
        df = df.where(F.col(name).between(lo, hi))
    return df


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def valid_target(df: DataFrame, target: str, sentinel: float = SENTINEL) -> DataFrame:
    c = F.col(target)
    return df.where(~is_sentinel(c, sentinel) & (c > 0) & finite(c))


def finite_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(finite(F.col(target)))


_SUFFIXES = {
    "_is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "_eq": lambda c, v: c == F.lit(v),
    "_ne": lambda c, v: c != F.lit(v),
    "_gt": lambda c, v: c > F.lit(v),
    "_lt": lambda c, v: c < F.lit(v),
}


def predicate(rules: Mapping[str, object], columns: Sequence[str] = ()) -> Column:
    """Conjunction of ``{column[suffix]: value}`` rules.

    Suffixes are ``_is_null``, ``_eq``, ``_ne``, ``_gt`` and ``_lt``; a bare name means equality, and a
    two-element list an inclusive range. A name that is itself a column is never split.
    """
    terms = []
    for name, value in rules.items():
        suffix = None if name in columns else next((s for s in _SUFFIXES if name.endswith(s)), None)
        if suffix:
            terms.append(_SUFFIXES[suffix](F.col(name.removesuffix(suffix)), value))
        elif isinstance(value, (list, tuple)):
            terms.append(F.col(name).between(*value))
        else:
            terms.append(F.col(name) == F.lit(value))
    return reduce(and_, terms, F.lit(True)) if terms else F.lit(True)


def apply_rules(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    return df.where(predicate(rules, df.columns)) if rules else df


def require_features(df: DataFrame, features: Sequence[str], sentinel: float = SENTINEL) -> DataFrame:
    """Rows in which every model feature the table stores is present and, for floating-point columns, finite."""
    stored = [f for f in features if f in df.columns]
    tests = [present(F.col(f), sentinel) for f in stored]
    tests += [finite(F.col(f)) for f in stored if df.schema[f].dataType.typeName() in ("double", "float")]
    return df.where(reduce(and_, tests)) if tests else df


def any_color(df: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    """At least one of the adjacent magnitude pairs is present."""
    pairs = (("g", "r"), ("r", "i"), ("i", "z"))
    has = [present(F.col(f"{a}PSFMag"), sentinel) & present(F.col(f"{b}PSFMag"), sentinel) for a, b in pairs]
    return df.where(reduce(or_, has))


def plausible(df: DataFrame, columns: Sequence[str], lo: float = TEFF_MIN, hi: float = TEFF_MAX,
              sentinel: float = SENTINEL) -> DataFrame:
    """Every column present and within ``[lo, hi]``."""
    return df.where(reduce(and_, (present(F.col(c), sentinel) & F.col(c).between(lo, hi) for c in columns)))


def color_window(df: DataFrame, color: str, target: str, lo: float = -0.5, hi: float = 3.0) -> DataFrame:
    """Colour and target strictly inside their limits; the target's are its own extremes."""
    t = df.agg(F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    c, y = F.col(color), F.col(target)
    return df.where((c > lo) & (c < hi) & (y > F.lit(t["lo"])) & (y < F.lit(t["hi"])))


def positive_uncertainty(df: DataFrame, column: str) -> DataFrame:
    return df.where((F.col(column) > 0) & finite(F.col(column)))


def pair_window(df: DataFrame, x: str, y: str, lo: float, hi: float) -> DataFrame:
    return df.where(reduce(and_, (finite(F.col(c)) & F.col(c).between(lo, hi) for c in (x, y))))
