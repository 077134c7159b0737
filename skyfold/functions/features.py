"""Engineered features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 3,
                        interaction_only: bool = False) -> DataFrame:
    """Every monomial of degree 2..``degree``, named like ``bp_rp^2_g_bp``."""
    pick = combinations if interaction_only else combinations_with_replacement
    made = {}
    for d in range(2, degree + 1):
        for factors in pick(columns, d):
            powers = Counter(factors)
            name = "_".join(c if k == 1 else f"{c}^{k}" for c, k in powers.items())
            made[name] = reduce(mul, (F.col(c) for c in factors))
    return df.withColumns(made) if made else df


def interaction_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}
    return df.withColumns(pairs) if pairs else df


def log_features(df: DataFrame, columns: Sequence[str], offset: float = 0.5) -> DataFrame:
    """``ln(x + offset)``: minus infinity at zero, 0 where the argument is negative or missing."""
    made = {}
    for c in columns:
        arg = F.col(c) + F.lit(offset)
        made[f"log_{c}"] = (F.when(arg.isNull() | F.isnan(arg), F.lit(0.0)).when(arg > 0, F.log(arg))
                            .when(arg == 0, F.lit(float("-inf"))).otherwise(F.lit(0.0)))
    return df.withColumns(made)


def regime_features(df: DataFrame, columns: Sequence[str], hot: float = 0.3, cool: float = 0.8) -> DataFrame:
    """The value where it lies in the hot, cool or middle colour regime, else 0; NULL stays NULL."""
    made = {}
    for c in columns:
        x = F.col(c)
        for prefix, cond in (("hot", x < hot), ("cool", x > cool), ("mid", x.between(hot, cool))):
            made[f"{prefix}_{c}"] = F.when(x.isNull(), F.lit(None)).when(cond | F.isnan(x), x).otherwise(F.lit(0.0))
    return df.withColumns(made)


def magnitude_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    suffix = {2: "squared", 3: "cubed"}
    made = {f"{c}_{suffix.get(d, d)}": F.pow(F.col(c), F.lit(float(d))) for c in columns for d in range(2, degree + 1)}
    return df.withColumns(made) if made else df


def engineer_all_features(df: DataFrame, colors: Sequence[str], mags: Sequence[str] = (), *,
                          include_polynomials: bool = True, include_interactions: bool = True,
                          include_log: bool = True, include_temp_dependent: bool = True,
                          include_mag_features: bool = True) -> DataFrame:
    """All feature families; every ``include_*`` switch takes effect."""
    steps = [
        (include_polynomials, lambda d: polynomial_features(d, colors, 3)),
        (include_interactions, lambda d: interaction_features(d, colors)),
        (include_log, lambda d: log_features(d, colors)),
        (include_temp_dependent, lambda d: regime_features(d, colors)),
        (include_mag_features and bool(mags), lambda d: magnitude_features(d, mags)),
    ]
    for wanted, step in steps:
        if wanted:
            df = df.transform(step)
    return df
