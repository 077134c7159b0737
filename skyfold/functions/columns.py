"""Derived columns."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.constants import (COLOR_CUT, COLOR_TEMPERATURE, CORRECTION_THRESHOLD, CORRECTION_WIDTH, LN2, LN10,
                               SENTINEL)
from skyfold.functions.missing import is_sentinel, present

log = logging.getLogger(__name__)


# ---- selection and naming -------------------------------------------------------------------------------------

def feature_names(df: DataFrame, target: str, features: Sequence[str] | None = None,
                  exclude: Sequence[str] = ()) -> list[str]:
    """The listed features that exist, or every column but the target and the excluded ones."""
    if features:
        missing = [f for f in features if f not in df.columns]
        if missing:
            log.warning("features not in table, skipped: %s", missing)
        return [f for f in features if f in df.columns]
    return [c for c in df.columns if c != target and c not in set(exclude)]


def select_features(df: DataFrame, target: str, features: Sequence[str] | None = None,
                    exclude: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *feature_names(df, target, features, tuple(exclude) + tuple(keep)), target)


def normalise_prediction_columns(df: DataFrame) -> DataFrame:
    """Either pair of truth/prediction names becomes ``true_value`` and ``predicted_value``."""
    for truth, pred in (("y_true", "y_pred"), ("teff_true", "teff_pred")):
        if truth in df.columns and pred in df.columns:
            return df.withColumnsRenamed({truth: "true_value", pred: "predicted_value"})
    if {"true_value", "predicted_value"} <= set(df.columns):
        return df
    raise ValueError("table holds no truth/prediction column pair")


def merged_column_order(models: Sequence[str], key: str = "source_id") -> list[str]:
    """Column order of the merged catalog."""
    pairs = [name for m in models for name in (m, f"{m}_uncertainty")]
    return [key, "teff_gaia_original", "teff_gaia_corrected", *pairs, "teff_best", "teff_best_uncertainty"]


# ---- photometry -----------------------------------------------------------------------------------------------

def guarded_color(a: str, b: str, sentinel: float = SENTINEL) -> Column:
    """``a - b`` where both magnitudes are present, else the sentinel."""
    both = present(F.col(a), sentinel) & present(F.col(b), sentinel)
    return F.when(both, F.col(a) - F.col(b)).otherwise(F.lit(sentinel))


def with_survey_colors(df: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    return df.withColumns({f"{a}_{b}_color": guarded_color(f"{a}PSFMag", f"{b}PSFMag", sentinel)
                           for a, b in (("g", "r"), ("r", "i"), ("i", "z"))})


def with_gaia_colors(df: DataFrame) -> DataFrame:
    """``g_bp`` and ``g_rp`` where the table lacks them but has the magnitudes."""
    made = {f"g_{b}": F.col("g") - F.col(b) for b in ("bp", "rp")
            if f"g_{b}" not in df.columns and {"g", b} <= set(df.columns)}
    return df.withColumns(made) if made else df


def with_color_temperatures(df: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    """One temperature per valid colour and their mean; the sentinel where no colour is valid."""
    made = {}
    for color, (name, a, b) in COLOR_TEMPERATURE.items():
        c = F.col(color)
        valid = present(c, sentinel) & (c > F.lit(COLOR_CUT))
        made[name] = F.when(valid, F.try_divide(F.lit(a), c + F.lit(b)) * F.lit(1e4))
    df = df.withColumns(made)
    temps = [F.col(t[0]) for t in COLOR_TEMPERATURE.values()]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in temps[1:]), F.coalesce(temps[0], F.lit(0.0)))
    count = sum((t.isNotNull().cast("int") for t in temps[1:]), temps[0].isNotNull().cast("int"))
    mean = F.coalesce(F.try_divide(total, count), F.lit(sentinel))
    return df.withColumn("Te_avg", mean).withColumns({n: F.coalesce(F.col(n), F.lit(sentinel)) for n in made})


def sky_coordinates(df: DataFrame, lon: str, lat: str, value: str | None = None) -> DataFrame:
    """Map coordinates in radians with longitude wrapped to (-180, 180]; rows without a position are dropped."""
    out = df.na.drop(subset=[lon, lat])
    wrapped = F.when(F.col(lon) > 180, F.col(lon) - 360).otherwise(F.col(lon))
    kept = [F.col(value)] if value else []
    return out.select(F.radians(wrapped).alias("lon_rad"), F.radians(F.col(lat)).alias("lat_rad"), *kept)


# ---- user expressions -----------------------------------------------------------------------------------------

def add_expressions(df: DataFrame, expressions: Mapping[str, str], engineered: bool = False) -> DataFrame:
    """Columns from SQL expressions; one that does not resolve is warned about and skipped.

    They apply only where feature engineering is off, as ``engineered`` tells.
    """
    if engineered:
        return df
    for name, text in expressions.items():
        try:
            df = df.withColumn(name, F.expr(text))
            df.schema  # resolve now, so that a bad expression is skipped and not raised later
        except (AnalysisException, ParseException) as err:
            log.warning("expression %s skipped: %s", name, err)
    return df


# ---- target -----------------------------------------------------------------------------------------------------

def polynomial(c: Column, coefficients: Sequence[float]) -> Column:
    """Horner form of a polynomial given by ascending powers."""
    out = F.lit(float(coefficients[-1]))
    for k in reversed(coefficients[:-1]):
        out = out * c + F.lit(float(k))
    return out


def _correctable(c: Column, threshold: float, sentinel: float) -> Column:
    return ~is_sentinel(c, sentinel) & (c > F.lit(threshold)) & ~F.isnan(c)


def correct_poly_smooth(c: Column, coefficients: Sequence[float], threshold: float = CORRECTION_THRESHOLD,
                        width: float = CORRECTION_WIDTH, sentinel: float = SENTINEL) -> Column:
    """Polynomial correction above ``threshold``, blended in over ``width`` by a cubic step."""
    t = F.least(F.greatest((c - F.lit(threshold)) / F.lit(width), F.lit(0.0)), F.lit(1.0))
    blend = t * t * (F.lit(3.0) - F.lit(2.0) * t)
    return F.when(_correctable(c, threshold, sentinel), c + (polynomial(c, coefficients) - c) * blend).otherwise(c)


def correct_poly_hard(c: Column, coefficients: Sequence[float], threshold: float = CORRECTION_THRESHOLD,
                      sentinel: float = SENTINEL) -> Column:
    """Polynomial correction above ``threshold`` without blending, as the merged catalog uses it."""
    return F.when(_correctable(c, threshold, sentinel), polynomial(c, coefficients)).otherwise(c)


def transform_target(c: Column, kind: str = "none") -> Column:
    return {"none": lambda: c, "log10": lambda: F.log10(c), "log2": lambda: F.log2(c), "ln": lambda: F.log(c)}[kind]()


def inverse_target(c: Column, kind: str = "none") -> Column:
    return {"none": lambda: c, "log10": lambda: F.pow(F.lit(10.0), c), "log2": lambda: F.pow(F.lit(2.0), c),
            "ln": lambda: F.exp(c)}[kind]()


def inverse_target_array(c: Column, kind: str = "none") -> Column:
    return c if kind == "none" else F.transform(c, lambda x: inverse_target(x, kind))


def linear_uncertainty(linear_prediction: Column, sigma: Column, kind: str = "none") -> Column:
    """Spread of a log-space prediction carried to linear units."""
    factor = {"none": None, "log10": LN10, "log2": LN2, "ln": 1.0}[kind]
    return sigma if factor is None else linear_prediction * sigma * F.lit(factor)


def log_temperature_to_kelvin(c: Column) -> Column:
    """Values from 3 to 5 are log10 temperatures and are converted."""
    return F.when(c.between(3.0, 5.0), F.pow(F.lit(10.0), c)).otherwise(c)


def decode_log_temperature(c: Column, floor: float = 100.0) -> Column:
    """``10**c``; results below ``floor`` are a missing-value code."""
    kelvin = F.pow(F.lit(10.0), c)
    return F.when(kelvin >= F.lit(floor), kelvin)


# ---- errors and small derived values ----------------------------------------------------------------------------

def error_columns(df: DataFrame, truth: str = "true_value", pred: str = "predicted_value") -> DataFrame:
    res = F.col(pred) - F.col(truth)
    rel = F.try_divide(F.abs(res), F.col(truth))
    return df.withColumns({"residual": res, "abs_error": F.abs(res), "rel_error": rel, "pct_error": rel * F.lit(100.0)})


def with_period(df: DataFrame, frequency: str = "frequency") -> DataFrame:
    period = F.try_divide(F.lit(1.0), F.col(frequency))
    return df.withColumns({"period_days": period, "log_period": F.when(period > 0, F.log10(period))})


def pair_columns(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ratio, mean and difference of two values."""
    return df.withColumns({"ratio": F.try_divide(F.col(x), F.col(y)), "mean_xy": (F.col(x) + F.col(y)) / F.lit(2.0),
                           "diff_xy": F.col(x) - F.col(y)})
