"""Catalog merge: correct the original temperatures, join all predictions, keep the least uncertain one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.columns import correct_poly_hard, merged_column_order
from skyfold.operators.ensemble import best_of
from skyfold.operators.joins import merge_predictions


def merge_catalog(catalog: DataFrame, predictions: Mapping[str, DataFrame | None],
                  coefficients: Sequence[float] | None = None, restricted: Sequence[str] = ("teff_propagated",),
                  key: str = "source_id") -> DataFrame:
    """The merged catalog. Every join is on ``key``, so tables stored bucketed by it are not shuffled again."""
    original = F.col("teff_gaia")
    corrected = original if coefficients is None else correct_poly_hard(original, coefficients)
    base = catalog.select(key, original.alias("teff_gaia_original"), corrected.alias("teff_gaia_corrected"))
    models = [m for m, t in predictions.items() if t is not None]
    merged = merge_predictions(base, predictions, key, restricted)
    return best_of(merged, models).select(*merged_column_order(models, key))
