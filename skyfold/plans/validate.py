"""Validation report: every table from one stored set of test predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyfold.functions.columns import normalise_prediction_columns
from skyfold.operators import histograms, metrics


def validation_report(test_predictions: DataFrame, kind: str = "teff") -> dict[str, DataFrame]:
    """Global and per-bin metrics, error curve, and score histograms where scores are stored.

    Give the table as written by training: scores are then columns of the scan and not computed again per report.
    """
    rows = normalise_prediction_columns(test_predictions)
    out = {"metrics": metrics.regression_metrics(rows), "bins": metrics.metrics_by_target_kind(rows, kind),
           "rmse_curve": metrics.rmse_curve(rows)}
    if "pit" in rows.columns:
        out["pit"] = histograms.pit_histogram(rows)
    if "crps" in rows.columns:
        out["crps"] = histograms.crps_histogram(rows)
    if "gmm_weight_0" in rows.columns:
        out["density_map"] = histograms.mixture_density_map(rows)
    return out
