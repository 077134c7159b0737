"""Data preparation: merge repeated detections, keep usable photometry, add colours and temperatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skyfold.constants import BANDS, DETECTION_KEY
from skyfold.functions.columns import with_color_temperatures, with_survey_colors
from skyfold.operators.detections import one_per_source
from skyfold.operators.filters import any_color


def prepare_photometry(detections: DataFrame, bands: Sequence[str] = BANDS, key: str = DETECTION_KEY,
                       temperatures: bool = True) -> DataFrame:
    """Clean photometry with one row per source: one scan, one shuffle."""
    columns = [key, *[f"{b}PSFMag{s}" for b in bands for s in ("", "Err")]]
    out = with_survey_colors(any_color(one_per_source(detections.select(*columns), bands, key)))
    return with_color_temperatures(out) if temperatures else out
