"""Repeated detections of one source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.constants import BANDS, DETECTION_KEY, SENTINEL
from skyfold.functions.missing import finite, is_sentinel


def duplicate_detections(df: DataFrame, key: str = DETECTION_KEY) -> DataFrame:
    """Rows whose id occurs more than once.

    Ids are counted with a partial aggregate and joined back; a window over the id would sort every detection
    and hold a whole id in one task.
    """
    repeated = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(repeated, key, "left_semi")


def one_per_source(df: DataFrame, bands: Sequence[str] = BANDS, key: str = DETECTION_KEY, sentinel: float = SENTINEL) -> DataFrame:
    """Magnitudes and errors with one row per id from one scan and one partial aggregate.

    Single detections keep their stored values bit for bit (the least of one value is the value); repeated ones are
    merged as in ``merge_detections``.
    """
    aggs, merged = _merged(bands, sentinel)
    names = [f"{b}PSFMag{s}" for b in bands for s in ("", "Err")]
    grouped = df.groupBy(key).agg(F.count("*").alias("_rows"), *aggs, *[F.min(n).alias(f"_own_{n}") for n in names])
    return grouped.select(key, *[F.when(F.col("_rows") == 1, F.col(f"_own_{n}")).otherwise(merged[n]).alias(n) for n in names])


def merge_detections(df: DataFrame, bands: Sequence[str] = BANDS, key: str = DETECTION_KEY,
                     sentinel: float = SENTINEL) -> DataFrame:
    """One row per id: inverse-variance mean and error per band over the detections that have the band.

    Without any usable error the plain mean is taken, without any detection the sentinel.
    """
    aggs, made = _merged(bands, sentinel)
    return df.groupBy(key).agg(*aggs).select(key, *[c.alias(n) for n, c in made.items()])


def _merged(bands: Sequence[str], sentinel: float) -> tuple[list, dict]:
    """Sums over the detections of an id, and the merged columns made from them."""
    aggs, made = [], {}
    for b in bands:
        mag, err = F.col(f"{b}PSFMag"), F.col(f"{b}PSFMagErr")
        seen = ~is_sentinel(mag, sentinel) & finite(mag)
        weighted = seen & ~is_sentinel(err, sentinel) & finite(err) & (err > 0)
        weight = F.lit(1.0) / (err * err)
        aggs += [F.sum(F.when(weighted, mag * weight)).alias(f"_{b}_mw"), F.sum(F.when(weighted, weight)).alias(f"_{b}_w"),
                 F.avg(F.when(seen, mag)).alias(f"_{b}_m")]
        mean = F.try_divide(F.col(f"_{b}_mw"), F.col(f"_{b}_w"))
        made[f"{b}PSFMag"] = F.coalesce(mean, F.col(f"_{b}_m"), F.lit(sentinel))
        made[f"{b}PSFMagErr"] = F.coalesce(F.lit(1.0) / F.sqrt(F.col(f"_{b}_w")), F.lit(sentinel))
    return aggs, made
