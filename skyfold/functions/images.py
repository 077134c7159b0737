"""Multi-band cutouts held as ``array<array<double>>``: one flattened square image per band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_differences(bands: Column, n_bands: int = 5) -> Column:
    """The bands followed by the difference of every ordered pair of them."""
    pairs = [F.zip_with(bands[i], bands[j], lambda a, b: a - b)
             for i in range(n_bands) for j in range(i + 1, n_bands)]
    return F.concat(bands, F.array(*pairs))


def usable(bands: Column) -> Column:
    """No NaN anywhere and not entirely zero."""
    has_nan = F.exists(bands, lambda img: F.exists(img, F.isnan))
    all_zero = F.forall(bands, lambda img: F.forall(img, lambda x: x == 0.0))
    return ~has_nan & ~all_zero


def clean_images(df: DataFrame, bands: str = "bands") -> DataFrame:
    return df.where(usable(F.col(bands)))


def crop(bands: Column, edge: int, lo: int, hi: int) -> Column:
    """The pixel window ``[lo, hi)`` on both axes of images with side ``edge``."""
    rows = F.sequence(F.lit(lo), F.lit(hi - 1))
    return F.transform(bands, lambda img: F.flatten(
        F.transform(rows, lambda r: F.slice(img, r * F.lit(edge) + F.lit(lo + 1), F.lit(hi - lo)))))


def rotated(bands: Column, edge: int, turns: int) -> Column:
    """Every band turned by ``turns`` quarter turns, counter-clockwise."""
    n = edge
    source = {
        0: lambda r, c: r * n + c,
        1: lambda r, c: c * n + (n - 1 - r),
        2: lambda r, c: (n - 1 - r) * n + (n - 1 - c),
        3: lambda r, c: (n - 1 - c) * n + r,
    }[turns % 4]
    order = F.array(*[F.lit(source(r, c)) for r in range(n) for c in range(n)])
    return F.transform(bands, lambda img: F.transform(order, lambda i: F.get(img, i)))


def augment_rotations(df: DataFrame, edge: int, bands: str = "bands") -> DataFrame:
    """Four rows per cutout, one per quarter turn; the other columns are repeated."""
    turned = F.array(*[F.struct(F.lit(k).alias("turn"), rotated(F.col(bands), edge, k).alias(bands))
                       for k in range(4)])
    rest = [c for c in df.columns if c != bands]
    return df.select(*rest, F.explode(turned).alias("_r")).select(*rest, "_r.turn", f"_r.{bands}")
