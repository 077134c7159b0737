"""Histograms, trends and density maps: the data behind every figure, as small tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.binning import half_open_bin, linear_bin
from skyfold.functions.missing import finite
from skyfold.functions.mixture import gmm_columns
from skyfold.operators.metrics import with_median
from skyfold.operators.ranks import exact_quantiles, quantile_values
from skyfold.operators.scalars import attach_row

# Rows whose densities are held at once, and cells of a counting grid per bandwidth.
MAP_ROWS = 4096
FINE = 8


def value_range(df: DataFrame, value: str) -> tuple[float, float]:
    row = df.where(finite(F.col(value))).agg(F.min(value), F.max(value)).first()
    return row[0], row[1]


def _all_bins(df: DataFrame, n_bins: int) -> DataFrame:
    return df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))


def histogram(df: DataFrame, value: str, n_bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts and density over equal-width bins; the last bin is closed on both sides, empty bins count 0."""
    if lo is None or hi is None:
        lo, hi = value_range(df, value)
    counts = (df.select(linear_bin(F.col(value).cast("double"), lo, hi, n_bins).alias("bin"))
              .where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")))
    width = (hi - lo) / n_bins
    full = _all_bins(df, n_bins).join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _with_density(full, width).withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width)).select(
        "bin", "bin_lo", (F.col("bin_lo") + F.lit(width)).alias("bin_hi"), "n", "density")


def _with_density(full: DataFrame, width: float) -> DataFrame:
    joined = attach_row(full, full.agg(F.sum("n").alias("_total")))
    return joined.withColumn("density", F.try_divide(F.col("n").cast("double"), F.col("_total") * F.lit(width))).drop(
        "_total")


def uncertainty_histogram(df: DataFrame, value: str, n_bins: int = 80) -> DataFrame:
    """Log-spaced bins where the values span more than three decades, else linear ones; with p50 and p90."""
    rows = df.where((F.col(value) > 0) & finite(F.col(value)))
    lo, hi = value_range(rows, value)
    c = F.col(value)
    if hi / max(lo, 1e-30) > 1e3:
        a, b = math.log10(max(lo, 1e-6)), math.log10(hi * 1.01)
        binned = linear_bin(F.log10(c), a, b, n_bins - 1)
        edge = F.pow(F.lit(10.0), F.lit(a) + F.col("bin") * F.lit((b - a) / (n_bins - 1)))
    else:
        binned = linear_bin(c, lo, hi, n_bins)
        edge = F.lit(lo) + F.col("bin") * F.lit((hi - lo) / n_bins)
    counts = rows.groupBy(binned.alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    return with_median(counts.withColumn("bin_lo", edge), rows, value, {"p50": 0.5, "p90": 0.9}).select(
        "bin", "bin_lo", "n", "p50", "p90")


def score_histogram(df: DataFrame, value: str, n_bins: int, lo: float | None = None,
                    hi: float | None = None) -> DataFrame:
    """Histogram of PIT or CRPS values with their mean, population deviation and exact median on every row."""
    bins = histogram(df, value, n_bins, lo, hi)
    c = F.col(value)
    moments = with_median(df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")), df, value)
    return attach_row(bins, moments)


def pit_histogram(df: DataFrame, pit: str = "pit", n_bins: int = 30) -> DataFrame:
    return score_histogram(df, pit, n_bins, 0.0, 1.0)


def crps_histogram(df: DataFrame, crps: str = "crps", n_bins: int = 60) -> DataFrame:
    return score_histogram(df, crps, n_bins)


def median_trend(df: DataFrame, x: str, y: str, n_bins: int = 10, min_rows: int = 3) -> DataFrame:
    """Median and 16/84 percent quantiles of ``y`` per equal-width bin of ``x``; the largest ``x`` falls out."""
    rows = df.where(finite(F.col(x)) & finite(F.col(y)))
    lo, hi = value_range(rows, x)
    binned = rows.withColumn("bin", half_open_bin(F.col(x), lo, hi, n_bins)).where("bin is not null")
    counts = binned.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    quantiles = exact_quantiles(binned, y, {"median": 0.5, "p16": 0.16, "p84": 0.84}, by=["bin"])
    center = F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit((hi - lo) / n_bins)
    return counts.join(quantiles, "bin").select("bin", center.alias("center"), "n", "median", "p16", "p84")


def density_grid(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float],
                 n_bins: int = 60, min_count: int = 1) -> DataFrame:
    """Counts on a square grid with their log10; cells below ``min_count`` are left out."""
    return (df.select(linear_bin(F.col(x).cast("double"), *x_range, n_bins).alias("ix"),
                      linear_bin(F.col(y).cast("double"), *y_range, n_bins).alias("iy"))
            .where("ix is not null and iy is not null").groupBy("ix", "iy").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count).withColumn("log_n", F.log10("n")))


def hexbin_index(x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float],
                 gridsize: int) -> tuple[Column, Column, Column]:
    """Hexagon of a point: two offset lattices, the nearer centre wins. Returns lattice, column and row."""
    ny = int(gridsize / math.sqrt(3))
    sx = (x - F.lit(x_range[0])) / F.lit((x_range[1] - x_range[0]) / gridsize)
    sy = (y - F.lit(y_range[0])) / F.lit((y_range[1] - y_range[0]) / ny)
    ix1, iy1 = F.floor(sx + F.lit(0.5)), F.floor(sy + F.lit(0.5))
    ix2, iy2 = F.floor(sx), F.floor(sy)
    d1 = (sx - ix1) * (sx - ix1) + F.lit(3.0) * (sy - iy1) * (sy - iy1)
    dx, dy = sx - ix2 - F.lit(0.5), sy - iy2 - F.lit(0.5)
    d2 = dx * dx + F.lit(3.0) * dy * dy
    first = d1 < d2
    return (F.when(first, 0).otherwise(1), F.when(first, ix1).otherwise(ix2), F.when(first, iy1).otherwise(iy2))


def hexbin(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float],
           gridsize: int = 60, min_count: int = 1) -> DataFrame:
    lattice, ix, iy = hexbin_index(F.col(x), F.col(y), x_range, y_range, gridsize)
    return (df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
            .groupBy(lattice.alias("lattice"), ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count).withColumn("log_n", F.log10("n")))


def mixture_density_map(df: DataFrame, truth: str = "true_value", n_grid: int = 200, prefix: str = "gmm",
                        limits: tuple[float, float] = (2500.0, 50000.0)) -> DataFrame:
    """Summed predictive densities on a grid of true value against estimate.

    The grid spans the 0.5 and 99.5 percent quantiles of the true value within ``limits``; rows beyond it count in
    the edge columns. A task adds up one array of ``n_grid`` densities for each column of the grid as its rows come, so
    no row is repeated and at most ``n_grid**2`` sums leave a task.
    """
    lo, hi = quantile_values(df, truth, [0.005, 0.995])
    lo, hi = max(lo, limits[0]), min(hi, limits[1])
    step = (hi - lo) / n_grid
    parts = gmm_columns(df, prefix)
    k = len(parts[0])
    ix = F.floor((F.col(truth) - F.lit(lo)) / F.lit(step)).cast("int")
    inputs = [c.cast("double").alias(f"c{i}") for i, c in enumerate(c for part in parts for c in part)]
    rows = df.select(F.least(F.greatest(ix, F.lit(0)), F.lit(n_grid - 1)).alias("ix"), *inputs).na.drop()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lo + (np.arange(n_grid) + 0.5) * step
        sums, seen = np.zeros((n_grid, n_grid)), np.zeros(n_grid, bool)
        for batch in batches:
            column, *values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + 3 * k))
            for start in range(0, len(column), MAP_ROWS):
                part = slice(start, start + MAP_ROWS)
                density = np.zeros((len(column[part]), n_grid))
                for w, m, s in zip(values[:k], values[k:2 * k], values[2 * k:]):
                    z = (at[None, :] - m[part, None]) / s[part, None]
                    density += (w[part] / (s[part] * math.sqrt(2 * math.pi)))[:, None] * np.exp(-0.5 * z * z)
                order = np.argsort(column[part], kind="stable")
                found, first = np.unique(column[part][order], return_index=True)
                sums[found] += np.add.reduceat(density[order], first, axis=0) if len(found) else 0.0
                seen[found] = True
        x = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n_grid), pa.int32()), pa.array(np.tile(np.arange(n_grid), len(x)), pa.int32()),
                                          pa.array(sums[x].ravel())], names=["ix", "iy", "density"])

    partial = rows.mapInArrow(add_up, "ix int, iy int, density double")
    density = partial.groupBy("ix", "iy").agg(F.sum("density").alias("density"))
    return density.withColumn("log_density", F.when(F.col("density") > 0, F.log10("density")))


def kernel_density(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float],
                   n_bins: int = 60, reach: float = 8.0) -> DataFrame:
    """Gaussian kernel density on the grid's cell centres, from binned counts.

    The bandwidth is Scott's rule on the data's covariance. Points are counted on a grid that reaches ``reach`` bandwidths
    beyond the window (what lies further adds less than exp(-reach**2 / 2) of a kernel's peak). Its cells are those of
    the window, or whole blocks of them where the bandwidth is more than ``FINE`` cells, so their number is bounded by the
    window's grid and ``reach``, never by rows or bandwidth. Each task sums the kernels of its cells over the window.
    """
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    points = df.where(finite(fx) & finite(fy))
    stats = points.agg(F.count("*").alias("n"), F.var_samp(fx).alias("vx"), F.var_samp(fy).alias("vy"), F.covar_samp(fx, fy).alias("c")).first()
    if stats["n"] < 2 or not stats["vx"] * stats["vy"] > stats["c"] ** 2:
        raise ValueError("a kernel density needs points that do not lie on one line")
    scale = stats["n"] ** (-2.0 / 6.0)
    vx, vy, cov = stats["vx"] * scale, stats["vy"] * scale, stats["c"] * scale
    det = vx * vy - cov * cov

    def axis(c: Column, window: tuple[float, float], variance: float) -> tuple[Column, float, float]:
        """Cell number of a point (null beyond reach), cell width and start of the counting grid."""
        width = (window[1] - window[0]) / n_bins
        block = max(1, int(math.sqrt(variance) / (FINE * width)))
        halo = math.ceil(reach * math.sqrt(variance) / (width * block))
        cells = math.ceil(n_bins / block) + 2 * halo
        start = window[0] - halo * block * width
        cell = F.floor((c - F.lit(start)) / F.lit(block * width)).cast("int")
        return F.when(cell.between(0, cells - 1), cell), block * width, start

    (cx, wx, x0), (cy, wy, y0) = axis(fx, x_range, vx), axis(fy, y_range, vy)
    counts = points.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("n")).where("cx is not null and cy is not null")
    peak = 1.0 / (2.0 * math.pi * math.sqrt(det) * stats["n"])
    centres = [lo + (np.arange(n_bins) + 0.5) * (hi - lo) / n_bins for lo, hi in (x_range, y_range)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_bins, n_bins))
        for batch in batches:
            at_x, at_y, n = (batch.column(i).to_numpy() for i in range(3))
            for px, py, count in zip(x0 + (at_x + 0.5) * wx, y0 + (at_y + 0.5) * wy, n):  # cells, not rows
                ux, uy = (centres[0] - px)[:, None], (centres[1] - py)[None, :]
                total += count * np.exp(-0.5 * (ux * ux * vy - 2.0 * cov * ux * uy + uy * uy * vx) / det)
        cells = np.indices((n_bins, n_bins)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int32()), pa.array(total.ravel() * peak)], names=["ix", "iy", "kde"])

    return counts.mapInArrow(spread, "ix int, iy int, kde double").groupBy("ix", "iy").agg(F.sum("kde").alias("kde"))
