"""Validation statistics: each report is one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.constants import CORRECTION_THRESHOLD, CORRECTION_WIDTH, EIGHT_EDGES, EIGHT_LABELS, TARGET_EDGES, \
    TARGET_LABELS
from skyfold.functions.binning import bin_label, edge_bin
from skyfold.functions.missing import finite, has_original, is_sentinel, numeric_columns
from skyfold.operators.ranks import exact_quantiles
from skyfold.operators.scalars import attach_row


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def regression_aggregates(truth: Column, pred: Column) -> dict[str, Column]:
    """Named aggregates: MAE, RMSE, R2, mean relative error in percent, share within 5, 10 and 20 percent, count."""
    err = pred - truth
    rel = F.try_divide(F.abs(err), F.abs(truth))
    sse, sst = F.avg(err * err), F.var_pop(truth)
    out = {
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(sse),
        "r2": F.lit(1.0) - F.try_divide(sse, sst),
        "mean_relative_error": F.avg(rel) * F.lit(100.0),
    }
    for p in (5, 10, 20):
        out[f"within_{p}_percent"] = F.avg(F.when(rel <= p / 100.0, 1.0).otherwise(0.0)) * F.lit(100.0)
    out["n_samples"] = F.count(err)
    return out


def regression_metrics(df: DataFrame, truth: str = "true_value", pred: str = "predicted_value",
                       by: Sequence[str] = ()) -> DataFrame:
    aggs = regression_aggregates(F.col(truth), F.col(pred))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def metrics_by_bin(df: DataFrame, truth: str = "true_value", pred: str = "predicted_value",
                   edges: Sequence[float] = TARGET_EDGES["teff"], closed: str = "left",
                   labels: Sequence[str] | None = None) -> DataFrame:
    """The metrics per bin of the true value; bins without rows are absent."""
    binned = df.withColumn("bin_index", edge_bin(F.col(truth), edges, closed)).where("bin_index is not null")
    aggs = regression_aggregates(F.col(truth), F.col(pred))
    keep = {"mae": "mae", "rmse": "rmse", "r2": "r2", "mean_relative_error": "mean_pct",
            "within_10_percent": "within_10", "n_samples": "n_samples"}
    stats = binned.groupBy("bin_index").agg(*[aggs[a].alias(n) for a, n in keep.items()])
    lo, hi = (bin_label(F.col("bin_index"), e) for e in (edges[:-1], edges[1:]))
    out = stats.select(lo.alias("value_min"), hi.alias("value_max"), ((lo + hi) / 2).alias("value_center"),
                       *([bin_label(F.col("bin_index"), labels).alias("bin")] if labels else []), *keep.values())
    return out


def metrics_by_target_kind(df: DataFrame, kind: str, truth: str = "true_value",
                           pred: str = "predicted_value") -> DataFrame:
    """The left-closed bins and labels that belong to ``teff``, ``logg`` or ``mh``."""
    return metrics_by_bin(df, truth, pred, TARGET_EDGES[kind], "left", TARGET_LABELS[kind])


def metrics_by_eight_bins(df: DataFrame, truth: str = "true_value", pred: str = "predicted_value") -> DataFrame:
    return metrics_by_bin(df, truth, pred, EIGHT_EDGES, "right", EIGHT_LABELS)


def rmse_curve(df: DataFrame, truth: str = "true_value", pred: str = "predicted_value", width: float = 100.0,
               min_rows: int = 10) -> DataFrame:
    """RMSE per half-open bin of ``width``, bins with few rows left out."""
    err = F.col(pred) - F.col(truth)
    return (df.groupBy(F.floor(F.col(truth) / F.lit(width)).alias("_b"))
            .agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.count("*").alias("n"))
            .where(F.col("n") >= min_rows)
            .select(((F.col("_b") + F.lit(0.5)) * F.lit(width)).alias("bin_center"), "rmse", "n"))


def prediction_statistics(df: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                  F.count(c).alias("n_objects"))


def with_median(summary: DataFrame, df: DataFrame, value: str, probs: Mapping[str, float] | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """Add exact quantiles to a summary of the same groups (one row without groups)."""
    quantiles = exact_quantiles(df, value, probs or {"median": 0.5}, by)
    if by:
        return summary.join(quantiles, list(by), "left")
    return attach_row(summary, quantiles)


def uncertainty_statistics(df: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    summary = df.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))
    return with_median(summary, df, value).select("mean", "median", "min", "max")


def correction_statistics(df: DataFrame, original: str, corrected: str, threshold: float = CORRECTION_THRESHOLD,
                          width: float = CORRECTION_WIDTH) -> DataFrame:
    """How many rows the correction touched, how far it moved them, and the ranges before and after."""
    o, c = F.col(original), F.col(corrected)
    touched = df.where(~is_sentinel(o) & (o > threshold) & ~F.isnan(o)).withColumn("_shift", c - o)
    blend = F.when(o < threshold + width, 1).otherwise(0)
    summary = touched.agg(
        F.count("*").alias("n_corrected"), F.coalesce(F.sum(blend), F.lit(0)).cast("long").alias("n_blended"),
        F.avg("_shift").alias("mean_correction"),
        F.min(o).alias("original_min"), F.max(o).alias("original_max"),
        F.min(c).alias("corrected_min"), F.max(c).alias("corrected_max"))
    return with_median(summary, touched, "_shift", {"median_correction": 0.5})


def coverage_overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows with both values, only the first, only the second, neither; counts and percent."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    cases = {"both": a & b, "only_a": a & ~b, "only_b": ~a & b, "neither": ~a & ~b}
    out = df.agg(*[F.count_if(c).alias(f"n_{n}") for n, c in cases.items()], F.count("*").alias("n_total"))
    return out.withColumns({f"pct_{n}": percent(F.col(f"n_{n}"), F.col("n_total")) for n in cases})


def availability(df: DataFrame, original: str = "teff_gaia_original", best: str = "teff_best",
                 uncertainty: str = "teff_best_uncertainty") -> DataFrame:
    u = F.col(uncertainty)
    cases = {"original": has_original(F.col(original)), "best": finite(F.col(best)), "uncertainty": finite(u) & (u > 0)}
    out = df.agg(F.count("*").alias("n_total"), *[F.count_if(c).alias(f"n_{n}") for n, c in cases.items()])
    return out.withColumns({f"pct_{n}": percent(F.col(f"n_{n}"), F.col("n_total")) for n in cases})


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sentinel, NaN and NULL cells per numeric column, and their total; one row per column from one scan."""
    names = numeric_columns(df, columns)
    counts = df.agg(*[F.count_if(F.coalesce(is_sentinel(F.col(n).cast("double")) | F.isnan(F.col(n).cast("double")),
                                            F.lit(True))).alias(n) for n in names])
    rows = [F.struct(F.lit(n).alias("column"), F.col(n).alias("n_missing")) for n in names]
    total = F.struct(F.lit("total").alias("column"), reduce(lambda a, b: a + b, (F.col(n) for n in names)).alias("n_missing"))
    return counts.select(F.explode(F.array(*rows, total)).alias("r")).select("r.*")


def cluster_profile(df: DataFrame, probabilities: Sequence[str], target: str) -> DataFrame:
    """Size, share and target spread per most likely cluster."""
    top = F.greatest(*[F.col(p) for p in probabilities]) if len(probabilities) > 1 else F.col(probabilities[0])
    label = F.coalesce(*[F.when(F.col(p) == top, F.lit(i)) for i, p in enumerate(probabilities)])
    sized = df.groupBy(label.alias("cluster")).agg(F.count("*").alias("n"), F.avg(target).alias("target_mean"),
                                                   F.stddev_pop(target).alias("target_std"))
    total = sized.agg(F.sum("n").alias("_total"))
    return attach_row(sized, total).withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total")


def feature_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """F statistic of each feature's univariate regression on the target, best first."""
    stats = df.agg(F.count(target).alias("n"), *[F.corr(f, target).alias(f"r_{i}") for i, f in enumerate(features)])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"r_{i}").alias("r")) for i, f in enumerate(features)]
    flat = stats.select("n", F.explode(F.array(*rows)).alias("s")).select("n", "s.*")
    r2 = F.col("r") * F.col("r")
    score = F.try_divide(r2, F.lit(1.0) - r2) * (F.col("n") - F.lit(2))
    return flat.select("feature", score.alias("f_score"))


def top_features(df: DataFrame, features: Sequence[str], target: str, k: int) -> DataFrame:
    return feature_scores(df, features, target).orderBy(F.desc("f_score"), "feature").limit(k)


def pair_counts(df: DataFrame, pairs: Mapping[str, Column]) -> DataFrame:
    """Number of rows valid for each named comparison, from one scan."""
    out = df.agg(*[F.count_if(c).alias(n) for n, c in pairs.items()])
    rows = [F.struct(F.lit(n).alias("comparison"), F.col(n).alias("n")) for n in pairs]
    return out.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
