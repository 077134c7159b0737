"""Choice among competing predictions of one quantity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.constants import SENTINEL
from skyfold.functions.binning import bin_label
from skyfold.functions.missing import finite
from skyfold.operators.metrics import percent, regression_metrics


def _candidates(models: Sequence[str], sentinel: float) -> Column:
    """The valid predictions of a row as structs whose order is uncertainty, then position of the model."""
    slots = []
    for i, m in enumerate(models):
        v, u = F.col(m), F.col(f"{m}_uncertainty")
        valid = finite(v) & u.isNotNull() & ~F.isnan(u) & (u > 0) & (v != F.lit(sentinel))
        slots.append(F.when(valid, F.struct(u.alias("unc"), F.lit(i).alias("idx"), v.alias("value"))))
    return F.array(*slots)


def best_of(df: DataFrame, models: Sequence[str], value: str = "teff_best",
            uncertainty: str = "teff_best_uncertainty", winner: str | None = None,
            sentinel: float = SENTINEL) -> DataFrame:
    """Value and uncertainty of the valid prediction with the least uncertainty; ties go to the earlier model."""
    best = F.array_min(_candidates(models, sentinel))
    out = df.withColumn("_best", best)
    made = {value: F.col("_best.value"), uncertainty: F.col("_best.unc")}
    if winner:
        made[winner] = bin_label(F.col("_best.idx"), models)
    return out.withColumns(made).drop("_best")


def winner_share(df: DataFrame, models: Sequence[str], sentinel: float = SENTINEL) -> DataFrame:
    """How often each model is the best, among rows with any valid prediction; models that never win are listed."""
    won = best_of(df, models, "_v", "_u", "model", sentinel).where("model is not null")
    counts = won.agg(*[F.count_if(F.col("model") == m).alias(m) for m in models])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("n_best")) for m in models])
    total = reduce(lambda a, b: a + b, (F.col(m) for m in models))
    flat = counts.select(total.alias("_n"), F.explode(rows).alias("r")).select("_n", "r.*")
    return flat.select("model", "n_best", F.coalesce(percent(F.col("n_best"), F.col("_n")), F.lit(0.0)).alias("share"))


def model_comparison(tests: Mapping[str, DataFrame], share: DataFrame, truth: str = "y_true",
                     pred: str = "y_pred") -> DataFrame:
    """One row per model: MAE, RMSE, R2 and size on its test set, and its share of the merged catalog."""
    rows = [t.select(F.lit(m).alias("model"), F.col(truth).alias("t"), F.col(pred).alias("p"))
            for m, t in tests.items()]
    metrics = regression_metrics(reduce(DataFrame.unionByName, rows), "t", "p", by=["model"])
    return (metrics.join(share, "model", "left")
            .select("model", "mae", "rmse", "r2", "n_samples", F.coalesce("share", F.lit(0.0)).alias("share")))
