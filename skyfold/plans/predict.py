"""Batch prediction: select rows, apply the model's own preparation, score, write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.columns import add_expressions, inverse_target, linear_uncertainty, with_gaia_colors
from skyfold.functions.missing import nullify_sentinel
from skyfold.operators import filters, forests
from skyfold.operators.clustering import Clustering
from skyfold.operators.encoding import CategoryEncoder
from skyfold.plans.train import engineered
from skyfold.sources.tables import prediction_table

# Columns that keep what was stored, for output.
STORED = "_stored_"


def apply_preparation(df: DataFrame, metadata: Mapping) -> DataFrame:
    """The saved recipe: sentinel to NULL, expressions, engineered features, encoder and clustering, as in training.

    Rows without a value in a feature that the model needs go before the encoder and the clustering.
    """
    recipe = metadata.get("recipe", {})
    df = nullify_sentinel(df, [c for c in df.columns if not c.startswith(STORED)])
    df = engineered(add_expressions(df, recipe.get("expressions", {})), recipe)
    df = filters.require_features(df, metadata["features"])
    if metadata.get("encoder"):
        df = CategoryEncoder.from_dict(metadata["encoder"]).transform(df, drop=False)
    if metadata.get("clustering"):
        df = Clustering.from_dict(metadata["clustering"]).transform(df)
    return df


def predict_catalog(df: DataFrame, model: PipelineModel, metadata: Mapping, *, rules: Mapping | None = None,
                    target_name: str | None = None, include=(), fast_trees: int | None = None,
                    key: str = "source_id") -> DataFrame:
    """Predictions in linear units, of a forest with the spread of its trees. Every step is row-local: no shuffle.

    Boosted trees are no sample of predictions, so such a model gives no uncertainty. Columns of ``include`` come out as
    they are stored, sentinels too.
    """
    kind = metadata.get("target_transform", "none")
    rows = filters.apply_rules(with_gaia_colors(df), rules or {})
    extra = [c for c in dict.fromkeys(include) if c in rows.columns and c != key]
    rows = rows.withColumns({f"{STORED}{i}": F.col(c) for i, c in enumerate(extra)}) if extra else rows
    rows = apply_preparation(rows, metadata)
    if metadata.get("backend", "forest") != "forest":
        scored = forests.predict(model, rows)
    elif fast_trees:
        scored = forests.fast_tree_spread(model, rows, fast_trees, uncertainty="_sigma")
    else:
        trees = forests.tree_predictions(model, rows)
        scored = trees.withColumn("_sigma", forests.array_std(F.col("tree_preds"))).drop("tree_preds")
    linear = scored.withColumn("prediction", inverse_target(F.col("prediction"), kind))
    if "_sigma" in scored.columns:
        linear = linear.withColumn("uncertainty", linear_uncertainty(F.col("prediction"), F.col("_sigma"), kind))
    linear = linear.withColumns({c: F.col(f"{STORED}{i}") for i, c in enumerate(extra)}) if extra else linear
    return prediction_table(linear, target_name or metadata["target"], key, include=include)
