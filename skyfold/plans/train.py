"""Training: correct, filter, engineer, split, encode, cluster, tune, fit and score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.columns import add_expressions, correct_poly_smooth, inverse_target, linear_uncertainty, transform_target
from skyfold.functions.features import engineer_all_features
from skyfold.functions.missing import nullify_sentinel
from skyfold.functions.mixture import with_mixture_scores
from skyfold.operators import clustering, encoding, filters, forests, mixture_fit, sampling, tuning
from skyfold.operators.metrics import regression_metrics
from skyfold.session import stored


def prepare_training(df: DataFrame, config: Mapping) -> tuple[DataFrame, list[str], str]:
    """Rows ready for the split, with their features and target. One lazy plan: scan, projections and filters."""
    target, features = config["target"], list(config["features"])
    ranges = config.get("filters", {})
    stored_ranges = {c: r for c, r in ranges.items() if c in df.columns}  # these reach the scan
    df = nullify_sentinel(filters.range_filters(df, stored_ranges))
    if config.get("correction"):
        df = df.withColumn(f"{target}_corrected", correct_poly_smooth(F.col(target), config["correction"]))
        target = f"{target}_corrected"
    df = filters.range_filters(df, {c: r for c, r in ranges.items() if c not in stored_ranges})
    recipe = feature_recipe(config)
    df = add_expressions(df, recipe["expressions"])
    df = filters.valid_target(filters.drop_missing(df, [target, *features]), target)
    before = set(df.columns)
    df = engineered(df, recipe)
    features += [c for c in df.columns if c not in before]
    kind = config.get("target_transform", "none")
    return df.withColumn("_y", transform_target(F.col(target), kind)), features, target


def feature_recipe(config: Mapping) -> dict:
    """What turns stored columns into features, as plain values that a model's metadata keeps."""
    engineering = dict(config.get("feature_engineering", {}))
    on = bool(engineering.pop("enabled", False))
    return {"expressions": {} if on else dict(config.get("expressions", {})), "engineering": engineering if on else None}


def engineered(df: DataFrame, recipe: Mapping) -> DataFrame:
    """Engineered features of a recipe, after its expressions."""
    e = recipe.get("engineering")
    if not e:
        return df
    return engineer_all_features(df, e["colors"], e.get("mags", ()), **{k: v for k, v in e.items() if k.startswith("include_")})


def train_model(df: DataFrame, config: Mapping, key: str = "source_id") -> dict:
    """Fit and evaluate; returns model, metadata, metrics and the scored test rows.

    Keys of ``config``: target, features, correction, filters, expressions, feature_engineering, target_transform,
    encode, clustering, split, sample_weight, backend ("forest" or "boosting"), model, tuning (with method "random" or
    "halving", and ``cache``, a folder that remembers what was found), mixture. The metadata holds all that scoring new rows needs, the correction and the metrics. Rows whose
    features or target are infinite cannot be fitted; their number is in the metadata as ``rows_not_finite``.
    """
    rows, features, target = prepare_training(df, config)
    # Strata, split, encoder and clustering each read the rows again: keep the prepared table.
    rows = stored(rows, "prepared")
    prepared = rows.count()
    for name in ["_y", *features]:  # a logarithm at its pole has no place in a feature vector
        if rows.schema[name].dataType.typeName() == "double":
            rows = filters.finite_target(rows, name)
    how = config.get("split", {})
    if how.get("stratify_bins"):
        rows = sampling.stratified_split(rows, target, how["stratify_bins"], key, how.get("categories", ()),
                                         how.get("test_size", 0.2), how.get("seed", 42))
    else:
        rows = sampling.split(rows, key, how.get("test_size", 0.2), how.get("seed", 42))
    is_train = F.col("split") == "train"
    metadata = {"target": target, "target_transform": config.get("target_transform", "none"), "recipe": feature_recipe(config),
                "correction": list(config.get("correction", ())), "filters": {c: list(r) for c, r in config.get("filters", {}).items()},
                "rows_not_finite": prepared - rows.count()}

    if config.get("encode"):
        enc = encoding.fit_encoder(rows.where(is_train), config["encode"], config.get("encoding", "onehot"))
        rows = enc.transform(rows, drop=False)
        named = enc.output_names() if enc.kind == "onehot" else [f"{c}_ordinal" for c in enc.output_names()]
        features = [f for f in features if f not in config["encode"]] + named
        metadata["encoder"] = enc.to_dict()
    if config.get("clustering"):
        cl = clustering.fit_clustering(rows.where(is_train), features, **config["clustering"])
        rows = cl.transform(rows)
        features = features + cl.probability_names()
        metadata["clustering"] = cl.to_dict()

    weight = config.get("sample_weight")
    rows = stored(rows, "split")
    train, test = rows.where(is_train), rows.where(~is_train)
    params = dict(config.get("model", {}))
    backend = config.get("backend", "forest")
    if config.get("tuning"):
        found, metadata["tuning_cached"] = tuned(train, features, config, key)
        params.update(found)
    model = forests.FITTERS[backend](train, features, "_y", weight=weight, **params)
    metadata.update(features=features, hyperparameters=params, backend=backend)

    metrics = stored(evaluate(model, rows, target, metadata["target_transform"]), "metrics")
    metadata["metrics"] = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in metrics.collect()}  # two rows
    kind = metadata["target_transform"]
    if backend == "forest":
        scored = score_test(model, test, target, kind, config.get("mixture", {"k": 5}))
    else:  # boosted trees are no sample of predictions, so they have no spread
        scored = forests.predict(model, test).withColumn("prediction", inverse_target(F.col("prediction"), kind))
    scored = stored(scored, "test_scores")  # several reports read them
    return {"model": model, "metadata": metadata, "metrics": metrics, "test": scored, "rows": rows}


# Settings that decide what a search would find, besides its own options.
SEARCHED = ("target", "features", "correction", "filters", "expressions", "feature_engineering", "target_transform", "encode", "encoding",
            "clustering", "split", "sample_weight", "backend")


def tuned(train: DataFrame, features: list[str], config: Mapping, key: str) -> tuple[dict, bool]:
    """Parameters found by the configured search; with a ``cache`` folder an equal configuration is searched once."""
    options = dict(config["tuning"])
    cache, method = options.pop("cache", None), options.pop("method", "random")
    find = {"random": tuning.search, "halving": tuning.halving_search}[method]

    options.update(key=key, weight=config.get("sample_weight"), backend=config.get("backend", "forest"))
    if cache is None:
        return find(train, features, "_y", **options)[0], False
    settings = {name: config[name] for name in SEARCHED if name in config} | {"tuning": {"method": method, **options}}
    return tuning.tuned_parameters(cache, settings, train, features, "_y", find, **options)


def evaluate(model: PipelineModel, rows: DataFrame, target: str, kind: str) -> DataFrame:
    """Metrics on both splits in linear units, from one pass."""
    scored = forests.predict(model, rows).withColumn("prediction", inverse_target(F.col("prediction"), kind))
    return regression_metrics(scored, target, "prediction", by=["split"])


def score_test(model: PipelineModel, test: DataFrame, target: str, kind: str, mixture: Mapping) -> DataFrame:
    """Tree spread, predictive mixture, CRPS and PIT of test rows in linear units; narrow throughout."""
    trees = forests.tree_predictions(model, test).withColumn("_sigma", forests.array_std(F.col("tree_preds")))
    spread = trees.withColumn("prediction", inverse_target(F.col("prediction"), kind))
    spread = spread.withColumn("uncertainty", linear_uncertainty(F.col("prediction"), F.col("_sigma"), kind)).drop("_sigma")
    spread = forests.linear_tree_predictions(spread, kind)
    if mixture.get("k_max"):
        fitted = mixture_fit.fit_mixtures_bic(spread, "tree_preds", mixture["k_max"])
    else:
        fitted = mixture_fit.fit_mixtures(spread, "tree_preds", mixture.get("k", 5))
    return with_mixture_scores(fitted, target).drop("tree_preds")


def train_legacy(df: DataFrame, features, exclude=(), key: str = "source_id", **model) -> dict:
    """The fixed preset: target ``Te_avg``, engineered colour features, random split, one forest."""
    config = {"target": "Te_avg", "features": [f for f in features if f not in exclude],
              "feature_engineering": {"enabled": True, "colors": [f for f in features if f not in exclude]}, "model": model}
    return train_model(df, config, key)
