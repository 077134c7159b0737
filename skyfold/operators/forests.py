"""Tree ensembles: fit, predict, and what each single tree says."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.columns import inverse_target_array, linear_uncertainty
from skyfold.functions.mixture import array_mean, array_std
from skyfold.operators import forest_grid
from skyfold.session import stored

log = logging.getLogger(__name__)

MAX_DEPTH = 30
# Trees that one projection evaluates, and the nodes that one plan carries.
GROUP_TREES = 50
GROUP_NODES = 2_000_000
# Rows of one task: of a forest fit, and of the evaluation of many single trees.
FIT_ROWS, SCORE_ROWS = 100_000, 25_000
# Rows from which a forest is fitted from sums over a grid, if its features allow.
GRID_ROWS = 100_000


# ---- fit and predict ----------------------------------------------------------------------------------------------

def dealt(df: DataFrame, rows: int = SCORE_ROWS) -> DataFrame:
    """All rows, dealt evenly over tasks of about ``rows``: counts and shuffles them.

    For work that costs far more than the shuffle. A compact file of a million rows may be a single partition.
    """
    return df.repartition(1 + df.count() // rows)


def _subset(max_features) -> str:
    return {None: "all", "sqrt": "sqrt", "log2": "log2"}.get(max_features, str(max_features))


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def fit_forest(train: DataFrame, features: Sequence[str], target: str, n_estimators: int = 100, max_depth: int = 20,
               min_samples_leaf: int = 1, max_features: str | float | None = "sqrt", seed: int = 42,
               weight: str | None = None, max_bins: int = 32, min_samples_split: int = 2) -> PipelineModel:
    """Random forest regression. Depth is clamped to 30.

    No node of fewer than ``min_samples_split`` rows is split: each side of a split holds at least half as many. Very
    uneven splits of larger nodes are thereby refused too.

    Rows are dealt evenly over tasks by their number, as a small file may be one partition. Spark ML passes over them for
    every level of the trees, and each row remembers its node in every tree. From ``GRID_ROWS`` rows on, forests of few
    features are fitted in one pass instead, see ``forest_grid``.
    """
    if max_depth > MAX_DEPTH:
        log.warning("max_depth %s clamped to %s", max_depth, MAX_DEPTH)
    rf = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=n_estimators,
                               maxDepth=min(max_depth, MAX_DEPTH), minInstancesPerNode=max(min_samples_leaf, math.ceil(min_samples_split / 2)),
                               featureSubsetStrategy=_subset(max_features), seed=seed, maxBins=max_bins, cacheNodeIds=True, checkpointInterval=-1)
    if weight:
        rf = rf.setWeightCol(weight)
    keep = [target, *([weight] if weight else [])]
    rows = train.select(*features, *keep)
    tasks = 1 + (number := rows.count()) // FIT_ROWS
    stage, rows = assembler(features), rows.repartition(tasks)
    assembled = stage.transform(rows).select("features", *keep)
    if number > GRID_ROWS and forest_grid.fits(rf, assembled, len(features)):
        return PipelineModel([stage, forest_grid.fit(rf, assembled, len(features), tasks)])
    return _fit(rf, rows, features, keep)


def fit_boosting(train: DataFrame, features: Sequence[str], target: str, n_estimators: int = 1000, max_depth: int = 8,
                 learning_rate: float = 0.05, subsample: float = 0.9, column_share: float = 0.9, min_child_weight: float = 1.0,
                 seed: int = 42, weight: str | None = None) -> PipelineModel:
    """Gradient boosting on squared error.

    ``column_share`` of the features is drawn for each node. The second derivative of the error is 1 for every row, so
    ``min_child_weight`` is a least number of rows per node.
    """
    gbt = GBTRegressor(featuresCol="features", labelCol=target, maxIter=n_estimators, maxDepth=min(max_depth, MAX_DEPTH),
                       stepSize=learning_rate, subsamplingRate=subsample, seed=seed, minInstancesPerNode=max(1, math.ceil(min_child_weight)),
                       featureSubsetStrategy=_subset(None if column_share >= 1 else column_share))
    if weight:
        gbt = gbt.setWeightCol(weight)
    return _fit(gbt, train, features, [target, *([weight] if weight else [])])


FITTERS = {"forest": fit_forest, "boosting": fit_boosting}


def _fit(estimator, train: DataFrame, features: Sequence[str], keep: Sequence[str]) -> PipelineModel:
    stage = assembler(features)
    model = estimator.fit(stage.transform(train.select(*features, *keep)).select("features", *keep))
    return PipelineModel([stage, model])


def model_features(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``; a feature the table lacks is an error. No shuffle of the rows."""
    missing = [f for f in model_features(model) if f not in df.columns]
    if missing:
        raise ValueError(f"table lacks model features {missing}")
    stage = model.stages[-1]
    return _by_cell(df, model.stages[0], [stage], ["prediction"], lambda rows: model.transform(rows).drop("features"))


def feature_importance(spark, model: PipelineModel, top: int | None = None) -> DataFrame:
    """Feature importances, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(model_features(model), values)]
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


# ---- single trees -------------------------------------------------------------------------------------------------

def _groups(trees: Sequence) -> list[list[int]]:
    """Positions of the trees in groups that one projection evaluates: bounded in number and in nodes."""
    out, nodes = [], 0
    for i, tree in enumerate(trees):
        if not out or len(out[-1]) == GROUP_TREES or nodes + tree.numNodes > GROUP_NODES:
            out.append([])
            nodes = 0
        out[-1].append(i)
        nodes += tree.numNodes
    return out


def _evaluated(df: DataFrame, trees: Sequence, column: str, inputs=None) -> DataFrame:
    """Add one array with each tree's prediction. The trees are Spark ML's own models and run in the JVM.

    ``inputs(df, i)`` may add the vector that tree ``i`` reads and name it; by default all read ``features``. A plan
    carries the nodes of its trees, so beyond one group in nodes the rows are stored between groups.
    """
    groups, parts = _groups(trees), []
    large = not df.isStreaming and sum(t.numNodes for t in trees) > GROUP_NODES
    for g, group in enumerate(groups):
        before = df.columns
        for i in group:
            df, features = inputs(df, i) if inputs else (df, "features")
            df = trees[i].copy().setFeaturesCol(features).setPredictionCol(f"_tree_{i}").transform(df)
        df = df.select(*[F.col(f"`{c}`") for c in before], F.array(*[f"_tree_{i}" for i in group]).alias(f"_group_{g}"))
        parts.append(f"_group_{g}")
        if large:
            df = stored(df, "trees")
    return df.withColumn(column, F.concat(*parts)).drop(*parts)


def _by_cell(df: DataFrame, assembler: VectorAssembler, forests: Sequence, added: Sequence[str],
             evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``evaluate(df)``; where the forests' thresholds part the rows into fewer cells than the trees have nodes, once per cell.

    All rows of a cell take the same way down every tree. The thresholds of a forest are known if it was fitted on a grid;
    only those of large ones are read from the model.
    """
    wide = len(assembler.getInputCols())
    if df.isStreaming or {"prediction", "features"} & set(df.columns) & set(added) or any(not hasattr(f, "trees") for f in forests):
        return evaluate(df)
    grids = []
    for forest in forests:
        if not forest_grid.known(forest) and forest.totalNumNodes <= GROUP_NODES:
            return evaluate(df)
        grids.append(forest_grid.thresholds_of(forest))
    if any(g is None or len(g) < wide for g in grids):
        return evaluate(df)
    thresholds = [np.unique(np.concatenate([g[f] for g in grids])) for f in range(wide)]
    cells = math.prod(len(t) + 1 for t in thresholds)
    if not 1 < cells <= min(forest_grid.CELLS, sum(f.totalNumNodes for f in forests)):
        return evaluate(df)
    return forest_grid.by_cell(df, assembler, thresholds, added, evaluate)


def tree_predictions(model: PipelineModel, df: DataFrame, column: str = "tree_preds") -> DataFrame:
    """Add one array with every tree's prediction, and ``prediction``, their mean as the forest itself takes it. Rows are not shuffled."""
    trees = model.stages[-1].trees

    def evaluate(rows: DataFrame) -> DataFrame:
        out = _evaluated(model.stages[0].transform(rows), trees, column)
        return out.withColumn("prediction", array_mean(F.col(column))).drop("features")

    return _by_cell(df, model.stages[0], [model.stages[-1]], [column, "prediction"], evaluate)


def with_tree_spread(df: DataFrame, column: str = "tree_preds", kind: str = "none", mean: str = "prediction",
                     uncertainty: str = "uncertainty") -> DataFrame:
    """Mean and population deviation over the trees, carried to linear units."""
    log_mean, log_std = array_mean(F.col(column)), array_std(F.col(column))
    out = df.withColumns({"_m": log_mean, "_s": log_std})
    linear = {"none": F.col("_m"), "log10": F.pow(F.lit(10.0), "_m"), "log2": F.pow(F.lit(2.0), "_m"), "ln": F.exp("_m")}[kind]
    out = out.withColumn(mean, linear)
    return out.withColumn(uncertainty, linear_uncertainty(F.col(mean), F.col("_s"), kind)).drop("_m", "_s")


def linear_tree_predictions(df: DataFrame, kind: str, column: str = "tree_preds") -> DataFrame:
    return df.withColumn(column, inverse_target_array(F.col(column), kind))


def fast_tree_spread(model: PipelineModel, df: DataFrame, n_trees: int = 20, seed: int = 42,
                     uncertainty: str = "uncertainty") -> DataFrame:
    """Spread over a seeded subset of trees, scaled by the root of all trees over the requested number."""
    trees = model.stages[-1].trees
    chosen = np.sort(np.random.default_rng(seed).choice(len(trees), size=min(n_trees, len(trees)), replace=False))
    scale = float(np.sqrt(len(trees) / n_trees))

    def evaluate(rows: DataFrame) -> DataFrame:
        out = model.stages[-1].transform(model.stages[0].transform(rows))
        out = _evaluated(out, [trees[i] for i in chosen], "_some")
        return out.withColumn(uncertainty, array_std(F.col("_some")) * F.lit(scale)).drop("_some", "features")

    return _by_cell(df, model.stages[0], [model.stages[-1]], ["prediction", uncertainty], evaluate)


def chained_propagation(logg_model: PipelineModel, teff_model: PipelineModel, df: DataFrame,
                        n_logg: int | None = None, teff_in_log: bool = True, seed: int = 42,
                        mean: str = "teff_mean_k", std: str = "teff_std_k") -> DataFrame:
    """Spread of a chained prediction: surface gravity from one forest feeds a temperature forest.

    Trajectory ``j`` takes gravity from gravity tree ``j`` and temperature from one temperature tree drawn for
    ``j``, the same for all rows. Gravity is the temperature model's last feature. Rows are not shuffled.
    """
    logg, teff = logg_model.stages[-1].trees, teff_model.stages[-1].trees
    rng = np.random.default_rng(seed)
    total = len(logg)
    first = np.arange(total) if n_logg is None or n_logg >= total else np.sort(rng.choice(total, n_logg, replace=False))
    second = rng.integers(0, len(teff), size=len(first))
    if model_features(teff_model)[:-1] != model_features(logg_model):
        raise ValueError("the temperature model must use the gravity model's features followed by gravity")
    colors = F.array(*[F.col(f).cast("double") for f in model_features(logg_model)])

    def with_gravity(rows: DataFrame, j: int) -> tuple[DataFrame, str]:
        vector = array_to_vector(F.concat(colors, F.array(F.get("_gravity", F.lit(j)))))
        return rows.withColumn(f"_input_{j}", vector), f"_input_{j}"

    def evaluate(rows: DataFrame) -> DataFrame:
        rows = _evaluated(logg_model.stages[0].transform(rows), [logg[i] for i in first], "_gravity").drop("features")
        paths = _evaluated(rows, [teff[i] for i in second], "_paths", with_gravity)
        paths = paths.withColumns({mean: array_mean(F.col("_paths")), std: array_std(F.col("_paths"))}).drop("_paths", "_gravity")
        if teff_in_log:
            paths = paths.withColumn(mean, F.pow(F.lit(10.0), F.col(mean))).withColumn(std, F.col(mean) * F.col(std) * F.lit(float(np.log(10.0))))
        return paths

    return _by_cell(df, logg_model.stages[0], [logg_model.stages[-1], teff_model.stages[-1]], [mean, std], evaluate)
