"""Forests on a grid: every threshold of a forest is one of few candidates, so rows fall into a bounded number of cells.

Rows of one cell take the same way down every tree. A forest is therefore fitted from sums per cell and tree, and evaluated
once per cell. The number of cells follows from features and thresholds, never from the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.session import scratch_path

# Cells of a grid that a fit may have, and of one that is evaluated and broadcast.
FIT_CELLS, CELLS = 1 << 20, 1 << 18
# Points that describe the values of a feature in one task.
SUMMARY = 1024
# Rows whose bootstrap weights are drawn at a time, cells whose sums are returned at a time.
CHUNK, BLOCK = 2048, 16_384

SPLIT = "split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
NODE = f"treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,{SPLIT.replace(' ', ':', 1)}>"

# Thresholds by the uid of a model, so that a forest fitted here need not be read for them.
_known: dict[str, list[np.ndarray]] = {}


# ---- fit ----------------------------------------------------------------------------------------------------------

def fits(estimator: RandomForestRegressor, assembled: DataFrame, n_features: int) -> bool:
    """Whether ``fit`` can take the place of ``estimator.fit``: few features, none of them categorical, no weights."""
    categorical = "nominal" in json.dumps(assembled.schema["features"].metadata)
    return not estimator.isSet("weightCol") and not categorical and estimator.getMaxBins() ** n_features <= FIT_CELLS


def fit(estimator: RandomForestRegressor, assembled: DataFrame, n_features: int, tasks: int) -> RandomForestRegressionModel:
    """What ``estimator`` fits to ``features`` and its label column, in one pass over the rows instead of one per level.

    As in Spark ML, candidates lie at equal depths of each feature, each tree draws Poisson weights, and each node the
    features it may split. A row's weights follow from a number drawn for the row, so they do not depend on the tasks.
    """
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    rows = assembled.select(vector_to_array("features").alias("x"), F.col(estimator.getLabelCol()).cast("double").alias("y"))
    thresholds = candidates(rows, n_features, estimator.getMaxBins())
    dims = [len(t) + 1 for t in thresholds]
    binned = rows.withColumn("key", (F.rand(seed) * F.lit(float(1 << 53))).cast("long")).mapInArrow(_binner(thresholds, dims), "cell int, y double, key long")
    # Cells are dealt by ranges, large ones to several tasks; the sums of their parts are added when trees are grown.
    sums = binned.repartitionByRange(tasks, "cell", "key").mapInArrow(_summer(trees, seed), "tree int, cell array<int>, n array<double>, s array<double>, q array<double>")
    grow = _grower(thresholds, dims, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), subset_size(estimator.getFeatureSubsetStrategy(), n_features), seed)
    nodes = sums.repartition(trees, "tree").groupBy("tree").applyInArrow(grow, NODE)
    model = _assembled(estimator, nodes, n_features)
    _known[model.uid] = thresholds
    return model


def candidates(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Thresholds of each feature between ``bins`` parts of about equal depth, or between all its values if they are few."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b) for b in batches if b.num_rows]
        if parts:
            x = np.concatenate(parts)
            for f in range(n_features):
                values, counts = np.unique(x[:, f], return_counts=True)
                if len(values) > SUMMARY:
                    at = ((np.arange(SUMMARY) + 0.5) * len(x) / SUMMARY).astype(int)
                    values, counts = np.sort(x[:, f])[at], np.full(SUMMARY, len(x) / SUMMARY)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(counts.astype(float))], ["feature", "value", "weight"])

    def cut(table: pa.Table) -> pa.Table:
        found = equal_depth(table["value"].to_numpy(), table["weight"].to_numpy(), bins)
        return pa.table({"feature": pa.array([table["feature"][0].as_py()], pa.int32()), "thresholds": pa.array([found.tolist()], pa.list_(pa.float64()))})

    points = rows.mapInArrow(summary, "feature int, value double, weight double")
    found = points.groupBy("feature").applyInArrow(cut, "feature int, thresholds array<double>").collect()
    by = {r["feature"]: np.array(r["thresholds"], float) for r in found}
    return [by[f] for f in range(n_features)]


def equal_depth(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to equal depths."""
    values, inverse = np.unique(values, return_inverse=True)
    depth = np.cumsum(np.bincount(inverse, weights))
    at = np.arange(len(values) - 1)
    if len(values) > bins:
        at = np.unique(np.minimum(np.searchsorted(depth, depth[-1] * np.arange(1, bins) / bins), len(values) - 2))
    with np.errstate(invalid="ignore"):
        middle = values[at] / 2 + values[at + 1] / 2
    # Neighbours may have no number between them; -0 and 0 are one value.
    middle = np.where(middle < values[at + 1], middle, values[at]) + 0.0
    return np.unique(middle[np.isfinite(middle)])


def subset_size(strategy: str, n_features: int) -> int:
    """Features a node may split, as Spark ML reads the setting."""
    named = {"all": n_features, "auto": math.ceil(n_features / 3), "onethird": math.ceil(n_features / 3), "sqrt": math.ceil(math.sqrt(n_features)),
             "log2": max(1, math.ceil(math.log2(n_features)))}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), n_features) if strategy.isdigit() else math.ceil(float(strategy) * n_features)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _binner(thresholds: list[np.ndarray], dims: list[int]) -> Callable:
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch["y"].to_numpy(zero_copy_only=False)
            if batch["y"].null_count or np.isnan(y).any():
                raise ValueError("targets must not be null or NaN")
            x = _matrix(batch)
            cell = np.ravel_multi_index([np.searchsorted(t, x[:, f], "left") for f, t in enumerate(thresholds)], dims)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["y"], batch["key"]], ["cell", "y", "key"])

    return binned


def bootstrap(key: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Poisson weights of mean 1, for each key and tree."""
    mix = lambda z: _mixed(_mixed(z, 30, 0xBF58476D1CE4E5B9), 27, 0x94D049BB133111EB)
    step = mix((np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed % (1 << 32)) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15))
    z = mix(mix(key.astype(np.uint64))[:, None] ^ step[None, :])
    z = ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    chance, total, out = math.exp(-1), 0.0, np.zeros(z.shape, np.uint8)
    for k in range(1, 14):
        total += chance
        chance /= k
        if total * 2**32 < 2**32 - 1:
            out += z >= np.uint32(total * 2**32)
    return out


def _mixed(z: np.ndarray, shift: int, factor: int) -> np.ndarray:
    return (z ^ (z >> np.uint64(shift))) * np.uint64(factor)


def _summer(trees: int, seed: int) -> Callable:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        cell, y, key = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in parts]) for c in ("cell", "y", "key"))
        order = np.lexsort((key, cell))
        cell, y, key = cell[order], y[order], key[order]
        runs = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for b in range(0, len(runs) - 1, BLOCK):
            starts = runs[b:b + BLOCK + 1]
            out = np.zeros((3, len(starts) - 1, trees))
            for lo in range(starts[0], starts[-1], CHUNK):
                hi = min(lo + CHUNK, starts[-1])
                first = np.searchsorted(starts, lo, "right") - 1
                last = np.searchsorted(starts, hi, "left")
                at = np.maximum(starts[first:last], lo) - lo
                w = bootstrap(key[lo:hi], trees, seed).astype(float)
                for part in out:
                    part[first:last] += np.add.reduceat(w, at, axis=0)
                    w *= y[lo:hi, None]
            yield _by_tree(cell[starts[:-1]], out)

    return summed


def _by_tree(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    drawn = [np.flatnonzero(n) for n in sums[0].T]
    offsets = pa.array(np.append(0, np.cumsum([len(d) for d in drawn])).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))
    columns = [listed([part[d, t] for t, d in enumerate(drawn)]) for part in sums]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(drawn), dtype=np.int32)), listed([cells[d] for d in drawn]), *columns], ["tree", "cell", "n", "s", "q"])


def _grower(thresholds: list[np.ndarray], dims: list[int], depth: int, least: int, subset: int, seed: int) -> Callable:
    def grow(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        values = [np.concatenate([chunk.flatten().to_numpy() for chunk in table[c].chunks]) for c in ("cell", "n", "s", "q")]
        cells, inverse = np.unique(values[0], return_inverse=True)
        n, s, q = (np.bincount(inverse, v) for v in values[1:])
        return _table(tree, grown(np.array(np.unravel_index(cells, dims)), dims, n, s, q, depth, least, subset, np.random.default_rng([seed % (1 << 32), tree])), thresholds)

    return grow


def grown(bins: np.ndarray, dims: Sequence[int], n: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int, least: int, subset: int,
          rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One regression tree over cells: ``bins`` are their bins by feature; ``n``, ``s``, ``q`` weights and sums of y and y².

    A node is split where the variance falls most, if each side keeps ``least`` rows. Nodes are numbered level by level.
    """
    mean, out, first = s.sum() / n.sum(), [], 0
    c = s - n * mean  # sums about the mean, as differences of large squares lose digits
    d = q - 2 * mean * s + mean * mean * n
    node = np.zeros(len(n), np.int64)
    for level in range(depth + 1):
        a = int(node.max()) + 1 if len(node) else 0
        if not a:
            break
        nn, cc, dd = (np.bincount(node, v, a) for v in (n, c, d))
        spread = np.maximum(dd - cc * cc / nn, 0)
        gain, feature, cut = np.full(a, -np.inf), np.full(a, -1), np.full(a, -1)
        if level < depth:
            allowed = rng.random((a, len(dims))).argsort(axis=1) < subset
            for f, size in enumerate(dims):
                if size < 2:
                    continue
                at = node * size + bins[f]
                ln, lc = (np.cumsum(np.bincount(at, v, a * size).reshape(a, size), axis=1)[:, :-1] for v in (n, c))
                rn, rc = nn[:, None] - ln, cc[:, None] - lc
                value = lc * lc / np.maximum(ln, 1) + rc * rc / np.maximum(rn, 1)
                value[~(allowed[:, f, None] & (ln >= least) & (rn >= least))] = -np.inf
                j = value.argmax(axis=1)
                value = value[np.arange(a), j] - cc * cc / nn
                better = value > gain
                gain[better], feature[better], cut[better] = value[better], f, j[better]
        split = (gain > 1e-12 * spread) & (spread > 1e-16 * nn)
        rank = np.cumsum(split) - 1
        left = np.where(split, first + a + 2 * rank, -1)
        out.append((nn, cc / nn + mean, spread / nn, np.where(split, gain / nn, -1.0), left, np.where(split, feature, -1), cut))
        first += a
        stays = split[node]
        node, bins, n, c, d = node[stays], bins[:, stays], n[stays], c[stays], d[stays]
        node = 2 * rank[node] + (bins[feature[node], np.arange(len(node))] > cut[node])
    return dict(zip(("n", "mean", "impurity", "gain", "left", "feature", "cut"), map(np.concatenate, zip(*out))))


def _table(tree: int, t: dict[str, np.ndarray], thresholds: list[np.ndarray]) -> pa.Table:
    """Nodes as Spark ML stores them."""
    size, inner = len(t["n"]), t["feature"] >= 0
    widths = np.cumsum([0] + [len(x) for x in thresholds])[:-1]
    at = widths[t["feature"][inner]] + t["cut"][inner]
    i32, ends = (lambda v: pa.array(v.astype(np.int32))), np.append(0, np.cumsum(inner)).astype(np.int32)
    split = pa.StructArray.from_arrays([i32(t["feature"]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(thresholds)[at])), i32(np.full(size, -1))],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = np.stack([t["n"], t["n"] * t["mean"], t["n"] * (t["impurity"] + t["mean"] ** 2)], axis=1)
    stats = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * size + 1, 3, dtype=np.int32)), pa.array(stats.ravel()))
    right = np.where(inner, t["left"] + 1, -1)
    columns = {"id": i32(np.arange(size)), "prediction": pa.array(t["mean"]), "impurity": pa.array(t["impurity"]), "impurityStats": stats, "rawCount": pa.array(t["n"].astype(np.int64)),
               "gain": pa.array(t["gain"]), "leftChild": i32(t["left"]), "rightChild": i32(right), "split": split}
    return pa.table({"treeID": pa.array(np.full(size, tree, np.int32)), "nodeData": pa.StructArray.from_arrays(list(columns.values()), list(columns))})


def _assembled(estimator: RandomForestRegressor, nodes: DataFrame, n_features: int) -> RandomForestRegressionModel:
    """A model of Spark ML: the stored form of a forest fitted to two rows, with ``nodes`` for its own."""
    spark, path, stub = nodes.sparkSession, scratch_path(nodes.sparkSession, "forest"), scratch_path(nodes.sparkSession, "stub")
    value = F.col("id").cast("double")
    two = spark.range(0, 2, 1, 1).select(array_to_vector(F.array(*[value] * n_features)).alias("features"), value.alias(estimator.getLabelCol()))
    estimator.fit(two).save(stub)
    nodes.write.parquet(f"{path}/data")
    spark.read.parquet(f"{stub}/treesMetadata").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.read.text(f"{stub}/metadata").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)


# ---- evaluation ---------------------------------------------------------------------------------------------------

def known(model) -> bool:
    """Whether the forest was fitted here."""
    return model.uid in _known


def thresholds_of(model) -> list[np.ndarray] | None:
    """Thresholds of a forest by feature; none if a feature is categorical."""
    if model.uid not in _known:
        from pyspark.sql import SparkSession

        path = scratch_path(spark := SparkSession.active(), "forest")
        model.save(path)
        split = spark.read.parquet(f"{path}/data").select("nodeData.split.*").where("featureIndex >= 0").distinct().collect()
        if any(r["numCategories"] != -1 for r in split):
            return None
        _known[model.uid] = [np.unique(np.array([r[1][0] for r in split if r[0] == f], float) + 0.0) for f in range(model.numFeatures)]
    return _known[model.uid]


def by_cell(df: DataFrame, assembler, thresholds: list[np.ndarray], added: Sequence[str], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns ``added`` that ``evaluate`` adds, evaluated once per cell of the grid and looked up by row.

    ``evaluate`` may depend on a row's cell only. Its table has a bounded number of cells and is broadcast.
    """
    names, spark = assembler.getInputCols(), df.sparkSession
    dims = [len(t) + 1 for t in thresholds]
    cells, stride = math.prod(dims), np.append(np.cumprod(dims[::-1])[::-1][1:], 1).astype(int)
    # A threshold lies in the cell below it, the next number in the one above.
    inside = [[*t, math.nextafter(t[-1], math.inf)] if len(t) else [0.0] for t in thresholds]
    grid = spark.range(0, cells, 1, 1 + cells // 4096).withColumnRenamed("id", "_cell")
    place = lambda f: (F.floor(F.col("_cell") / F.lit(int(stride[f]))) % dims[f]).cast("int")
    grid = grid.withColumns({n: F.get(F.lit([float(v) for v in inside[f]]), place(f)) for f, n in enumerate(names)})
    table = evaluate(grid).select("_cell", *[F.col(f"`{c}`") for c in added])
    cut = [f for f, t in enumerate(thresholds) if len(t)]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    rows = assembler.transform(df).withColumn("_x", vector_to_array("features")).select(*kept, *[(-F.get("_x", F.lit(f))).alias(f"_low_{f}") for f in cut])
    # Buckets hold their lower end, so both sides are negated: a cell holds its upper end.
    splits = [[-math.inf, *(-thresholds[f][::-1]).tolist(), math.inf] for f in cut]
    rows = Bucketizer(splitsArray=splits, inputCols=[f"_low_{f}" for f in cut], outputCols=[f"_bin_{f}" for f in cut], handleInvalid="error").transform(rows)
    cell = sum(((F.lit(dims[f] - 1) - F.col(f"_bin_{f}").cast("long")) * F.lit(int(stride[f])) for f in cut), F.lit(0).cast("long"))
    return rows.select(*kept, cell.alias("_cell")).join(F.broadcast(table), "_cell").select(*[F.col(f"`{c}`") for c in [*df.columns, *(a for a in added if a not in df.columns)]])
