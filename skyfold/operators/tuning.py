"""Hyper-parameter search: every candidate is a Spark fit, every result a row of the trial table."""

from __future__ import annotations

import hashlib
import json
import logging
import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.mixture import with_mixture_scores
from skyfold.operators.forests import FITTERS, MAX_DEPTH, predict, tree_predictions
from skyfold.operators.mixture_fit import fit_mixtures
from skyfold.operators.sampling import fixed_size_sample, sample_key, split, stratified_sample
from skyfold.session import stored

log = logging.getLogger(__name__)

# Default search ranges per kind of model: low, high, step of whole numbers, or the values themselves.
SPACES = {
    "forest": {"n_estimators": [100, 1000, 50], "max_depth": [5, MAX_DEPTH, 1], "min_samples_split": [2, 20, 1],
               "min_samples_leaf": [1, 10, 1], "max_features": ["sqrt", "log2", None]},
    "boosting": {"n_estimators": [100, 1000, 50], "max_depth": [3, 12, 1], "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2],
                 "subsample": [0.6, 0.7, 0.8, 0.9, 1.0], "column_share": [0.6, 0.7, 0.8, 0.9, 1.0], "min_child_weight": [1, 10, 1]},
}
TRIALS = "number int, value double, duration_s double, train double, val double, gap double"
COLUMN_TYPES = {int: "int", float: "double", str: "string"}


def trial_schema(space: Mapping[str, Sequence]) -> str:
    """Columns of the trial table: the scores, then one for each parameter."""
    kinds = {name: next((COLUMN_TYPES[type(v)] for v in values if v is not None), "string") for name, values in space.items()}
    return ", ".join([TRIALS, *(f"{name} {kind}" for name, kind in kinds.items())])


def choices(space: Mapping[str, Sequence] | None = None, backend: str = "forest") -> dict[str, list]:
    """Every allowed value per parameter; ``[low, high]`` and ``[low, high, step]`` of integers are ranges."""
    out = {}
    unknown = set(space or ()) - set(SPACES[backend])
    if unknown:
        raise ValueError(f"{backend} has no parameters {sorted(unknown)}")
    for name, values in {**SPACES[backend], **(space or {})}.items():
        values = list(values)
        if name != "max_features" and len(values) in (2, 3) and all(isinstance(v, int) for v in values):
            step = values[2] if len(values) == 3 else 50 if name == "n_estimators" else 1
            values = list(range(values[0], values[1] + 1, max(step, 1)))
        out[name] = values
    return out


def candidates(n: int, space: Mapping[str, Sequence] | None = None, seed: int = 42, backend: str = "forest") -> list[dict]:
    rng, allowed = random.Random(seed), choices(space, backend)
    return [{name: rng.choice(values) for name, values in allowed.items()} for _ in range(n)]


def penalised(trials: DataFrame, weight: float) -> DataFrame:
    """Validation score plus ``weight`` times the gap between training and validation."""
    gap = F.abs(F.col("train") - F.col("val"))
    return trials.withColumn("gap", gap).withColumn("objective", F.col("val") + F.lit(weight) * F.col("gap"))


def _mae(model, rows: DataFrame, target: str) -> dict[str, float]:
    """Mean absolute error per inner split, from one pass."""
    scored = predict(model, rows).groupBy("split").agg(F.avg(F.abs(F.col("prediction") - F.col(target))).alias("e"))
    return {r["split"]: r["e"] for r in scored.collect()}  # two rows


def mean_crps(model, rows: DataFrame, target: str, components: int = 5, max_iter: int = 200) -> float:
    """Mean CRPS of mixtures fitted to each row's tree predictions."""
    fitted = fit_mixtures(tree_predictions(model, rows), "tree_preds", components, max_iter)
    return with_mixture_scores(fitted, target).agg(F.avg("crps")).first()[0]


def search(train: DataFrame, features: Sequence[str], target: str, *, key: str = "source_id", n_trials: int = 50,
           space: Mapping[str, Sequence] | None = None, objective: str = "mae", overfit_penalty: float = 0.0,
           patience: int | None = None, timeout: float | None = None, max_samples: int | None = None,
           strata: Sequence[str] = (), weight: str | None = None, components: int = 5, crps_subsample: int | None = None,
           parallelism: int = 4, seed: int = 42, backend: str = "forest") -> tuple[dict, DataFrame]:
    """Random search on an inner 80/20 split. Returns the best parameters and the trial table.

    Trials run ``parallelism`` at a time; the search stops once ``patience`` trials in a row bring no better value. All
    trials read one stored table. The CRPS needs a forest: boosted trees are no sample of predictions.
    """
    if objective not in ("mae", "crps"):
        raise ValueError(f"unknown objective {objective!r}")
    if objective == "crps" and backend != "forest":
        raise ValueError("the CRPS objective needs a forest")
    spark = train.sparkSession
    columns = list(dict.fromkeys([key, *features, target, *strata, *([weight] if weight else [])]))
    rows = train.select(*columns).na.drop(subset=[*features, target])
    if max_samples:
        rows = stratified_sample(rows, max_samples, strata, key, seed) if strata else fixed_size_sample(rows, max_samples, key, seed)
    inner = stored(split(rows, key, 0.2, seed, strata), "inner")
    fit_rows = inner.where("split = 'train'")
    sides = {}
    if objective == "crps":
        wanted = ("train", "test") if overfit_penalty else ("test",)
        sides = {s: inner.where(F.col("split") == s) for s in wanted}
        if crps_subsample:  # opt-in: by default every row is scored
            sides = {s: stored(fixed_size_sample(df, crps_subsample, key, seed), s) for s, df in sides.items()}

    def run(number: int, params: dict) -> tuple:
        start = time.monotonic()
        model = FITTERS[backend](fit_rows, features, target, seed=seed, weight=weight, **params)
        if objective == "mae":
            scores = _mae(model, inner, target)
        else:
            scores = {s: mean_crps(model, df, target, components) for s, df in sides.items()}
        val, tr = scores["test"], scores.get("train")
        gap = abs(tr - val) if tr is not None else None
        value = val + overfit_penalty * gap if overfit_penalty else val
        return (number, value, time.monotonic() - start, tr, val, gap, *params.values())

    plan, done, begun = candidates(n_trials, space, seed, backend), [], time.monotonic()
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        for at in range(0, n_trials, parallelism):
            batch = range(at, min(at + parallelism, n_trials))
            done += list(pool.map(lambda i: run(i, plan[i]), batch))
            best = min(done, key=lambda t: t[1])
            if patience is not None and done[-1][0] - best[0] >= patience:
                log.info("no better value for %s trials", patience)
                break
            if timeout is not None and time.monotonic() - begun > timeout:
                break
    return plan[min(done, key=lambda t: t[1])[0]], spark.createDataFrame(done, trial_schema(choices(space, backend)))


def halving_search(train: DataFrame, features: Sequence[str], target: str, *, key: str = "source_id",
                   n_candidates: int = 9, factor: int = 3, cv: int = 3, min_resources: int | None = None,
                   space: Mapping[str, Sequence] | None = None, weight: str | None = None, parallelism: int = 4,
                   seed: int = 42, backend: str = "forest") -> tuple[dict, DataFrame]:
    """Successive halving: all candidates on few rows, the best ``1/factor`` of them on ``factor`` times as many.

    The samples are nested (a prefix of the key order), folds are a function of the id. All fits of a round read one
    stored sample, with the weights of its rows. Returns the best parameters and a table of every candidate's mean score
    per round.
    """
    fold = F.pmod(F.conv(F.substring(sample_key(key, seed), 1, 8), 16, 10).cast("long"), F.lit(cv)).cast("int")
    columns = list(dict.fromkeys([key, *features, target, *([weight] if weight else [])]))
    rows = stored(train.select(*columns).na.drop(subset=[*features, target]).withColumn("_fold", fold), "halving")
    total = rows.count()
    rounds = max(1, math.ceil(math.log(n_candidates, factor)) + 1)
    size = min_resources or max(cv * 10, total // factor ** (rounds - 1))
    alive = dict(enumerate(candidates(n_candidates, space, seed, backend)))
    history = []

    def score(sample: DataFrame, number: int, f: int) -> tuple[int, float]:
        model = FITTERS[backend](sample.where(F.col("_fold") != f), features, target, seed=seed, weight=weight, **alive[number])
        held = predict(model, sample.where(F.col("_fold") == f))
        return number, held.agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]

    for number in range(rounds):
        n = min(total, size * factor ** number)
        sample = rows if n >= total else stored(fixed_size_sample(rows, n, key, seed), "halving")
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            scores = list(pool.map(lambda job: score(sample, *job), [(c, f) for c in alive for f in range(cv)]))
        mean = {c: sum(s for i, s in scores if i == c) / cv for c in alive}
        history += [(number, n, c, m) for c, m in mean.items()]
        ranked = sorted(mean, key=mean.get)
        best = alive[ranked[0]]
        if len(ranked) == 1 or n >= total:
            break
        alive = {c: alive[c] for c in ranked[:max(1, len(ranked) // factor)]}
    return best, train.sparkSession.createDataFrame(history, "round int, n_rows long, candidate int, score double")


# ---- result cache ---------------------------------------------------------------------------------------------

def signature_column(columns: Sequence[str]) -> Column:
    """First 16 hex digits of the SHA-256 of ``name=value`` pairs in name order."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(columns)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def signature(settings: Mapping) -> str:
    """The same for one nested configuration: order of keys and of the feature list does not matter."""
    def canonical(value, name=""):
        if isinstance(value, Mapping):
            return {k: canonical(v, k) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            items = [canonical(v) for v in value]
            return sorted(items, key=str) if name in ("features", "encode_categorical", "stratify_columns") else items
        return value
    text = json.dumps(canonical(settings), sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


CACHE = "signature string, hyperparameters string, optimized_at timestamp, n_trials int"


def cached_parameters(spark: SparkSession, path: str, key: str) -> dict | None:
    """Parameters found earlier under this signature, newest first."""
    try:
        table = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return None
    row = table.where(F.col("signature") == key).agg(F.max_by("hyperparameters", "optimized_at").alias("h")).first()
    return json.loads(row["h"]) if row and row["h"] else None


def cache_parameters(spark: SparkSession, path: str, key: str, params: Mapping, n_trials: int) -> None:
    row = spark.createDataFrame([(key, json.dumps(params), n_trials)], "signature string, hyperparameters string, n_trials int")
    (row.select("signature", "hyperparameters", F.current_timestamp().alias("optimized_at"), "n_trials")
     .coalesce(1).write.mode("append").parquet(path))


def tuned_parameters(path: str, settings: Mapping, train: DataFrame, features: Sequence[str], target: str,
                     find: Callable[..., tuple[dict, DataFrame]] = search, **options) -> tuple[dict, bool]:
    """Parameters from the cache, or from a search that is then cached; tells whether the cache had them."""
    spark, key = train.sparkSession, signature(settings)
    known = cached_parameters(spark, path, key)
    if known:
        return known, True
    best, trials = find(train, features, target, **options)
    cache_parameters(spark, path, key, best, trials.count())
    return best, False
