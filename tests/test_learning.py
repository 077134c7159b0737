"""Learning jobs: invariants."""

import math
import uuid

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skyfold.functions.mixture import array_mean
from skyfold.operators import clustering, forest_grid, forests, tuning
from skyfold.plans import predict as predict_plan
from skyfold.plans import train as train_plan
from skyfold.plans import validate as validate_plan

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (1500, 3))
    x[:, 0] += np.repeat([0, 6, 12], 500)
    y = 5000 + 300 * x[:, 0] + 100 * np.sin(x[:, 1]) + rng.normal(0, 20, 1500)
    logg = 4 - 0.05 * x[:, 0]
    data = [(i, *map(float, v), float(t), float(g), "hot" if t > 7000 else "cool") for i, (v, t, g) in enumerate(zip(x, y, logg))]
    return spark.createDataFrame(data, "source_id long, a double, b double, c double, teff double, logg double, kind string").cache()


@pytest.fixture(scope="module")
def forest(rows):
    return forests.fit_forest(rows, FEATURES, "teff", n_estimators=7, max_depth=5)


def test_tree_array_mean_is_the_prediction(rows, forest):
    out = forests.tree_predictions(forest, rows).select("prediction", array_mean(F.col("tree_preds")).alias("m"), F.size("tree_preds").alias("n"))
    r = out.agg(F.max(F.abs(F.col("prediction") - F.col("m"))), F.min("n"), F.max("n")).first()
    assert r[0] < 1e-8 and (r[1], r[2]) == (7, 7)


def test_tree_predictions_are_those_of_each_tree(spark, rows, forest, monkeypatch):
    want = np.array([[t.predict(Vectors.dense([r.a, r.b, r.c])) for t in forest.stages[-1].trees] for r in rows.orderBy("source_id").limit(20).collect()])
    found = lambda: np.vstack(forests.tree_predictions(forest, rows).orderBy("source_id").limit(20).toPandas()["tree_preds"])
    assert np.allclose(found(), want)
    plan = forests.tree_predictions(forest, rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    monkeypatch.setattr(forests, "GROUP_TREES", 3)
    assert np.allclose(found(), want)
    monkeypatch.setattr(forests, "GROUP_NODES", 5)  # one tree a group, stored in between
    assert np.allclose(found(), want)


def test_fast_spread_scales_by_the_requested_number(rows, forest):
    trees = np.vstack(forests.tree_predictions(forest, rows).orderBy("source_id").toPandas()["tree_preds"])
    chosen = np.sort(np.random.default_rng(1).choice(7, 4, replace=False))
    fast = forests.fast_tree_spread(forest, rows, 4, seed=1).orderBy("source_id").toPandas()
    assert np.allclose(fast["uncertainty"], trees[:, chosen].std(axis=1) * math.sqrt(7 / 4))
    every = forests.fast_tree_spread(forest, rows, 28, seed=1).orderBy("source_id").toPandas()
    assert np.allclose(every["uncertainty"], trees.std(axis=1) * math.sqrt(7 / 28))


def test_chain_against_brute_force(spark, rows):
    train = rows.withColumn("y", F.log10("teff"))
    logg = forests.fit_forest(train, FEATURES, "logg", n_estimators=5, max_depth=4)
    teff = forests.fit_forest(train, [*FEATURES, "logg"], "y", n_estimators=6, max_depth=4)
    got = forests.chained_propagation(logg, teff, rows, seed=3).orderBy("source_id").toPandas()
    second = np.random.default_rng(3).integers(0, 6, size=5)
    gravity = np.vstack(forests.tree_predictions(logg, rows).orderBy("source_id").toPandas()["tree_preds"])
    base = rows.orderBy("source_id").toPandas()
    paths = []
    for j in range(5):
        step = spark.createDataFrame(base.assign(logg=gravity[:, j]))
        paths.append(np.vstack(forests.tree_predictions(teff, step).orderBy("source_id").toPandas()["tree_preds"])[:, second[j]])
    m, s = np.mean(paths, axis=0), np.std(paths, axis=0)
    assert np.allclose(got["teff_mean_k"], 10 ** m) and np.allclose(got["teff_std_k"], 10 ** m * s * math.log(10))
    sub = forests.chained_propagation(logg, teff, rows, n_logg=3, teff_in_log=False)
    assert sub.where("teff_std_k is null or teff_std_k < 0").count() == 0
    with pytest.raises(ValueError):
        forests.chained_propagation(teff, logg, rows)


@pytest.fixture
def on_grid(monkeypatch):
    monkeypatch.setattr(forests, "GRID_ROWS", 0)


def jobs(spark, work):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_fit_on_the_grid_makes_no_pass_per_level(spark, rows, on_grid):
    fit = lambda depth: forests.fit_forest(rows, FEATURES, "teff", n_estimators=5, max_depth=depth, min_samples_leaf=3)
    (low, few), (high, many) = jobs(spark, lambda: fit(3)), jobs(spark, lambda: fit(12))
    assert many <= few + 1
    trees = high.stages[-1].trees
    assert len(trees) == 5 and max(t.depth for t in trees) > 6 and low.stages[-1].trees[0].depth == 3
    error = lambda m: forests.predict(m, rows).select(F.sqrt(F.avg((F.col("prediction") - F.col("teff")) ** 2))).first()[0]
    assert error(high) < error(low) and error(high) < 200
    path = spark.sparkContext.getCheckpointDir() + "/kept-" + uuid.uuid4().hex
    high.save(path)
    kept = PipelineModel.load(path)
    assert kept.stages[-1].totalNumNodes == high.stages[-1].totalNumNodes and error(kept) == pytest.approx(error(high))


def test_each_node_of_the_grid_holds_the_sums_of_its_rows(spark, rows, on_grid):
    model = forests.fit_forest(rows, FEATURES, "teff", n_estimators=3, max_depth=4, max_features=None, min_samples_leaf=20)
    path = spark.sparkContext.getCheckpointDir() + "/nodes-" + uuid.uuid4().hex
    model.stages[-1].save(path)
    nodes = {(r[0], r[1]["id"]): r[1] for r in spark.read.parquet(path + "/data").collect()}
    for tree in range(3):
        root = nodes[tree, 0]
        assert 1300 < root["rawCount"] < 1700  # a bootstrap of 1500 rows
        for (t, _), n in nodes.items():
            if t == tree and n["leftChild"] >= 0:
                a, b = nodes[t, n["leftChild"]], nodes[t, n["rightChild"]]
                assert min(a["rawCount"], b["rawCount"]) >= 20
                assert np.allclose(np.add(a["impurityStats"], b["impurityStats"]), n["impurityStats"])
                lost = n["impurity"] * n["rawCount"] - a["impurity"] * a["rawCount"] - b["impurity"] * b["rawCount"]
                assert n["gain"] > 0 and n["gain"] * n["rawCount"] == pytest.approx(lost, rel=1e-6, abs=1e-3)


def test_a_tree_over_cells_splits_where_the_variance_falls_most():
    rng = np.random.default_rng(5)
    bins, n, y = rng.integers(0, 4, (2, 40)), rng.integers(1, 5, 40).astype(float), rng.normal(1e4, 1, 40)
    tree = forest_grid.grown(bins, [4, 4], n, n * y, n * y * y, 1, 1, 2, rng)
    spread = lambda at: n[at] @ (y[at] - np.average(y[at], weights=n[at])) ** 2
    best = min((spread(bins[f] <= b) + spread(bins[f] > b), f, b) for f in range(2) for b in range(3))
    assert (tree["feature"][0], tree["cut"][0]) == best[1:] and len(tree["n"]) == 3
    assert np.allclose(tree["mean"][1], np.average(y[bins[best[1]] <= best[2]], weights=n[bins[best[1]] <= best[2]]))


def test_candidates_lie_between_all_values_if_they_are_few():
    assert forest_grid.equal_depth(np.array([3.0, 1, 1, 2]), np.array([1.0, 1000, 1, 1]), 32).tolist() == [1.5, 2.5]
    cut = forest_grid.equal_depth(np.arange(10_000.0), np.ones(10_000), 4)
    assert np.allclose(cut, [2500, 5000, 7500], atol=2)


def test_rows_of_one_cell_are_evaluated_once(spark, rows, on_grid, monkeypatch):
    train = rows.withColumn("y", F.log10("teff"))
    few = {"n_estimators": 30, "max_depth": 9, "max_bins": 8}
    logg = forests.fit_forest(train, FEATURES, "logg", **few)
    teff = forests.fit_forest(train, [*FEATURES, "logg"], "y", **few)
    # Values on a threshold, beyond the last one, and both zeros.
    edge = [float(t) for t in forest_grid.thresholds_of(logg.stages[-1])[0]]
    odd = spark.createDataFrame([(i, v, -v, 0.0) for i, v in enumerate([*edge, *np.nextafter(edge, 99).tolist(), 1e300, -math.inf, math.inf, 0.0, -0.0])],
                                "source_id long, a double, b double, c double")
    table = rows.select("source_id", *FEATURES).unionAll(odd.withColumn("source_id", F.col("source_id") + 10_000)).unionAll(rows.limit(3).select("source_id", *FEATURES))
    calls = [lambda: forests.tree_predictions(logg, table), lambda: forests.predict(logg, table), lambda: forests.fast_tree_spread(logg, table, 7),
             lambda: forests.chained_propagation(logg, teff, table, seed=4), lambda: forests.chained_propagation(logg, teff, table, n_logg=3, teff_in_log=False)]
    for call in calls:
        found = call()
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(forest_grid, "CELLS", 0)
            want = call()
            assert "Join" not in want._jdf.queryExecution().executedPlan().toString()
        assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_a_forest_on_the_grid_refuses_missing_values(rows, on_grid):
    model = forests.fit_forest(rows, FEATURES, "teff", n_estimators=30, max_depth=9, max_bins=8)
    for hole in (F.lit(None).cast("double"), F.lit(math.nan)):
        for column in ("a", "teff"):
            with pytest.raises(Exception, match="(?i)null|nan"):
                forests.fit_forest(rows.withColumn(column, F.when(F.col("source_id") == 7, hole).otherwise(F.col(column))), FEATURES, "teff", n_estimators=2)
        with pytest.raises(Exception, match="(?i)null|nan"):
            forests.predict(model, rows.withColumn("a", F.when(F.col("source_id") == 7, hole).otherwise(F.col("a")))).collect()


def test_missing_feature_and_clamped_depth(rows, forest, caplog):
    with pytest.raises(ValueError):
        forests.predict(forest, rows.drop("b"))
    forests.fit_forest(rows.limit(50), FEATURES, "teff", n_estimators=1, max_depth=40, min_samples_split=5)
    assert "clamped" in caplog.text


def test_weights_travel_with_rows(rows):
    w = rows.withColumn("w", F.when(F.col("kind") == "hot", 1.0).otherwise(0.0))
    model = forests.fit_forest(w, FEATURES, "teff", n_estimators=3, max_depth=3, weight="w")
    assert forests.predict(model, w).agg(F.min("prediction")).first()[0] > 7000


def test_importance_order(spark, rows, forest):
    out = [r["feature"] for r in forests.feature_importance(spark, forest, 2).collect()]
    assert len(out) == 2 and out[0] == "a"


@pytest.mark.parametrize("method,kind", [("kmeans", "full"), ("gmm", "full"), ("gmm", "tied"), ("gmm", "diag"), ("gmm", "spherical"), ("bayesian_gmm", "full"),
                                         ("bayesian_gmm", "tied"), ("bayesian_gmm", "diag"), ("bayesian_gmm", "spherical")])
def test_membership(rows, method, kind):
    k = 5 if method == "bayesian_gmm" else 3
    rows = rows.withColumn("d", F.col("a") + F.col("b") * 0.5)
    c = clustering.fit_clustering(rows, ["a", "d"], method, k, covariance_type=kind, max_iter=30)
    out = clustering.Clustering.from_dict(c.to_dict()).transform(rows)
    total = sum((F.col(p) for p in c.probability_names()), F.lit(0.0))
    low, high = out.agg(F.min(total), F.max(total)).first()
    assert low == pytest.approx(1.0) and high == pytest.approx(1.0)
    top = F.greatest(*c.probability_names())
    label = F.coalesce(*[F.when(F.col(p) == top, F.lit(i)) for i, p in enumerate(c.probability_names())])
    if method != "bayesian_gmm":  # three well separated clumps of 500
        pure = out.groupBy(F.floor(F.col("source_id") / 500).alias("clump"), label.alias("k")).count().where("count > 450").count()
        assert pure == 3
    else:
        assert 3 <= c.effective_clusters() <= 5


@pytest.mark.parametrize("method,kind", [("gmm", "tied"), ("gmm", "diag"), ("gmm", "spherical"), ("bayesian_gmm", "full"), ("bayesian_gmm", "tied")])
def test_the_best_of_several_starts_wins(rows, monkeypatch, method, kind):
    rows = rows.withColumn("d", F.col("a") + F.col("b") * 0.5)
    real, asked, passes = clustering._kmeans, [], []

    def starts(points, features, k, max_iter, n_init, seed):
        asked.append(seed)
        if seed == 42:  # a bad start: all centres in one place
            return np.array([[9.0, 9.0], [9.1, 9.1], [9.2, 9.2]]), None
        return real(points, features, k, max_iter, n_init, seed)
    counted = clustering._statistics
    monkeypatch.setattr(clustering, "_kmeans", starts)
    monkeypatch.setattr(clustering, "_statistics", lambda *a: passes.append(len(a[1])) or counted(*a))
    fit = lambda n: clustering.fit_clustering(rows, ["a", "d"], method, 3, covariance_type=kind, max_iter=8, n_init=n)
    alone = fit(1).log_likelihood
    assert asked == [42] and set(passes) == {1}
    asked.clear(), passes.clear()
    best = fit(3)
    assert asked == [42, 43, 44] and passes[0] == 3 and len(passes) <= 9  # one pass a round for all starts
    assert best.log_likelihood > alone + 0.01
    worse = clustering.fit_clustering(rows, ["a", "d"], method, 3, covariance_type=kind, max_iter=8, n_init=1, seed=43).log_likelihood
    assert best.log_likelihood >= worse - 1e-9


def test_kmeans_membership_formula(rows):
    c = clustering.fit_clustering(rows, ["a", "b"], "kmeans", 2)
    r = c.transform(rows).first()
    x = np.array([(r[f] - c.scaler["mean"][f]) / c.scaler["std"][f] for f in ("a", "b")])
    inv = 1 / (np.linalg.norm(np.array(c.means) - x, axis=1) + 1e-8)
    assert [r["cluster_prob_0"], r["cluster_prob_1"]] == pytest.approx((inv / inv.sum()).tolist())


def test_digamma():
    euler = 0.5772156649015329
    assert clustering._digamma(1.0) == pytest.approx(-euler, abs=1e-9)
    assert clustering._digamma(0.5) == pytest.approx(-euler - 2 * math.log(2), abs=1e-8)


SPACE = {"n_estimators": [2, 4, 2], "max_depth": [2, 4], "min_samples_leaf": [1, 3]}


def test_search_is_reproducible_and_penalised(rows):
    runs = [tuning.search(rows, FEATURES, "teff", n_trials=4, space=SPACE, overfit_penalty=0.5, max_samples=800, parallelism=p) for p in (1, 3)]
    a, b = (r[1].drop("duration_s").orderBy("number").collect() for r in runs)
    assert [(r["n_estimators"], r["max_depth"], r["min_samples_leaf"]) for r in a] == [(r["n_estimators"], r["max_depth"], r["min_samples_leaf"]) for r in b]
    assert runs[0][0] == runs[1][0]
    for r in a:
        assert r["value"] == pytest.approx(r["val"] + 0.5 * abs(r["train"] - r["val"]))


def test_search_stops_without_improvement(rows):
    _, trials = tuning.search(rows, FEATURES, "teff", n_trials=12, space={**SPACE, "n_estimators": [2, 2], "max_depth": [2, 2], "min_samples_leaf": [1, 1],
                                                                       "max_features": [None]}, patience=2, parallelism=1)
    assert trials.count() == 3


def test_crps_objective_and_halving(rows):
    best, trials = tuning.search(rows, FEATURES, "teff", n_trials=1, space=SPACE, objective="crps", components=2, crps_subsample=100, overfit_penalty=0.1)
    assert trials.first()["val"] > 0 and best["max_depth"] in (2, 3, 4)
    with pytest.raises(ValueError):
        tuning.search(rows, FEATURES, "teff", objective="r2")
    best, history = tuning.halving_search(rows, FEATURES, "teff", n_candidates=3, factor=3, cv=2, space=SPACE)
    per_round = {r["round"]: (r["count"]) for r in history.groupBy("round").count().collect()}
    assert per_round == {0: 3, 1: 1}
    assert set(best) == set(tuning.SPACES["forest"])


def test_signature_and_cache(spark, rows, tmp_path):
    a = {"data": {"target": "teff", "features": ["x", "y"]}, "n": 1}
    assert tuning.signature(a) == tuning.signature({"n": 1, "data": {"features": ["y", "x"], "target": "teff"}})
    assert tuning.signature(a) != tuning.signature({**a, "n": 2}) and len(tuning.signature(a)) == 16
    path = str(tmp_path / "cache")
    first, hit = tuning.tuned_parameters(path, a, rows, FEATURES, "teff", n_trials=2, space=SPACE)
    again, second = tuning.tuned_parameters(path, a, rows, FEATURES, "teff", n_trials=2, space=SPACE)
    assert (hit, second) == (False, True) and first == again


@pytest.mark.parametrize("how", ["expressions", "engineering"])
def test_prediction_replays_the_recipe(rows, how):
    config = {"target": "teff", "features": FEATURES, "target_transform": "log10", "model": {"n_estimators": 6, "max_depth": 5}, "mixture": {"k": 2}}
    if how == "expressions":
        config |= {"features": [*FEATURES, "mix"], "expressions": {"mix": "a + 2 * b"}}
    else:
        config |= {"feature_engineering": {"enabled": True, "colors": FEATURES}}
    out = train_plan.train_model(rows, config)
    assert out["metadata"]["recipe"]["engineering" if how == "engineering" else "expressions"] and set(out["metadata"]["metrics"]) == {"train", "test"}
    new = rows.withColumn("a", F.when(F.col("source_id") == 5, F.lit(float("nan"))).otherwise(F.col("a")))
    table = predict_plan.predict_catalog(new, out["model"], out["metadata"], target_name="teff")
    assert table.where("source_id = 5").count() == 0 and table.count() > 0.9 * rows.count()
    # Test scores and later predictions agree in value and spread.
    both = out["test"].select("source_id", "prediction", "uncertainty").join(table, "source_id")
    worst = both.select(F.max(F.abs(F.col("prediction") - F.col("teff_predicted"))), F.max(F.abs(F.col("uncertainty") - F.col("teff_uncertainty"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] < 1e-6 and worst[2] > 100


def test_sentinels_go_before_expressions(rows):
    config = {"target": "teff", "features": [*FEATURES, "mix"], "expressions": {"mix": "a + b"}, "model": {"n_estimators": 4, "max_depth": 4}, "mixture": {"k": 2}}
    out = train_plan.train_model(rows, config)
    bad = F.when(F.col("source_id") == 5, -999.0).when(F.col("source_id") == 6, float("nan")).otherwise(F.col("b"))
    table = predict_plan.predict_catalog(rows.withColumn("b", bad), out["model"], out["metadata"], target_name="teff", include=["b"])
    assert table.where("source_id in (5, 6)").count() == 0 and table.count() == rows.count() - 2
    # A column that is only carried along keeps its sentinel.
    kept = predict_plan.predict_catalog(rows.withColumn("logg", F.lit(-999.0)), out["model"], out["metadata"], target_name="teff", include=["logg"])
    assert kept.where("logg = -999").count() == rows.count()


def test_boosting_is_tuned_and_predicts_without_spread(rows):
    space = {"n_estimators": [2, 4, 2], "max_depth": [2, 3], "subsample": [0.8], "min_child_weight": [1, 200, 199]}
    config = {"target": "teff", "features": FEATURES, "backend": "boosting"}
    for tuning_options in ({"n_trials": 2, "space": space}, {"method": "halving", "n_candidates": 2, "cv": 2, "space": space}):
        out = train_plan.train_model(rows, config | {"tuning": tuning_options})
        assert set(out["metadata"]["hyperparameters"]) == set(tuning.SPACES["boosting"])
        table = predict_plan.predict_catalog(rows, out["model"], out["metadata"], target_name="teff")
        assert table.columns == ["source_id", "teff_predicted"] and table.count() == rows.count()
    _, trials = tuning.search(rows, FEATURES, "teff", n_trials=2, space=space, backend="boosting")
    assert {"learning_rate", "column_share"} <= set(trials.columns)
    with pytest.raises(ValueError):
        tuning.search(rows, FEATURES, "teff", objective="crps", backend="boosting")
    with pytest.raises(ValueError):
        tuning.search(rows, FEATURES, "teff", space={"min_samples_leaf": [1]}, backend="boosting")


def test_booster_parameters_reach_the_model(rows):
    stage = forests.fit_boosting(rows, FEATURES, "teff", n_estimators=1, max_depth=2, column_share=0.5, min_child_weight=7.5).stages[-1]
    assert (stage.getFeatureSubsetStrategy(), stage.getMinInstancesPerNode(), stage.getSubsamplingRate()) == ("0.5", 8, 0.9)
    assert forests.fit_forest(rows, FEATURES, "teff", n_estimators=1, max_depth=2, min_samples_split=9).stages[-1].getMinInstancesPerNode() == 5


def test_halving_uses_weights(rows):
    # Rows with weight 0 are wrong by far: a search that ignores weights sees larger errors.
    spoiled = rows.withColumn("w", F.when(F.col("source_id") % 3 > 0, 1.0).otherwise(0.0)).withColumn("y", F.when(F.col("w") > 0, F.col("teff")).otherwise(F.col("teff") + 1e5))
    options = {"n_candidates": 2, "cv": 2, "space": {**SPACE, "max_features": [None]}}
    with_weights = tuning.halving_search(spoiled, FEATURES, "y", weight="w", **options)[1].agg(F.min("score")).first()[0]
    without = tuning.halving_search(spoiled, FEATURES, "y", **options)[1].agg(F.min("score")).first()[0]
    assert with_weights < without - 1e3
    captured = []
    original = tuning.halving_search
    train_plan.tuning.halving_search = lambda *a, **k: captured.append(k) or original(*a, **k)
    try:
        train_plan.train_model(rows.withColumn("w", F.lit(1.0)), {"target": "teff", "features": FEATURES, "sample_weight": "w", "mixture": {"k": 2},
                                                                  "tuning": {"method": "halving", "n_candidates": 2, "cv": 2, "space": SPACE}})
    finally:
        train_plan.tuning.halving_search = original
    assert captured[0]["weight"] == "w"


def test_training_remembers_what_a_search_found(rows, tmp_path, monkeypatch):
    config = {"target": "teff", "features": FEATURES, "mixture": {"k": 2}, "tuning": {"n_trials": 1, "space": SPACE, "cache": str(tmp_path / "cache")}}
    first = train_plan.train_model(rows, config)
    assert first["metadata"]["tuning_cached"] is False

    def no_search(*_, **__):
        raise AssertionError("searched again")
    monkeypatch.setattr(tuning, "search", no_search)
    again = train_plan.train_model(rows, config)
    assert again["metadata"]["tuning_cached"] is True and again["metadata"]["hyperparameters"] == first["metadata"]["hyperparameters"]
    with pytest.raises(AssertionError):
        train_plan.train_model(rows, config | {"target_transform": "log10"})


def test_backends_and_search_methods(rows):
    base = {"target": "teff", "features": FEATURES}
    out = train_plan.train_model(rows, base | {"backend": "boosting", "model": {"n_estimators": 3, "max_depth": 3}})
    assert out["metadata"]["backend"] == "boosting" and "uncertainty" not in out["test"].columns and out["test"].count() > 100
    out = train_plan.train_model(rows, base | {"mixture": {"k": 2}, "tuning": {"method": "halving", "n_candidates": 2, "cv": 2, "space": SPACE}})
    assert out["metadata"]["hyperparameters"]["max_depth"] in (2, 3, 4)


def test_train_predict_validate(spark, rows, tmp_path):
    from skyfold.sources import artifacts
    from skyfold.streaming import score_stream
    config = {"target": "teff", "features": [*FEATURES, "kind"], "target_transform": "log10", "encode": ["kind"],
              "clustering": {"method": "kmeans", "n_clusters": 3}, "split": {"stratify_bins": 4, "categories": ["kind"]},
              "expressions": {"ab": "a * b"}, "filters": {"a": [-10.0, 20.0]}, "mixture": {"k_max": 2},
              "model": {"n_estimators": 8, "max_depth": 6}}
    out = train_plan.train_model(rows, config)
    m = {r["split"]: r for r in out["metrics"].collect()}
    assert m["train"]["r2"] > 0.98 and m["test"]["r2"] > 0.97 and m["test"]["n_samples"] == pytest.approx(300, abs=5)
    scored = out["test"].agg(F.min("crps"), F.avg("pit"), F.min("uncertainty")).first()
    assert scored[0] > 0 and 0.2 < scored[1] < 0.8 and scored[2] >= 0
    path = artifacts.save_model(spark, out["model"], str(tmp_path), "rf_teff", out["metadata"])
    model, meta = artifacts.load_model(spark, path)
    new = rows.withColumn("a", F.when(F.col("source_id") == 3, -999.0).otherwise(F.col("a")))
    table = predict_plan.predict_catalog(new, model, meta, rules={"kind_ne": "hot"}, target_name="teff", include=["logg", "gone"])
    assert table.columns == ["source_id", "teff_predicted", "teff_uncertainty", "logg"]
    assert table.where("source_id = 3").count() == 0 and 4000 < table.agg(F.avg("teff_predicted")).first()[0] < 7000
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()

    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, meta, str(tmp_path / "out"), str(tmp_path / "ck"), rules={"kind_ne": "hot"}, target_name="teff",
                 include=["logg"]).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == table.count() and got.exceptAll(table).count() == 0

    stored = out["test"].withColumnsRenamed({"teff": "y_true", "prediction": "y_pred"})
    stored.write.parquet(str(tmp_path / "test"))
    report = validate_plan.validation_report(spark.read.parquet(str(tmp_path / "test")))
    assert set(report) == {"metrics", "bins", "rmse_curve", "pit", "crps", "density_map"}
    assert report["metrics"].first()["mae"] == pytest.approx(m["test"]["mae"], rel=1e-9)


def test_forest_rows_are_dealt_by_their_number(rows, forest, monkeypatch):
    seen = []
    real = forests._fit
    monkeypatch.setattr(forests, "_fit", lambda estimator, train, *rest: seen.append((estimator, train)) or real(estimator, train, *rest))
    monkeypatch.setattr(forests, "FIT_ROWS", 400)
    model = forests.fit_forest(rows.coalesce(1), FEATURES, "teff", n_estimators=3, max_depth=4)
    estimator, train = seen[0]
    assert estimator.getCacheNodeIds()
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1500 and max(sizes) < 400
    assert model.stages[-1].getNumTrees == 3


def test_dealt_keeps_every_row(spark):
    rows = spark.range(900).selectExpr("nullif(id % 3, 0) AS x").coalesce(1)
    out = forests.dealt(rows, 100)
    assert out.rdd.getNumPartitions() == 10
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.collect()))
    assert forests.dealt(rows.limit(0), 100).count() == 0
