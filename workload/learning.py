"""Learning jobs. Fits differ between engines, so their SQL twins state invariants: sizes, ranges, sums."""

from pyspark.sql import functions as F

from skyfold.operators import clustering, forests, mixture_fit, sampling, tuning
from skyfold.plans import predict as predict_plan
from skyfold.plans import train as train_plan
from skyfold.plans import validate as validate_plan
from skyfold.functions import mixture as mx
from skyfold.functions.mixture import with_mixture_scores
from skyfold.session import stored
from workload.columns import colours
from skyfold.constants import TARGET_EDGES, TARGET_LABELS
from workload.standin import query
from workload.statistics import neat, sql_bins

FEATURES = ["bp_rp", "g_bp", "g_rp"]
SMALL = {"n_estimators": 10, "max_depth": 6}
FULL = {"n_estimators": 100, "max_depth": 15}


def rows(t):
    return colours(t).where("teff_gaia > 0")


def logg_rows(t):
    return colours(t).where("teff_gaia > 0 and logg_gaia > 0")


def checked_membership(c, df):
    """Memberships lie between 0 and 1 and add to 1."""
    parts = [F.col(n) for n in c.probability_names()]
    inside = F.array_min(F.array(*parts)) >= 0
    return c.transform(df).select("source_id", (F.abs(sum(parts[1:], parts[0]) - 1) < 1e-9).alias("total"), inside.alias("within"))


STARS = "SELECT source_id, TRUE AS total, TRUE AS within FROM v_catalog WHERE teff_gaia > 0"


@query("m5_kmeans_membership", STARS)
def _(t):
    return checked_membership(clustering.fit_clustering(rows(t), FEATURES, "kmeans", 4), rows(t))


@query("m6_gmm_membership", STARS)
def _(t):
    return checked_membership(clustering.fit_clustering(rows(t), FEATURES[:2], "gmm", 3, max_iter=20), rows(t))


@query("m6_gmm_membership_tied", STARS)
def _(t):
    return checked_membership(clustering.fit_clustering(rows(t), FEATURES[:2], "gmm", 3, covariance_type="tied", max_iter=30, n_init=3), rows(t))


@query("m6_mixture_starts", "SELECT shape, TRUE AS best FROM (VALUES ('tied'), ('diag'), ('spherical')) v(shape)")
def _(t):
    # Of several starts the likeliest is kept: at least as likely as the first alone.
    def likelihood(shape, n):
        return clustering.fit_clustering(rows(t), FEATURES[:2], "gmm", 3, covariance_type=shape, max_iter=5, n_init=n).log_likelihood
    shapes = [(s, likelihood(s, 3) >= likelihood(s, 1) - 1e-9) for s in ("tied", "diag", "spherical")]
    return t.spark.createDataFrame(shapes, "shape string, best boolean")


@query("m7_bayesian_membership", STARS)
def _(t):
    return checked_membership(clustering.fit_clustering(rows(t), FEATURES[:2], "bayesian_gmm", 4, max_iter=50), rows(t))


@query("m7_bayesian_membership_diag", STARS)
def _(t):
    return checked_membership(clustering.fit_clustering(rows(t), FEATURES[:2], "bayesian_gmm", 4, covariance_type="diag", max_iter=30, n_init=2), rows(t))


@query("m8_saved_clustering", "SELECT source_id, TRUE AS total, TRUE AS within FROM v_catalog")
def _(t):
    saved = clustering.fit_clustering(rows(t), FEATURES, "kmeans", 3).to_dict()
    return checked_membership(clustering.Clustering.from_dict(saved), colours(t))


# Targets of the catalog lie between these; so do averages of them.
COOLEST, HOTTEST = 2500, 50000
WITHIN = "SELECT source_id, TRUE AS within FROM v_catalog"


def within(df, column="prediction"):
    return df.select("source_id", F.col(column).between(COOLEST, HOTTEST).alias("within"))


@query("m9_forest_fit", WITHIN)
def _(t):
    model = forests.fit_forest(rows(t), FEATURES, "teff_gaia", **FULL)
    return within(forests.predict(model, colours(t)))


@query("m10_boosting_fit", WITHIN)
def _(t):
    # Boosted sums may leave the range of the targets by little.
    model = forests.fit_boosting(rows(t), FEATURES, "teff_gaia", n_estimators=20, max_depth=5)
    return forests.predict(model, colours(t)).select("source_id", F.col("prediction").between(0, 2 * HOTTEST).alias("within"))


@query("m11_batch_prediction", WITHIN + " WHERE teff_gaia < 0")
def _(t):
    model = forests.fit_forest(rows(t), FEATURES, "teff_gaia", **SMALL)
    return within(forests.predict(model, colours(t).where("teff_gaia < 0")))


SPLIT_SIZES = """WITH n AS (SELECT count(*) AS n, round(2e-1*count(*))::BIGINT AS test FROM v_catalog WHERE teff_gaia > 0)
 SELECT 'test' AS split, test AS n_samples, TRUE AS consistent FROM n UNION ALL SELECT 'train', n-test, TRUE FROM n"""


def metric_rows(df):
    return df.select("split", "n_samples", ((F.col("mae") > 0) & (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1)).alias("consistent"))


@query("m12_train_test_evaluation", SPLIT_SIZES)
def _(t):
    both = sampling.split(rows(t)).withColumn("_y", F.log10("teff_gaia"))
    model = forests.fit_forest(both.where("split = 'train'"), FEATURES, "_y", **SMALL)
    return metric_rows(train_plan.evaluate(model, both, "teff_gaia", "log10"))


@query("m13_sample_weights", WITHIN + " WHERE teff_gaia > 0")
def _(t):
    weighted = rows(t).withColumn("w", F.lit(1.0) + F.col("teff_gspphot_flag"))
    model = forests.fit_forest(weighted, FEATURES, "teff_gaia", weight="w", **SMALL)
    return within(forests.predict(model, weighted))


SPACE = {"n_estimators": [5, 10, 5], "max_depth": [3, 5], "min_samples_leaf": [1, 4]}


@query("m14_random_search", "SELECT number::INT AS number, TRUE AS consistent, TRUE AS allowed FROM range(6) t(number)")
def _(t):
    trials = tuning.search(rows(t), FEATURES, "teff_gaia", n_trials=6, space=SPACE, overfit_penalty=0.5)[1]
    consistent = (F.abs(F.col("gap") - F.abs(F.col("train") - F.col("val"))) < 1e-6) & (F.abs(F.col("value") - F.col("val") - F.col("gap") / 2) < 1e-6)
    allowed = F.col("n_estimators").isin(5, 10) & F.col("max_depth").between(3, 5) & F.col("min_samples_leaf").between(1, 4)
    return trials.select("number", consistent.alias("consistent"), allowed.alias("allowed"))


@query("m14_boosting_search", "SELECT number::INT AS number, TRUE AS allowed FROM range(3) t(number)")
def _(t):
    space = {"n_estimators": [3, 6, 3], "max_depth": [2, 3], "learning_rate": [0.1, 0.2]}
    trials = tuning.search(rows(t), FEATURES, "teff_gaia", n_trials=3, space=space, backend="boosting")[1]
    return trials.select("number", ((F.col("val") > 0) & F.col("learning_rate").isin(0.1, 0.2) & F.col("max_depth").between(2, 3)).alias("allowed"))


@query("m16_crps_objective", "SELECT number::INT AS number, TRUE AS consistent FROM range(2) t(number)")
def _(t):
    trials = tuning.search(rows(t), FEATURES, "teff_gaia", n_trials=2, space=SPACE, objective="crps", components=2)[1]
    return trials.select("number", ((F.col("val") > 0) & (F.col("value") == F.col("val"))).alias("consistent"))


@query("m17_halving_search", """SELECT 0 AS round, 3::BIGINT AS candidates, count(*)//3 AS n_rows, TRUE AS scored FROM v_catalog WHERE teff_gaia > 0
 UNION ALL SELECT 1, 1, least(count(*), 3*(count(*)//3)), TRUE FROM v_catalog WHERE teff_gaia > 0""")
def _(t):
    weighted = rows(t).withColumn("w", F.lit(1.0) + F.col("teff_gspphot_flag"))
    history = tuning.halving_search(weighted, FEATURES, "teff_gaia", n_candidates=3, cv=2, space=SPACE, weight="w")[1]
    return history.groupBy("round").agg(F.count("*").alias("candidates"), F.max("n_rows").alias("n_rows"), (F.min("score") > 0).alias("scored"))


@query("m21_legacy_preset", "SELECT split, TRUE AS consistent FROM (VALUES ('train'), ('test')) v(split)")
def _(t):
    out = train_plan.train_legacy(rows(t).withColumn("Te_avg", F.col("teff_gaia")), FEATURES[:2], n_estimators=5, max_depth=5)
    return metric_rows(out["metrics"]).drop("n_samples")  # rows whose logarithms have no value are left out


@query("t1_feature_importance", "SELECT 3::BIGINT AS features, TRUE AS total, TRUE AS within")
def _(t):
    found = forests.feature_importance(t.spark, forests.fit_forest(rows(t), FEATURES, "teff_gaia", **SMALL), 10)
    return found.agg(F.count("*").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("total"), F.min(F.col("importance").between(0, 1)).alias("within"))


@query("d10_tree_predictions", "SELECT source_id, 100 AS n_trees, TRUE AS mean_is_prediction, TRUE AS within FROM v_catalog")
def _(t):
    model = forests.fit_forest(rows(t), FEATURES, "teff_gaia", **FULL)
    out = forests.tree_predictions(model, forests.predict(model, forests.dealt(colours(t))).withColumnRenamed("prediction", "whole"))
    same = F.abs(F.col("prediction") - F.col("whole")) <= F.lit(1e-9) * F.col("whole")
    inside = (F.array_min("tree_preds") >= 2500) & (F.array_max("tree_preds") <= 50000)
    return out.select("source_id", F.size("tree_preds").alias("n_trees"), same.alias("mean_is_prediction"), inside.alias("within"))


@query("d12_fast_tree_spread", "SELECT source_id, TRUE AS same, TRUE AS spread FROM v_catalog")
def _(t):
    # With all trees asked for, the fast spread is the spread of the whole array.
    model = forests.fit_forest(rows(t), FEATURES, "teff_gaia", **FULL)
    fast = forests.fast_tree_spread(model, forests.fast_tree_spread(model, forests.dealt(colours(t)), 100, uncertainty="every").drop("prediction"), 20)
    whole = forests.tree_predictions(model, fast.withColumnRenamed("prediction", "p"))
    same = (F.abs(F.col("every") - mx.array_std(F.col("tree_preds"))) < 1e-6) & (F.abs(F.col("p") - F.col("prediction")) < 1e-6)
    return whole.select("source_id", same.alias("same"), (F.col("uncertainty") >= 0).alias("spread"))


@query("d13_chained_propagation", "SELECT source_id, TRUE AS within, TRUE AS spread FROM v_catalog")
def _(t):
    train = logg_rows(t).withColumn("log_teff", F.log10("teff_gaia"))
    logg = forests.fit_forest(train, FEATURES, "logg_gaia", **FULL)
    teff = forests.fit_forest(train, [*FEATURES, "logg_gaia"], "log_teff", **FULL)
    out = forests.chained_propagation(logg, teff, forests.dealt(colours(t)))
    return out.select("source_id", F.col("teff_mean_k").between(2500, 50000).alias("within"), F.col("teff_std_k").between(0, 50000).alias("spread"))


CONFIG = {"target": "teff_gaia", "features": [*FEATURES, "model_type"], "correction": [5e2, 9e-1, 1e-6], "target_transform": "log10",
          "encode": ["model_type"], "split": {"stratify_bins": 5}, "model": SMALL, "mixture": {"k": 2}}


@query("plan_train_score", "SELECT TRUE AS size, TRUE AS within, TRUE AS spread, TRUE AS crps, TRUE AS pit, TRUE AS correct FROM v_catalog LIMIT 1")
def _(t):
    out = train_plan.train_model(colours(t), CONFIG)
    test = out["test"]
    n = rows(t).count()
    corrected = F.col("teff_gaia_corrected")
    every = lambda c: F.min(c.cast("int")) == 1
    # The test set is a fifth of the rows up to one row for each of the strata.
    return test.agg((F.abs(F.count("*") - 0.2 * n) <= 10).alias("size"), every(F.col("prediction").between(100, 2 * HOTTEST)).alias("within"),
                    every(F.col("uncertainty") >= 0).alias("spread"), every(F.col("crps") >= 0).alias("crps"), every(F.col("pit").between(0, 1)).alias("pit"),
                    every(corrected > 0).alias("correct"))


@query("plan_train_predict", "SELECT source_id, logg_gaia, TRUE AS within, TRUE AS spread FROM v_catalog WHERE teff_gaia < 0")
def _(t):
    out = train_plan.train_model(colours(t), CONFIG)
    scored = predict_plan.predict_catalog(colours(t), out["model"], out["metadata"], rules={"teff_gaia_lt": 0.1},
                                          target_name="teff", include=["logg_gaia"])
    return scored.select("source_id", "logg_gaia", F.col("teff_predicted").between(100, 2 * HOTTEST).alias("within"), (F.col("teff_uncertainty") >= 0).alias("spread"))


@query("plan_recipe_predict", "SELECT source_id, TRUE AS within, TRUE AS spread FROM v_catalog WHERE teff_gaia < 0")
def _(t):
    # Engineered features at training, replayed on stored columns at prediction.
    config = {"target": "teff_gaia", "features": FEATURES, "target_transform": "log10", "model": SMALL, "mixture": {"k": 2},
              "feature_engineering": {"enabled": True, "colors": FEATURES, "include_log": False, "include_temp_dependent": False}}
    out = train_plan.train_model(colours(t), config)
    scored = predict_plan.predict_catalog(colours(t), out["model"], out["metadata"], rules={"teff_gaia_lt": 0.1}, target_name="teff")
    return scored.select("source_id", F.col("teff_predicted").between(2500, 40000).alias("within"), (F.col("teff_uncertainty") >= 0).alias("spread"))


@query("plan_expression_predict", "SELECT source_id, TRUE AS within FROM v_catalog WHERE teff_gaia < 0 AND source_id % 97 > 1")
def _(t):
    # Rows whose inputs are missing, as a sentinel or NaN, get no prediction through an expression either.
    config = {"target": "teff_gaia", "features": [*FEATURES, "mix"], "expressions": {"mix": "bp_rp + 2 * g"}, "model": SMALL, "mixture": {"k": 2}}
    out = train_plan.train_model(colours(t), config)
    holes = F.when(F.col("source_id") % 97 == 0, -999.0).when(F.col("source_id") % 97 == 1, float("nan")).otherwise(F.col("g"))
    scored = predict_plan.predict_catalog(colours(t).withColumn("g", holes), out["model"], out["metadata"], rules={"teff_gaia_lt": 0.1}, target_name="teff")
    return within(scored, "teff_predicted")


@query("s9_prediction_table", "SELECT source_id, g, TRUE AS within, TRUE AS spread FROM v_catalog")
def _(t):
    model = forests.fit_forest(rows(t), FEATURES, "teff_gaia", **SMALL)
    meta = {"features": FEATURES, "target": "teff_gaia"}
    out = predict_plan.predict_catalog(colours(t), model, meta, target_name="teff", include=["g", "absent"], fast_trees=5)
    return out.select("source_id", "g", F.col("teff_predicted").between(COOLEST, HOTTEST).alias("within"), (F.col("teff_uncertainty") >= 0).alias("spread"))


@query("plan_validate", sql_bins(TARGET_EDGES["teff"], "left", TARGET_LABELS["teff"]))
def _(t):
    table = stored(with_mixture_scores(t.test_pred, "y_true"), "test_predictions")
    return neat(validate_plan.validation_report(table)["bins"])
