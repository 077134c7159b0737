"""Joins, the catalog merge and row-wise choice."""

from pyspark.sql import functions as F

from skyfold.functions.missing import fill_sentinel, nullify_sentinel
from skyfold.operators import ensemble, joins, metrics
from skyfold.plans.merge import merge_catalog
from workload.standin import Tables, query

COEFFICIENTS = (5e2, 9e-1, 1e-6)
MODELS = ("teff_clustering", "teff_log", "teff_flag1", "teff_propagated")

# The merge in SQL: hard correction, four left joins (the chain only where another model predicted), least uncertainty.
SQL_MERGED = """
WITH base AS (SELECT source_id, teff_gaia AS teff_gaia_original,
    CASE WHEN abs(teff_gaia + 999e0) >= 1e-6 AND teff_gaia > 1e4
      THEN 5e2 + 9e-1*teff_gaia + 1e-6*teff_gaia*teff_gaia ELSE teff_gaia END AS teff_gaia_corrected FROM v_catalog),
joined AS (SELECT b.*, c.value AS teff_clustering, c.unc*1e0 AS teff_clustering_uncertainty,
    l.value AS teff_log, l.unc*1e0 AS teff_log_uncertainty, f.value AS teff_flag1, f.unc*1e0 AS teff_flag1_uncertainty,
    p.value AS teff_propagated, p.unc AS teff_propagated_uncertainty
  FROM base b LEFT JOIN v_pred_clustering c USING (source_id) LEFT JOIN v_pred_log l USING (source_id)
  LEFT JOIN v_pred_flag1 f USING (source_id)
  LEFT JOIN (SELECT * FROM v_pred_chain WHERE source_id IN (SELECT source_id FROM v_pred_clustering
     UNION SELECT source_id FROM v_pred_log UNION SELECT source_id FROM v_pred_flag1)) p USING (source_id)),
cand AS (
  SELECT source_id, 0 AS idx, teff_clustering AS v, teff_clustering_uncertainty AS u FROM joined
  UNION ALL SELECT source_id, 1, teff_log, teff_log_uncertainty FROM joined
  UNION ALL SELECT source_id, 2, teff_flag1, teff_flag1_uncertainty FROM joined
  UNION ALL SELECT source_id, 3, teff_propagated, teff_propagated_uncertainty FROM joined),
best AS (SELECT source_id, v, u, idx FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY u, idx) AS rn
  FROM cand WHERE v IS NOT NULL AND u IS NOT NULL AND u > 0 AND v <> -999e0) WHERE rn = 1),
merged AS (SELECT j.*, b.v AS teff_best, b.u AS teff_best_uncertainty, b.idx FROM joined j LEFT JOIN best b USING (source_id))
"""
MERGED_COLUMNS = ("source_id, teff_gaia_original, teff_gaia_corrected, teff_clustering, teff_clustering_uncertainty, "
                  "teff_log, teff_log_uncertainty, teff_flag1, teff_flag1_uncertainty, teff_propagated, "
                  "teff_propagated_uncertainty, teff_best, teff_best_uncertainty")


def predictions(t: Tables):
    return {"teff_clustering": t.pred_clustering, "teff_log": t.pred_log, "teff_flag1": t.pred_flag1,
            "teff_propagated": t.pred_chain}


def merged(t: Tables):
    return merge_catalog(t.catalog, predictions(t), COEFFICIENTS)


def rounded(df, digits=4):
    """Round every double column, for a comparison across engines."""
    return df.select(*[F.round(c, digits).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


def sql_rounded(columns: str, digits=4, exact=()):
    return ", ".join(c if c in exact else f"round({c}, {digits}) AS {c}" for c in (x.strip() for x in columns.split(",")))


@query("flagship_catalog_merge", SQL_MERGED + "SELECT " + sql_rounded(MERGED_COLUMNS, exact=("source_id",)) + " FROM merged")
def _(t):
    return rounded(merged(t))


@query("p3_merged_column_order", SQL_MERGED + "SELECT " + sql_rounded(MERGED_COLUMNS, exact=("source_id",)) + " FROM merged WHERE teff_best IS NOT NULL")
def _(t):
    return rounded(merged(t).where("teff_best is not null"))


@query("r1_best_of", SQL_MERGED + "SELECT source_id, teff_best, teff_best_uncertainty, CASE idx WHEN 0 THEN 'teff_clustering' "
       "WHEN 1 THEN 'teff_log' WHEN 2 THEN 'teff_flag1' WHEN 3 THEN 'teff_propagated' END AS winner FROM merged")
def _(t):
    base = t.catalog.select("source_id", F.col("teff_gaia").alias("teff_gaia_original"))
    joined = joins.merge_predictions(base, predictions(t), restricted=["teff_propagated"])
    return ensemble.best_of(joined, MODELS, winner="winner").select("source_id", "teff_best", "teff_best_uncertainty", "winner")


@query("a9_winner_share", SQL_MERGED + """SELECT m.model, count(g.idx) AS n_best,
  round(1e2*count(g.idx)/(SELECT count(*) FROM merged WHERE idx IS NOT NULL), 6) AS share
FROM (VALUES (0,'teff_clustering'),(1,'teff_log'),(2,'teff_flag1'),(3,'teff_propagated')) m(i, model)
LEFT JOIN merged g ON g.idx = m.i GROUP BY m.model""")
def _(t):
    return rounded(ensemble.winner_share(merged(t), MODELS), 6)


@query("a12_availability", SQL_MERGED + """, c AS (SELECT count(*) AS n_total,
  count(*) FILTER (abs(teff_gaia_original + 999e0) >= 1e-6 AND teff_gaia_original > 0) AS n_original,
  count(teff_best) AS n_best, count(*) FILTER (teff_best_uncertainty > 0) AS n_uncertainty FROM merged)
SELECT *, round(1e2*n_original/n_total, 6) AS pct_original, round(1e2*n_best/n_total, 6) AS pct_best,
  round(1e2*n_uncertainty/n_total, 6) AS pct_uncertainty FROM c""")
def _(t):
    return rounded(metrics.availability(merged(t)), 6)


@query("a10_model_comparison", SQL_MERGED + """, w AS (SELECT m.model,
  1e2*count(g.idx)/(SELECT count(*) FROM merged WHERE idx IS NOT NULL) AS share
  FROM (VALUES (0,'teff_clustering'),(1,'teff_log'),(2,'teff_flag1'),(3,'teff_propagated')) m(i, model)
  LEFT JOIN merged g ON g.idx = m.i GROUP BY m.model),
tests AS (SELECT 'teff_clustering' AS model, y_true AS t, y_pred AS p FROM v_test_pred
  UNION ALL SELECT 'teff_log', y_true, gmm_mean_0 FROM v_test_pred
  UNION ALL SELECT 'teff_flag1', y_true, gmm_mean_2 FROM v_test_pred)
SELECT model, round(avg(abs(p-t)), 4) AS mae, round(sqrt(avg((p-t)*(p-t))), 4) AS rmse,
  round(1 - avg((p-t)*(p-t))/var_pop(t), 6) AS r2, count(*) AS n_samples, round(any_value(share), 4) AS share
FROM tests JOIN w USING (model) GROUP BY model""")
def _(t):
    p = t.test_pred
    tests = {"teff_clustering": p, "teff_log": p.select("y_true", F.col("gmm_mean_0").alias("y_pred")),
             "teff_flag1": p.select("y_true", F.col("gmm_mean_2").alias("y_pred"))}
    out = ensemble.model_comparison(tests, ensemble.winner_share(merged(t), MODELS))
    return out.select("model", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"),
                      "n_samples", F.round("share", 4).alias("share"))


@query("f10_positive_uncertainty", SQL_MERGED + "SELECT source_id, teff_best_uncertainty FROM merged WHERE teff_best_uncertainty > 0")
def _(t):
    from skyfold.operators.filters import positive_uncertainty
    return positive_uncertainty(merged(t), "teff_best_uncertainty").select("source_id", "teff_best_uncertainty")


@query("j1_join_columns", """SELECT c.source_id, c.g, coalesce(e.ebv_sandf, -999e0) AS extinction
FROM v_catalog c LEFT JOIN v_ebv e USING (source_id)""")
def _(t):
    out = joins.join_columns(t.catalog.select("source_id", "g"), t.ebv, columns=["ebv_sandf"],
                             rename={"ebv_sandf": "extinction"})
    return out.select("source_id", "g", "extinction")


@query("j2_extinction", """SELECT c.source_id, c.teff_gaia, coalesce(e.ebv_sandf, -999e0) AS ebv_sandf,
coalesce(e.ebv_sfd, -999e0) AS ebv_sdf FROM v_catalog c LEFT JOIN v_ebv e USING (source_id)""")
def _(t):
    return joins.add_extinction(t.catalog.select("source_id", "teff_gaia"), t.ebv)


@query("j3_system_parameters", """SELECT c.source_id, c.g, c.frequency, c.model_type,
coalesce(p.global_ranking, -999e0) AS global_ranking,
coalesce(p.geom_model_reference_level, -999e0) AS geom_model_reference_level
FROM v_catalog c LEFT JOIN v_params p USING (source_id)""")
def _(t):
    return joins.add_system_parameters(t.catalog.select("source_id", "g", "frequency", "model_type"), t.params)


@query("j4_prediction_merge", SQL_MERGED + "SELECT source_id, teff_clustering, teff_log, teff_flag1, teff_propagated FROM joined")
def _(t):
    base = t.catalog.select("source_id", F.col("teff_gaia").alias("teff_gaia_original"))
    return joins.merge_predictions(base, predictions(t), restricted=["teff_propagated"]).select("source_id", *MODELS)


@query("j5_semi_join_restriction", """SELECT p.* FROM v_pred_chain p WHERE source_id IN (SELECT source_id FROM v_pred_log
UNION SELECT source_id FROM v_pred_flag1)""")
def _(t):
    return joins.restrict_to_predicted(t.pred_chain, [t.pred_log, t.pred_flag1])


@query("j5_semi_join_no_original", """SELECT p.* FROM v_pred_chain p WHERE source_id IN (SELECT source_id FROM v_catalog
WHERE teff_gaia IS NULL OR abs(teff_gaia + 999e0) < 1e-6)""")
def _(t):
    return joins.restrict_to_predicted(t.pred_chain, [], t.catalog)


@query("j7_test_set_join", """SELECT c.source_id, c.teff_gaia, p.y_pred FROM v_catalog c JOIN v_test_pred p USING (source_id)
WHERE c.teff_gaia > 0""")
def _(t):
    return joins.join_test_set(t.catalog.where("teff_gaia > 0").select("source_id", "teff_gaia"),
                               t.test_pred.select("source_id", "y_pred"))


@query("p4_nullify_sentinel", """SELECT source_id, CASE WHEN abs(teff_gaia + 999e0) < 1e-6 THEN NULL ELSE teff_gaia END AS teff_gaia,
CASE WHEN abs(logg_gaia + 999e0) < 1e-6 THEN NULL ELSE logg_gaia END AS logg_gaia, model_type FROM v_catalog""")
def _(t):
    return nullify_sentinel(t.catalog.select("source_id", "teff_gaia", "logg_gaia", "model_type"))


@query("p5_fill_sentinel", """SELECT c.source_id, coalesce(e.ebv_sandf, -999e0) AS ebv_sandf
FROM v_catalog c LEFT JOIN v_ebv e USING (source_id)""")
def _(t):
    left = t.catalog.select("source_id").join(t.ebv.select("source_id", "ebv_sandf"), "source_id", "left")
    return fill_sentinel(left, ["ebv_sandf"])
