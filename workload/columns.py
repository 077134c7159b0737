"""Projections, derived columns, engineered features and filters."""

from pyspark.sql import functions as F

from skyfold.constants import EIGHT_EDGES, TARGET_EDGES, TARGET_LABELS
from skyfold.functions import binning, columns, features, missing
from skyfold.functions import mixture as mx
from skyfold.operators import filters
from workload.merging import COEFFICIENTS, rounded
from workload.standin import query

COLOURS = ("bp_rp", "g_bp", "g_rp")
SQL_COLOURS = "WITH colours AS (SELECT *, bp-rp AS bp_rp, g-bp AS g_bp, g-rp AS g_rp FROM v_catalog)\n"
SQL_CLEAN = """WITH clean AS (SELECT * REPLACE (nullif(teff_gaia, -999e0) AS teff_gaia, nullif(logg_gaia, -999e0) AS logg_gaia)
FROM v_catalog)\n"""


def colours(t):
    return columns.with_gaia_colors(t.catalog.withColumn("bp_rp", F.col("bp") - F.col("rp")))


def clean(t):
    return missing.nullify_sentinel(t.catalog)


# ---- P ----------------------------------------------------------------------------------------------------------

@query("s1_table_scan", "SELECT * FROM v_catalog")
def _(t):
    return t.catalog


@query("s5_projected_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    from skyfold.sources.tables import read_table
    return read_table(t.spark, f"{t.dir}/orders.parquet", columns=["o_orderkey", "o_totalprice"])


@query("p1_feature_selection", "SELECT source_id, bp, rp, teff_gaia FROM v_catalog")
def _(t):
    return columns.select_features(t.catalog, "teff_gaia", ["bp", "rp", "absent"], keep=["source_id"])


@query("p1_feature_exclusion", "SELECT source_id, g, bp, rp, frequency, ra, dec, teff_gaia FROM v_catalog")
def _(t):
    return columns.select_features(t.catalog, "teff_gaia", None, ["logg_gaia", "model_type", "teff_gspphot_flag"], ["source_id"])


@query("p2_normalised_predictions", "SELECT source_id, y_true AS true_value, y_pred AS predicted_value FROM v_test_pred")
def _(t):
    return columns.normalise_prediction_columns(t.test_pred.select("source_id", "y_true", "y_pred"))


SQL_SURVEY = """SELECT *, CASE WHEN gPSFMag <> -999e0 AND rPSFMag <> -999e0 THEN gPSFMag-rPSFMag ELSE -999e0 END AS g_r_color,
 CASE WHEN rPSFMag <> -999e0 AND iPSFMag <> -999e0 THEN rPSFMag-iPSFMag ELSE -999e0 END AS r_i_color,
 CASE WHEN iPSFMag <> -999e0 AND zPSFMag <> -999e0 THEN iPSFMag-zPSFMag ELSE -999e0 END AS i_z_color FROM v_detections"""


@query("p6_guarded_colors", SQL_SURVEY)
def _(t):
    return columns.with_survey_colors(t.detections)


@query("p7_gaia_colors", "SELECT *, g-bp AS g_bp, g-rp AS g_rp FROM v_catalog")
def _(t):
    return columns.with_gaia_colors(t.catalog)


@query("p8_user_expressions", "SELECT source_id, bp - rp AS bp_rp, (g - bp)*2e0 + teff_gspphot_flag AS mix FROM v_catalog")
def _(t):
    return columns.add_expressions(t.catalog, {"bp_rp": "bp - rp",
                                               "mix": "(g - bp)*2e0 + teff_gspphot_flag"}).select("source_id", "bp_rp", "mix")


@query("p9_color_temperature", "WITH s AS (" + SQL_SURVEY + """), e AS (SELECT *,
 CASE WHEN g_r_color <> -999e0 AND g_r_color > -5e-1 THEN 109e-2/(g_r_color+147e-2)*1e4 END AS a,
 CASE WHEN r_i_color <> -999e0 AND r_i_color > -5e-1 THEN 5e-1/(r_i_color+78e-2)*1e4 END AS b,
 CASE WHEN i_z_color <> -999e0 AND i_z_color > -5e-1 THEN 38e-2/(i_z_color+64e-2)*1e4 END AS c FROM s)
SELECT original_ext_source_id, round(coalesce(a,-999e0),6) AS Te_gr, round(coalesce(b,-999e0),6) AS Te_ri,
 round(coalesce(c,-999e0),6) AS Te_iz, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN -999e0 ELSE
 (coalesce(a,0e0)+coalesce(b,0e0)+coalesce(c,0e0))/((a IS NOT NULL)::INT+(b IS NOT NULL)::INT+(c IS NOT NULL)::INT) END,6) AS Te_avg FROM e""")
def _(t):
    out = columns.with_color_temperatures(columns.with_survey_colors(t.detections))
    return rounded(out.select("original_ext_source_id", "Te_gr", "Te_ri", "Te_iz", "Te_avg"), 6)


@query("p10_correct_smooth", """SELECT source_id, teff_gaia, round(CASE WHEN abs(teff_gaia+999e0) >= 1e-6 AND teff_gaia > 1e4 THEN
 teff_gaia + (5e2+teff_gaia*(9e-1+teff_gaia*1e-6) - teff_gaia)
 * power(least(greatest((teff_gaia-1e4)/2e3,0e0),1e0),2)*(3e0-2e0*least(greatest((teff_gaia-1e4)/2e3,0e0),1e0))
 ELSE teff_gaia END, 5) AS teff_gaia_corrected FROM v_catalog""")
def _(t):
    c = columns.correct_poly_smooth(F.col("teff_gaia"), COEFFICIENTS)
    return t.catalog.select("source_id", "teff_gaia", F.round(c, 5).alias("teff_gaia_corrected"))


@query("p11_correct_hard", """SELECT source_id, teff_gaia, round(CASE WHEN abs(teff_gaia+999e0) >= 1e-6 AND teff_gaia > 1e4 THEN
 5e2+teff_gaia*(9e-1+teff_gaia*1e-6) ELSE teff_gaia END, 5) AS teff_gaia_corrected FROM v_catalog""")
def _(t):
    c = columns.correct_poly_hard(F.col("teff_gaia"), COEFFICIENTS)
    return t.catalog.select("source_id", "teff_gaia", F.round(c, 5).alias("teff_gaia_corrected"))


@query("p12_target_transform", "SELECT source_id, round(log10(y_true),9) AS log10, round(log2(y_true),9) AS log2, "
       "round(ln(y_true),9) AS ln, y_true AS none FROM v_test_pred")
def _(t):
    kinds = {k: columns.transform_target(F.col("y_true"), k) for k in ("log10", "log2", "ln")}
    return t.test_pred.select("source_id", *[F.round(c, 9).alias(k) for k, c in kinds.items()], F.col("y_true").alias("none"))


@query("p13_inverse_transform", "SELECT source_id, round(power(1e1, logg_gaia),5) AS log10, round(power(2e0, logg_gaia),6) AS log2, "
       "round(exp(logg_gaia),5) AS ln FROM v_catalog WHERE logg_gaia > 0")
def _(t):
    kinds = {k: F.round(columns.inverse_target(F.col("logg_gaia"), k), 6 if k == "log2" else 5).alias(k) for k in ("log10", "log2", "ln")}
    return t.catalog.where("logg_gaia > 0").select("source_id", *kinds.values())


@query("p13_inverse_transform_trees", """SELECT source_id, round(list_sum(list_transform(tree_preds, lambda x: power(1e1, x/2e3))),3) AS total
FROM v_trees""")
def _(t):
    arr = columns.inverse_target_array(F.transform("tree_preds", lambda x: x / F.lit(2e3)), "log10")
    return t.trees.select("source_id", F.round(mx.array_sum(arr), 3).alias("total"))


@query("p14_linear_uncertainty", """SELECT source_id, round(y_pred*(gmm_sigma_0/1e4)*2.302585092994046e0,5) AS log10,
 round(y_pred*(gmm_sigma_0/1e4)*6.931471805599453e-1,5) AS log2, round(y_pred*(gmm_sigma_0/1e4),5) AS ln FROM v_test_pred""")
def _(t):
    s = F.col("gmm_sigma_0") / F.lit(1e4)
    return t.test_pred.select("source_id", *[F.round(columns.linear_uncertainty(F.col("y_pred"), s, k), 5).alias(k)
                                             for k in ("log10", "log2", "ln")])


@query("p16_unit_heuristic", "SELECT source_id, round(CASE WHEN logT1 BETWEEN 3e0 AND 5e0 THEN power(1e1,logT1) ELSE logT1 END,5) AS t1 FROM v_components")
def _(t):
    return t.components.select("source_id", F.round(columns.log_temperature_to_kelvin(F.col("logT1")), 5).alias("t1"))


@query("p17_error_columns", """SELECT source_id, round(y_pred-y_true,6) AS residual, round(abs(y_pred-y_true),6) AS abs_error,
 round(abs(y_pred-y_true)/y_true,9) AS rel_error, round(abs(y_pred-y_true)/y_true*1e2,7) AS pct_error FROM v_test_pred""")
def _(t):
    e = columns.error_columns(t.test_pred, "y_true", "y_pred")
    return e.select("source_id", F.round("residual", 6).alias("residual"), F.round("abs_error", 6).alias("abs_error"),
                    F.round("rel_error", 9).alias("rel_error"), F.round("pct_error", 7).alias("pct_error"))


@query("p18_polynomial_features", SQL_COLOURS + """SELECT source_id, bp_rp*bp_rp AS "bp_rp^2", bp_rp*g_bp AS bp_rp_g_bp, g_bp*g_bp AS "g_bp^2",
 bp_rp*bp_rp*bp_rp AS "bp_rp^3", bp_rp*bp_rp*g_bp AS "bp_rp^2_g_bp", bp_rp*g_bp*g_bp AS "bp_rp_g_bp^2", g_bp*g_bp*g_bp AS "g_bp^3" FROM colours""")
def _(t):
    return features.polynomial_features(colours(t).select("source_id", "bp_rp", "g_bp"), ["bp_rp", "g_bp"]).drop("bp_rp", "g_bp")


@query("p18_interaction_only", SQL_COLOURS + """SELECT source_id, bp_rp*g_bp AS bp_rp_g_bp, bp_rp*g_rp AS bp_rp_g_rp, g_bp*g_rp AS g_bp_g_rp,
 bp_rp*g_bp*g_rp AS bp_rp_g_bp_g_rp FROM colours""")
def _(t):
    return features.polynomial_features(colours(t).select("source_id", *COLOURS), COLOURS, interaction_only=True).drop(*COLOURS)


@query("p19_interactions", SQL_COLOURS + "SELECT source_id, bp_rp*g_bp AS bp_rp_x_g_bp, bp_rp*g_rp AS bp_rp_x_g_rp, g_bp*g_rp AS g_bp_x_g_rp FROM colours")
def _(t):
    return features.interaction_features(colours(t).select("source_id", *COLOURS), COLOURS).drop(*COLOURS)


@query("p20_log_features", SQL_COLOURS + """SELECT source_id, round(CASE WHEN bp_rp+5e-1 > 0 THEN ln(bp_rp+5e-1) ELSE 0e0 END,9) AS log_bp_rp,
 round(CASE WHEN g_bp+5e-1 > 0 THEN ln(g_bp+5e-1) ELSE 0e0 END,9) AS log_g_bp FROM colours WHERE g_bp+5e-1 <> 0""")
def _(t):
    out = features.log_features(colours(t).where(F.col("g_bp") + 0.5 != 0), ["bp_rp", "g_bp"])
    return rounded(out.select("source_id", "log_bp_rp", "log_g_bp"), 9)


@query("p21_regime_features", SQL_COLOURS + """SELECT source_id, CASE WHEN g_rp < 3e-1 THEN g_rp ELSE 0e0 END AS hot_g_rp,
 CASE WHEN g_rp > 8e-1 THEN g_rp ELSE 0e0 END AS cool_g_rp, CASE WHEN g_rp BETWEEN 3e-1 AND 8e-1 THEN g_rp ELSE 0e0 END AS mid_g_rp FROM colours""")
def _(t):
    return features.regime_features(colours(t), ["g_rp"]).select("source_id", "hot_g_rp", "cool_g_rp", "mid_g_rp")


@query("p22_magnitude_features", "SELECT source_id, round(g*g,6) AS g_squared, round(g*g*g,6) AS g_cubed FROM v_catalog")
def _(t):
    return rounded(features.magnitude_features(t.catalog, ["g"], 3).select("source_id", "g_squared", "g_cubed"), 6)


@query("p23_all_features", SQL_COLOURS + """SELECT source_id, round(bp_rp*bp_rp*bp_rp,6) AS "bp_rp^3", round(bp_rp*g_rp,6) AS bp_rp_x_g_rp,
 round(ln(g_rp+5e-1),6) AS log_g_rp, round(CASE WHEN bp_rp > 8e-1 THEN bp_rp ELSE 0e0 END,6) AS cool_bp_rp, round(g*g,6) AS g_squared FROM colours""")
def _(t):
    out = features.engineer_all_features(colours(t), ["bp_rp", "g_rp"], ["g"])
    return rounded(out.select("source_id", "`bp_rp^3`", "bp_rp_x_g_rp", "log_g_rp", "cool_bp_rp", "g_squared"), 6)


def _ladder(column, edges, labels):
    cases = " ".join(f"WHEN {column} >= {lo!r}::DOUBLE AND {column} < {hi!r}::DOUBLE THEN '{text}'" for lo, hi, text in zip(edges, edges[1:], labels))
    return f"CASE {cases} END"


@query("p26_bin_labels", "SELECT c.source_id, " + ", ".join(
    f"{_ladder(col, TARGET_EDGES[k], TARGET_LABELS[k])} AS {k}_label" for k, col in (("teff", "teff_gaia"), ("logg", "logg_gaia"), ("mh", "bp - rp - 1e0"))) + " FROM v_catalog c")
def _(t):
    source = {"teff": F.col("teff_gaia"), "logg": F.col("logg_gaia"), "mh": F.col("bp") - F.col("rp") - F.lit(1.0)}
    return t.catalog.select("source_id", *[binning.bin_label(binning.edge_bin(c, TARGET_EDGES[k]), TARGET_LABELS[k]).alias(f"{k}_label")
                                           for k, c in source.items()])


@query("p27_period", "SELECT source_id, 1e0/frequency AS period_days, round(log10(1e0/frequency),9) AS log_period FROM v_catalog")
def _(t):
    return columns.with_period(t.catalog).select("source_id", "period_days", F.round("log_period", 9).alias("log_period"))


@query("p28_sky_coordinates", """SELECT round(radians(CASE WHEN ra > 180 THEN ra-360 ELSE ra END),9) AS lon_rad, round(radians("dec"),9) AS lat_rad, g FROM v_catalog""")
def _(t):
    sky = columns.sky_coordinates(t.catalog, "ra", "dec", "g")
    return sky.select(F.round("lon_rad", 9).alias("lon_rad"), F.round("lat_rad", 9).alias("lat_rad"), "g")


@query("p29_decode_log_temperature", """SELECT source_id, round(CASE WHEN power(1e1,logT1) >= 1e2 THEN power(1e1,logT1) END,5) AS t1,
 round(CASE WHEN power(1e1,logT2) >= 1e2 THEN power(1e1,logT2) END,5) AS t2 FROM v_components""")
def _(t):
    return t.components.select("source_id", *[F.round(columns.decode_log_temperature(F.col(f"logT{i}")), 5).alias(f"t{i}") for i in (1, 2)])


@query("p30_pair_columns", "SELECT source_id, round(y_pred/y_true,9) AS ratio, round((y_pred+y_true)/2e0,6) AS mean_xy, round(y_pred-y_true,6) AS diff_xy FROM v_test_pred")
def _(t):
    p = columns.pair_columns(t.test_pred, "y_pred", "y_true")
    return p.select("source_id", F.round("ratio", 9).alias("ratio"), F.round("mean_xy", 6).alias("mean_xy"), F.round("diff_xy", 6).alias("diff_xy"))


# ---- F ----------------------------------------------------------------------------------------------------------

@query("f1_range_filters", "SELECT source_id, g, teff_gaia FROM v_catalog WHERE teff_gaia BETWEEN 3000 AND 12000 AND g BETWEEN 12 AND 18")
def _(t):
    return filters.range_filters(t.catalog, {"teff_gaia": [3000.0, 12000.0], "g": [12.0, 18.0], "absent": [0, 1]}).select("source_id", "g", "teff_gaia")


@query("f2_drop_missing", SQL_CLEAN + "SELECT source_id, teff_gaia, logg_gaia FROM clean WHERE teff_gaia IS NOT NULL AND logg_gaia IS NOT NULL AND model_type IS NOT NULL")
def _(t):
    return filters.drop_missing(clean(t), ["teff_gaia", "logg_gaia", "model_type"]).select("source_id", "teff_gaia", "logg_gaia")


@query("f3_valid_target", "SELECT source_id, logg_gaia FROM v_catalog WHERE abs(logg_gaia+999e0) >= 1e-6 AND logg_gaia > 0")
def _(t):
    return filters.valid_target(t.catalog, "logg_gaia").select("source_id", "logg_gaia")


@query("f4_finite_target", "SELECT source_id, round(log10(logg_gaia),9) AS y FROM v_catalog WHERE logg_gaia > 0")
def _(t):
    return filters.finite_target(t.catalog.select("source_id", F.round(F.log10("logg_gaia"), 9).alias("y")), "y")


@query("f5_predicate_rules", SQL_CLEAN + """SELECT source_id, teff_gaia, logg_gaia, model_type FROM clean WHERE teff_gaia IS NOT NULL AND logg_gaia > 1e0
 AND logg_gaia < 4e0 AND model_type <> '1-URGENT' AND teff_gspphot_flag = 1 AND g BETWEEN 11e0 AND 19e0""")
def _(t):
    rules = {"teff_gaia_is_null": False, "logg_gaia_gt": 1.0, "logg_gaia_lt": 4.0, "model_type_ne": "1-URGENT",
             "teff_gspphot_flag": 1, "g": [11.0, 19.0]}
    return filters.apply_rules(clean(t), rules).select("source_id", "teff_gaia", "logg_gaia", "model_type")


@query("f5_predicate_is_null", SQL_CLEAN + "SELECT source_id, model_type FROM clean WHERE teff_gaia IS NULL AND model_type = '2-HIGH'")
def _(t):
    return filters.apply_rules(clean(t), {"teff_gaia_is_null": True, "model_type_eq": "2-HIGH"}).select("source_id", "model_type")


@query("f6_required_features", "SELECT source_id FROM v_catalog WHERE g <> -999e0 AND bp <> -999e0 AND logg_gaia <> -999e0")
def _(t):
    return filters.require_features(t.catalog, ["g", "bp", "logg_gaia", "engineered"]).select("source_id")


@query("f7_any_color", """SELECT * FROM v_detections WHERE (gPSFMag <> -999e0 AND rPSFMag <> -999e0) OR (rPSFMag <> -999e0 AND iPSFMag <> -999e0)
 OR (iPSFMag <> -999e0 AND zPSFMag <> -999e0)""")
def _(t):
    return filters.any_color(t.detections)


@query("f8_plausible", """SELECT source_id, teff_gaia, y_pred FROM v_catalog JOIN v_test_pred USING (source_id)
 WHERE teff_gaia <> -999e0 AND teff_gaia BETWEEN 2500 AND 40000 AND y_pred BETWEEN 2500 AND 40000""")
def _(t):
    j = t.catalog.select("source_id", "teff_gaia").join(t.test_pred.select("source_id", "y_pred"), "source_id")
    return filters.plausible(j, ["teff_gaia", "y_pred"])


@query("f9_color_window", SQL_COLOURS + """SELECT source_id, g_rp, teff_gaia FROM colours WHERE g_rp > -5e-1 AND g_rp < 3e0
 AND teff_gaia > (SELECT min(teff_gaia) FROM colours) AND teff_gaia < (SELECT max(teff_gaia) FROM colours)""")
def _(t):
    return filters.color_window(colours(t), "g_rp", "teff_gaia").select("source_id", "g_rp", "teff_gaia")


@query("f11_valid_original", "SELECT source_id, teff_gaia FROM v_catalog WHERE abs(teff_gaia+999e0) >= 1e-6 AND teff_gaia > 0")
def _(t):
    return t.catalog.where(missing.has_original(F.col("teff_gaia"))).select("source_id", "teff_gaia")


@query("f12_pair_window", "SELECT source_id, y_true, y_pred FROM v_test_pred WHERE y_true BETWEEN 3000 AND 15000 AND y_pred BETWEEN 3000 AND 15000")
def _(t):
    return filters.pair_window(t.test_pred, "y_true", "y_pred", 3000.0, 15000.0).select("source_id", "y_true", "y_pred")
