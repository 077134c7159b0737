"""Duplicate handling, aggregates, histograms and agreement statistics."""

from functools import reduce

from pyspark.sql import functions as F

from skyfold.constants import EIGHT_EDGES, EIGHT_LABELS, TARGET_EDGES, TARGET_LABELS
from skyfold.functions import columns, missing
from skyfold.operators import agreement, detections, histograms, joins, metrics, profile, ranks
from skyfold.plans.prepare import prepare_photometry
from skyfold.sources.tables import metrics_document
from workload.columns import SQL_COLOURS, colours
from workload.merging import COEFFICIENTS, rounded
from workload.standin import query

BANDS = ("g", "r", "i", "z")


# ---- duplicates -------------------------------------------------------------------------------------------------

SQL_DUP = """WITH dup AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY original_ext_source_id) AS k FROM v_detections)
 WHERE k > 1)"""


def _merged_band(b):
    m, e = f"{b}PSFMag", f"{b}PSFMagErr"
    ok = f"{m} <> -999e0 AND {e} > 0"
    return (f"coalesce(sum({m}/({e}*{e})) FILTER ({ok})/sum(1e0/({e}*{e})) FILTER ({ok}), avg({m}) FILTER ({m} <> -999e0), -999e0) AS {m}, "
            f"coalesce(1e0/sqrt(sum(1e0/({e}*{e})) FILTER ({ok})), -999e0) AS {e}")


SQL_MERGED = SQL_DUP + ", merged AS (SELECT original_ext_source_id, " + ", ".join(map(_merged_band, BANDS)) + \
    " FROM dup GROUP BY original_ext_source_id)"
PHOT = [f"{b}PSFMag{s}" for b in BANDS for s in ("", "Err")]
ROUND_PHOT = ", ".join(f"round({c}, 6) AS {c}" for c in PHOT)


@query("a28_duplicate_detections", SQL_DUP + " SELECT * EXCLUDE (k) FROM dup")
def _(t):
    return detections.duplicate_detections(t.detections)


@query("a29_duplicate_merge", SQL_MERGED + f" SELECT original_ext_source_id, {ROUND_PHOT} FROM merged")
def _(t):
    return rounded(detections.merge_detections(detections.duplicate_detections(t.detections), BANDS), 6)


@query("j6_remove_merged", SQL_DUP + " SELECT * FROM v_detections WHERE original_ext_source_id NOT IN (SELECT original_ext_source_id FROM dup)")
def _(t):
    return joins.remove_merged(t.detections, detections.duplicate_detections(t.detections))


SQL_UNION = SQL_MERGED + f""", u AS (SELECT original_ext_source_id, {', '.join(PHOT)} FROM v_detections
 WHERE original_ext_source_id NOT IN (SELECT original_ext_source_id FROM merged)
 UNION ALL SELECT original_ext_source_id, {', '.join(PHOT)} FROM merged)"""


@query("u1_deduplicated_union", SQL_UNION + f" SELECT original_ext_source_id, {ROUND_PHOT} FROM u")
def _(t):
    rows = t.detections.select("original_ext_source_id", *PHOT)
    merged = detections.merge_detections(detections.duplicate_detections(rows), BANDS)
    return rounded(joins.deduplicated_union(rows, merged), 6)


@query("plan_prepare_photometry", SQL_UNION + """, s AS (SELECT *,
 CASE WHEN gPSFMag <> -999e0 AND rPSFMag <> -999e0 THEN gPSFMag-rPSFMag ELSE -999e0 END AS g_r_color,
 CASE WHEN rPSFMag <> -999e0 AND iPSFMag <> -999e0 THEN rPSFMag-iPSFMag ELSE -999e0 END AS r_i_color,
 CASE WHEN iPSFMag <> -999e0 AND zPSFMag <> -999e0 THEN iPSFMag-zPSFMag ELSE -999e0 END AS i_z_color FROM u
 WHERE (gPSFMag <> -999e0 AND rPSFMag <> -999e0) OR (rPSFMag <> -999e0 AND iPSFMag <> -999e0) OR (iPSFMag <> -999e0 AND zPSFMag <> -999e0)),
 e AS (SELECT *, CASE WHEN g_r_color <> -999e0 AND g_r_color > -5e-1 THEN 109e-2/(g_r_color+147e-2)*1e4 END AS a,
 CASE WHEN r_i_color <> -999e0 AND r_i_color > -5e-1 THEN 5e-1/(r_i_color+78e-2)*1e4 END AS b,
 CASE WHEN i_z_color <> -999e0 AND i_z_color > -5e-1 THEN 38e-2/(i_z_color+64e-2)*1e4 END AS c FROM s)
SELECT original_ext_source_id, round(g_r_color,6) AS g_r_color, round(r_i_color,6) AS r_i_color, round(i_z_color,6) AS i_z_color,
 round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN -999e0 ELSE (coalesce(a,0e0)+coalesce(b,0e0)+coalesce(c,0e0))
 /((a IS NOT NULL)::INT+(b IS NOT NULL)::INT+(c IS NOT NULL)::INT) END,4) AS Te_avg FROM e""")
def _(t):
    out = prepare_photometry(t.detections, BANDS)
    return out.select("original_ext_source_id", *[F.round(c, 6).alias(c) for c in ("g_r_color", "r_i_color", "i_z_color")],
                      F.round("Te_avg", 4).alias("Te_avg"))


# ---- regression metrics -------------------------------------------------------------------------------------------

T, P = "y_true", "y_pred"
DIGITS = {"mae": 4, "rmse": 4, "r2": 6, "mean_relative_error": 6, "within_5_percent": 6, "within_10_percent": 6,
          "within_20_percent": 6, "mean_pct": 6, "within_10": 6, "value_center": 2}


def neat(df, default=4):
    return df.select(*[F.round(c, DIGITS.get(c, default)).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


def sql_metrics(t=T, p=P):
    e = f"({p}-{t})"
    within = ", ".join(f"round(1e2*avg(CASE WHEN abs({e})/abs({t}) <= {x}e-2 THEN 1e0 ELSE 0e0 END), 6) AS within_{x}_percent" for x in (5, 10, 20))
    return (f"round(avg(abs({e})),4) AS mae, round(sqrt(avg({e}*{e})),4) AS rmse, round(1-avg({e}*{e})/var_pop({t}),6) AS r2, "
            f"round(1e2*avg(abs({e})/abs({t})),6) AS mean_relative_error, {within}, count(*) AS n_samples")


@query("a1_regression_metrics", f"SELECT {sql_metrics()} FROM v_test_pred")
def _(t):
    return neat(metrics.regression_metrics(t.test_pred, T, P))


def sql_bins(edges, closed, labels=None, source="v_test_pred", t=T, p=P):
    lo_op, hi_op = (">=", "<") if closed == "left" else (">", "<=")
    ladder = " ".join(f"WHEN {t} {lo_op} {lo!r}::DOUBLE AND {t} {hi_op} {hi!r}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    values = ", ".join("(%d, %r::DOUBLE, %r::DOUBLE%s)" % (i, lo, hi, f", '{labels[i]}'" if labels else "")
                       for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    e = f"({p}-{t})"
    return f"""SELECT e.value_min, e.value_max, (e.value_min+e.value_max)/2 AS value_center{', e.bin' if labels else ''}, s.* EXCLUDE (b) FROM (
 SELECT CASE {ladder} END AS b, round(avg(abs({e})),4) AS mae, round(sqrt(avg({e}*{e})),4) AS rmse,
 round(1-avg({e}*{e})/nullif(var_pop({t}),0),6) AS r2, round(1e2*avg(abs({e})/abs({t})),6) AS mean_pct,
 round(1e2*avg(CASE WHEN abs({e})/abs({t}) <= 1e-1 THEN 1e0 ELSE 0e0 END),6) AS within_10, count(*) AS n_samples
 FROM {source} GROUP BY 1) s JOIN (VALUES {values}) e(b, value_min, value_max{', bin' if labels else ''}) ON e.b = s.b"""


@query("a2_metrics_by_bin_left", sql_bins(TARGET_EDGES["teff"], "left", TARGET_LABELS["teff"]))
def _(t):
    return neat(metrics.metrics_by_target_kind(t.test_pred, "teff", T, P))


@query("a2_metrics_by_bin_logg", sql_bins(TARGET_EDGES["logg"], "left", TARGET_LABELS["logg"],
       "(SELECT logg_gaia AS y_true, logg_gaia + (bp-rp)/1e1 AS y_pred FROM v_catalog WHERE logg_gaia > 0)"))
def _(t):
    logg = t.catalog.where("logg_gaia > 0").select(F.col("logg_gaia").alias(T), (F.col("logg_gaia") + (F.col("bp") - F.col("rp")) / F.lit(10.0)).alias(P))
    return neat(metrics.metrics_by_target_kind(logg, "logg", T, P))


@query("a3_metrics_by_bin_right", sql_bins(TARGET_EDGES["teff"], "right", TARGET_LABELS["teff"]))
def _(t):
    return neat(metrics.metrics_by_bin(t.test_pred, T, P, closed="right", labels=TARGET_LABELS["teff"]))


@query("a4_metrics_eight_bins", sql_bins(EIGHT_EDGES, "right", EIGHT_LABELS))
def _(t):
    return neat(metrics.metrics_by_eight_bins(t.test_pred, T, P))


@query("a5_rmse_curve", """SELECT (floor(y_true/1e2)+5e-1)*1e2 AS bin_center, round(sqrt(avg((y_pred-y_true)*(y_pred-y_true))),4) AS rmse,
 count(*) AS n FROM v_test_pred GROUP BY floor(y_true/1e2) HAVING count(*) >= 10""")
def _(t):
    return neat(metrics.rmse_curve(t.test_pred, T, P))


@query("a6_prediction_statistics", """SELECT round(avg(y_pred),4) AS mean, round(stddev_pop(y_pred),4) AS std, round(min(y_pred),4) AS min,
 round(max(y_pred),4) AS max, count(*) AS n_objects FROM v_test_pred""")
def _(t):
    return neat(metrics.prediction_statistics(t.test_pred, P))


@query("a7_uncertainty_statistics", "SELECT round(avg(unc),4) AS mean, median(unc) AS median, min(unc) AS min, max(unc) AS max FROM v_pred_log")
def _(t):
    return neat(metrics.uncertainty_statistics(t.pred_log, "unc"))


@query("a8_correction_statistics", """WITH c AS (SELECT teff_gaia AS o, CASE WHEN abs(teff_gaia+999e0) >= 1e-6 AND teff_gaia > 1e4 THEN
 teff_gaia + (5e2+teff_gaia*(9e-1+teff_gaia*1e-6) - teff_gaia) * power(least(greatest((teff_gaia-1e4)/2e3,0e0),1e0),2)
 *(3e0-2e0*least(greatest((teff_gaia-1e4)/2e3,0e0),1e0)) ELSE teff_gaia END AS x FROM v_catalog)
 SELECT count(*) AS n_corrected, count(*) FILTER (o < 12e3) AS n_blended, round(avg(x-o),4) AS mean_correction,
 round(min(o),4) AS original_min, round(max(o),4) AS original_max, round(min(x),4) AS corrected_min, round(max(x),4) AS corrected_max,
 round(median(x-o),4) AS median_correction FROM c WHERE o > 1e4""")
def _(t):
    df = t.catalog.select("teff_gaia", columns.correct_poly_smooth(F.col("teff_gaia"), COEFFICIENTS).alias("x"))
    return neat(metrics.correction_statistics(df, "teff_gaia", "x"))


@query("a11_coverage_overlap", """WITH c AS (SELECT count(*) FILTER (teff_gaia > 0 AND logg_gaia > 0) AS n_both,
 count(*) FILTER (teff_gaia > 0 AND logg_gaia <= 0) AS n_only_a, count(*) FILTER (teff_gaia <= 0 AND logg_gaia > 0) AS n_only_b,
 count(*) FILTER (teff_gaia <= 0 AND logg_gaia <= 0) AS n_neither, count(*) AS n_total FROM v_catalog)
 SELECT *, round(1e2*n_both/n_total,6) AS pct_both, round(1e2*n_only_a/n_total,6) AS pct_only_a,
 round(1e2*n_only_b/n_total,6) AS pct_only_b, round(1e2*n_neither/n_total,6) AS pct_neither FROM c""")
def _(t):
    return rounded(metrics.coverage_overlap(t.catalog, F.col("teff_gaia") > 0, F.col("logg_gaia") > 0), 6)


@query("a13_cluster_profile", """WITH p AS (SELECT teff_gaia, CASE WHEN g_rp >= bp_rp AND g_rp >= g/1e1 THEN 0 WHEN bp_rp >= g/1e1 THEN 1 ELSE 2 END AS cluster
 FROM (SELECT *, bp-rp AS bp_rp, g-rp AS g_rp FROM v_catalog) WHERE teff_gaia > 0)
 SELECT cluster, count(*) AS n, round(avg(teff_gaia),4) AS target_mean, round(stddev_pop(teff_gaia),4) AS target_std,
 round(1e2*count(*)/(SELECT count(*) FROM p),6) AS pct FROM p GROUP BY cluster""")
def _(t):
    c = colours(t).where("teff_gaia > 0").withColumn("mag", F.col("g") / F.lit(10.0))
    out = metrics.cluster_profile(c, ["g_rp", "bp_rp", "mag"], "teff_gaia")
    return out.select("cluster", "n", F.round("target_mean", 4).alias("target_mean"), F.round("target_std", 4).alias("target_std"), F.round("pct", 6).alias("pct"))


# ---- agreement ------------------------------------------------------------------------------------------------

SQL_PAIR = """WITH p AS (SELECT y_true AS x, gmm_mean_2 AS y FROM v_test_pred),
 r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2e0 AS rx,
   rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2e0 AS ry FROM p),
 v AS (SELECT x AS v, 1 AS a, 0 AS b FROM p UNION ALL SELECT y, 0, 1 FROM p),
 g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v),
 c AS (SELECT v, sum(a) OVER (ORDER BY v)/(SELECT count(*) FROM p)::DOUBLE AS f1, sum(b) OVER (ORDER BY v)/(SELECT count(*) FROM p)::DOUBLE AS f2,
   lead(v) OVER (ORDER BY v) AS nv FROM g)
"""


def pair(t):
    return t.test_pred.select(F.col("y_true").alias("x"), F.col("gmm_mean_2").alias("y"))


@query("a14_comparison_metrics", SQL_PAIR + """, m AS (SELECT median(x-y) AS md FROM p),
 ks AS (SELECT max(abs(f1-f2)) AS d FROM c)
SELECT 'x vs y' AS pair, count(*) AS n, round(corr(x,y),8) AS pearson,
 round(2*covar_pop(x,y)/(var_pop(x)+var_pop(y)+(avg(x)-avg(y))*(avg(x)-avg(y))),8) AS ccc, round(avg(x-y),4) AS bias,
 round(stddev_pop(x-y),4) AS scatter, round(avg(abs(x-y)),4) AS mae, round(sqrt(avg((x-y)*(x-y))),4) AS rmse,
 round((SELECT corr(rx,ry) FROM r),8) AS spearman, round(quantile_cont(x-y,16e-2),4) AS p16_diff, round(median(x-y),4) AS median_diff,
 round(quantile_cont(x-y,84e-2),4) AS p84_diff, round((SELECT median(abs(x-y-md)) FROM p, m),4) AS mad_diff,
 round((SELECT d FROM ks),8) AS ks_stat, (SELECT round(least(greatest(2*sum((CASE WHEN k%2=1 THEN 1e0 ELSE -1e0 END)
  *exp(-2*d*d*(count_p/2e0)*k*k)),0e0),1e0),8) FROM ks, range(1,101) t(k), (SELECT count(*) AS count_p FROM p) GROUP BY ALL) AS ks_p,
 round((SELECT sum(abs(f1-f2)*(nv-v)) FROM c),4) AS wasserstein FROM p""".replace("GROUP BY ALL", "GROUP BY d, count_p"))
def _(t):
    out = agreement.comparison_metrics(pair(t), "x", "y")
    eight = {"pearson", "ccc", "spearman", "ks_stat", "ks_p"}
    return out.select(*[F.round(c, 8 if c in eight else 4).alias(c) if d == "double" else F.col(c) for c, d in out.dtypes])


@query("a15_ks_statistic", SQL_PAIR + "SELECT round(max(abs(f1-f2)),8) AS ks_stat FROM c")
def _(t):
    return agreement.distribution_distance(pair(t), "x", pair(t), "y").select(F.round("ks_stat", 8).alias("ks_stat"))


@query("a16_wasserstein", SQL_PAIR + "SELECT round(sum(abs(f1-f2)*(nv-v)),4) AS wasserstein FROM c")
def _(t):
    return agreement.distribution_distance(pair(t), "x", pair(t), "y").select(F.round("wasserstein", 4).alias("wasserstein"))


@query("a17_distribution_report", """WITH a AS (SELECT teff_gaia AS v FROM v_catalog WHERE teff_gaia > 0), b AS (SELECT value AS v FROM v_pred_clustering),
 u AS (SELECT v, 1 AS a, 0 AS b FROM a UNION ALL SELECT v, 0, 1 FROM b), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY v),
 c AS (SELECT v, sum(a) OVER (ORDER BY v)/(SELECT count(*) FROM a)::DOUBLE AS f1, sum(b) OVER (ORDER BY v)/(SELECT count(*) FROM b)::DOUBLE AS f2,
  lead(v) OVER (ORDER BY v) AS nv FROM g)
 SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, round((SELECT avg(v) FROM a),4) AS mean_a, round((SELECT avg(v) FROM b),4) AS mean_b,
 round((SELECT median(v) FROM a),4) AS median_a, round((SELECT median(v) FROM b),4) AS median_b,
 round((SELECT avg(v) FROM a)-(SELECT avg(v) FROM b),4) AS mean_difference, round(max(abs(f1-f2)),8) AS ks_stat, round(sum(abs(f1-f2)*(nv-v)),4) AS wasserstein FROM c""")
def _(t):
    out = agreement.distribution_report(t.catalog.where("teff_gaia > 0"), "teff_gaia", t.pred_clustering, "value").drop("ks_p")
    return out.select(*[F.round(c, 8 if c == "ks_stat" else 4).alias(c) if d == "double" else F.col(c) for c, d in out.dtypes])


@query("a18_bland_altman", """SELECT count(*) AS n, round(avg(y_pred-y_true),4) AS bias, round(avg(y_pred-y_true)-196e-2*stddev_pop(y_pred-y_true),4) AS loa_low,
 round(avg(y_pred-y_true)+196e-2*stddev_pop(y_pred-y_true),4) AS loa_high FROM v_test_pred""")
def _(t):
    return neat(agreement.bland_altman(t.test_pred, P, T))


@query("a18_bland_altman_plane", """SELECT ix, iy, count(*) AS n, round(log10(count(*)),9) AS log_n FROM (SELECT
 least(floor(((y_pred+y_true)/2e0-25e2)/625e0)::INT,59) AS ix, least(floor((y_pred-y_true+8e3)/(16e3/60))::INT,59) AS iy FROM v_test_pred
 WHERE (y_pred+y_true)/2e0 BETWEEN 25e2 AND 4e4 AND y_pred-y_true BETWEEN -8e3 AND 8e3) GROUP BY ix, iy""")
def _(t):
    p = columns.pair_columns(t.test_pred, P, T)
    return rounded(histograms.density_grid(p, "mean_xy", "diff_xy", (2500.0, 40000.0), (-8000.0, 8000.0), 60), 9)


@query("a19_median_trend", """WITH d AS (SELECT log10(1e0/frequency) AS x, teff_gaia AS y FROM v_catalog WHERE teff_gaia > 0),
 e AS (SELECT min(x) AS lo, max(x) AS hi FROM d), b AS (SELECT least(floor((x-lo)/((hi-lo)/10))::INT, 9) AS bin, y FROM d, e WHERE x < hi)
 SELECT bin, round(any_value(lo)+(bin+5e-1)*((any_value(hi)-any_value(lo))/10),6) AS center, count(*) AS n, round(median(y),4) AS median,
 round(quantile_cont(y,16e-2),4) AS p16, round(quantile_cont(y,84e-2),4) AS p84 FROM b, e GROUP BY bin HAVING count(*) >= 3""")
def _(t):
    d = columns.with_period(t.catalog.where("teff_gaia > 0"))
    out = histograms.median_trend(d, "log_period", "teff_gaia")
    return out.select("bin", F.round("center", 6).alias("center"), "n", *[F.round(c, 4).alias(c) for c in ("median", "p16", "p84")])


# ---- histograms -----------------------------------------------------------------------------------------------

def sql_histogram(column, source, n_bins, lo, hi):
    w = repr((hi - lo) / n_bins) + "::DOUBLE"
    return f"""SELECT r.bin, {lo!r}::DOUBLE + r.bin*{w} AS bin_lo, coalesce(h.n,0) AS n, round(coalesce(h.n,0)/(sum(coalesce(h.n,0)) OVER ()*{w}),9) AS density
 FROM (SELECT i::INT AS bin FROM range({n_bins}) r(i)) r LEFT JOIN (SELECT least(floor(({column}-{lo!r}::DOUBLE)/{w})::INT,{n_bins - 1}) AS bin, count(*) AS n
 FROM {source} WHERE {column} BETWEEN {lo!r}::DOUBLE AND {hi!r}::DOUBLE GROUP BY 1) h ON h.bin = r.bin"""


@query("a20_histogram", sql_histogram("teff_gaia", "v_catalog", 50, 2500.0, 40000.0))
def _(t):
    h = histograms.histogram(t.catalog, "teff_gaia", 50, 2500.0, 40000.0)
    return h.select("bin", "bin_lo", "n", F.round("density", 9).alias("density"))


@query("a20_histogram_data_range", """WITH e AS (SELECT min(y_pred) AS lo, max(y_pred) AS hi FROM v_test_pred)
 SELECT bin, count(*) AS n FROM (SELECT least(floor((y_pred-lo)/((hi-lo)/30))::INT,29) AS bin FROM v_test_pred, e) GROUP BY bin""")
def _(t):
    return histograms.histogram(t.test_pred, P, 30).where("n > 0").select("bin", "n")


@query("a21_uncertainty_histogram", """WITH u AS (SELECT y_pred*y_pred*y_pred*gmm_sigma_0/1e12 AS u FROM v_test_pred), e AS (SELECT log10(min(u)) AS a, log10(max(u)*101e-2) AS b FROM u),
 l AS (SELECT least(floor((log10(u)-a)/((b-a)/79))::INT,78) AS bin FROM u, e)
 SELECT bin, count(*) AS n, round((SELECT quantile_cont(u,5e-1) FROM u),6) AS p50, round((SELECT quantile_cont(u,9e-1) FROM u),6) AS p90 FROM l GROUP BY bin""")
def _(t):
    u = t.test_pred.select((F.col("y_pred") * F.col("y_pred") * F.col("y_pred") * F.col("gmm_sigma_0") / F.lit(1e12)).alias("u"))
    h = histograms.uncertainty_histogram(u, "u", 80)
    return h.select("bin", "n", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


@query("a22_density_grid", """SELECT ix, iy, count(*) AS n, round(log10(count(*)),9) AS log_n FROM (SELECT least(floor(ra/6e0)::INT,59) AS ix,
 least(floor(("dec"+9e1)/3e0)::INT,59) AS iy FROM v_catalog WHERE ra BETWEEN 0 AND 360 AND "dec" BETWEEN -90 AND 90) GROUP BY ix, iy""")
def _(t):
    return rounded(histograms.density_grid(t.catalog, "ra", "dec", (0.0, 360.0), (-90.0, 90.0), 60), 9)


@query("a22_hexbin", """WITH s AS (SELECT (y_true-25e2)/(375e2/50) AS sx, (y_pred-25e2)/(375e2/28) AS sy FROM v_test_pred
 WHERE y_true BETWEEN 25e2 AND 4e4 AND y_pred BETWEEN 25e2 AND 4e4),
 d AS (SELECT floor(sx+5e-1) AS i1, floor(sy+5e-1) AS j1, floor(sx) AS i2, floor(sy) AS j2, sx, sy FROM s),
 h AS (SELECT CASE WHEN (sx-i1)*(sx-i1)+3e0*(sy-j1)*(sy-j1) < (sx-i2-5e-1)*(sx-i2-5e-1)+3e0*(sy-j2-5e-1)*(sy-j2-5e-1) THEN 0 ELSE 1 END AS lattice, * FROM d)
 SELECT lattice, (CASE lattice WHEN 0 THEN i1 ELSE i2 END)::BIGINT AS ix, (CASE lattice WHEN 0 THEN j1 ELSE j2 END)::BIGINT AS iy, count(*) AS n,
 round(log10(count(*)),9) AS log_n FROM h GROUP BY 1,2,3""")
def _(t):
    return rounded(histograms.hexbin(t.test_pred, T, P, (2500.0, 40000.0), (2500.0, 40000.0), 50), 9)


@query("a27_missing_counts", """WITH c AS (SELECT count(*) FILTER (teff_gaia = -999e0) AS a, count(*) FILTER (logg_gaia = -999e0) AS b, count(*) FILTER (g = -999e0) AS c FROM v_catalog)
 SELECT * FROM (SELECT 'teff_gaia' AS "column", a AS n_missing FROM c UNION ALL SELECT 'logg_gaia', b FROM c UNION ALL SELECT 'g', c FROM c UNION ALL SELECT 'total', a+b+c FROM c)""")
def _(t):
    return metrics.missing_counts(t.catalog, ["teff_gaia", "logg_gaia", "g", "model_type"])


NUMBERS = ("g", "bp", "rp", "teff_gaia", "logg_gaia")


@query("a26_profile", "WITH clean AS (SELECT * REPLACE (nullif(teff_gaia,-999e0) AS teff_gaia, nullif(logg_gaia,-999e0) AS logg_gaia) FROM v_catalog) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'double' AS type, count({c}) AS n, count(*)-count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, round(min({c}),4) AS min,
 round(max({c}),4) AS max, round(avg({c}),4) AS mean, round(stddev_pop({c}),4) AS std, """ + ", ".join(f"round(quantile_cont({c},{p}::DOUBLE),4) AS {n}" for n, p in profile.QUANTILES.items())
    + " FROM clean" for c in NUMBERS))
def _(t):
    return neat(profile.profile_columns(t.catalog.select(*NUMBERS), exact=True))


@query("a26_profile_sketch", "WITH clean AS (SELECT * REPLACE (nullif(teff_gaia,-999e0) AS teff_gaia, nullif(logg_gaia,-999e0) AS logg_gaia) FROM v_catalog) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, count(*)-count({c}) AS n_missing, round(min({c}),4) AS min, round(max({c}),4) AS max, TRUE AS distinct_near, TRUE AS ordered FROM clean""" for c in NUMBERS))
def _(t):
    # The sketches: distinct counts within a fifth of the exact ones, quantiles in order and in range.
    sketch = profile.profile_columns(t.catalog.select(*NUMBERS))
    true = profile.profile_columns(t.catalog.select(*NUMBERS), exact=True).select("column", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.2 * F.col("exact") + 1
    chain = ["min", *profile.QUANTILES, "max"]
    ordered = [F.col(a) <= F.col(b) for a, b in zip(chain, chain[1:])]
    both = sketch.join(true, "column")
    return both.select("column", "n", "n_missing", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), near.alias("distinct_near"),
                       reduce(lambda a, b: a & b, ordered).alias("ordered"))


@query("a26_correlations", "WITH clean AS (SELECT * REPLACE (nullif(teff_gaia,-999e0) AS teff_gaia, nullif(logg_gaia,-999e0) AS logg_gaia) FROM v_catalog) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),8) AS corr FROM clean" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]))
def _(t):
    return rounded(profile.correlations(t.catalog, NUMBERS), 8)


@query("a26_top_values", "SELECT model_type AS value, count(*) AS n FROM v_catalog GROUP BY model_type ORDER BY n DESC, value LIMIT 10")
def _(t):
    return profile.top_values(t.catalog, "model_type")


CLEAN = "WITH clean AS (SELECT * REPLACE (nullif(teff_gaia,-999e0) AS teff_gaia, nullif(logg_gaia,-999e0) AS logg_gaia) FROM v_catalog) "


@query("a26_profile_histograms", CLEAN + " UNION ALL ".join(f"""SELECT '{c}' AS "column", b::INT AS bin, round(lo+b*w,6) AS bin_lo, round(lo+b*w+w,6) AS bin_hi, count({c}) AS n
 FROM (SELECT lo, w, b FROM (SELECT min({c}) AS lo, (max({c})-min({c}))/50 AS w FROM clean), range(50) r(b)) LEFT JOIN clean ON least(floor(({c}-lo)/w),49) = b GROUP BY b, lo, w""" for c in NUMBERS))
def _(t):
    parts = profile.profile_table(t.catalog.select("source_id", *NUMBERS), key="source_id")
    return parts["histograms"].where(F.col("column") != "source_id").select("column", "bin", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n")


@query("a26_profile_sample", CLEAN + "SELECT * FROM clean ORDER BY md5('42-' || source_id) LIMIT 10")
def _(t):
    return profile.profile_table(t.catalog, key="source_id")["sample"]


@query("a26_profile_top", CLEAN + """, o AS (SELECT 'model_type' AS "column", model_type AS value FROM clean)
 SELECT "column", value, count(*) AS n FROM o GROUP BY 1, 2 ORDER BY n DESC, value LIMIT 10""")
def _(t):
    return profile.profile_table(t.catalog)["top"]


@query("a32_feature_scores", SQL_COLOURS + ", s AS (SELECT * FROM colours WHERE teff_gaia > 0) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(pow(corr({c},teff_gaia),2)/(1-pow(corr({c},teff_gaia),2))*(count(*)-2),5) AS f_score FROM s" for c in ("bp_rp", "g_bp", "g_rp", "frequency")))
def _(t):
    return rounded(metrics.feature_scores(colours(t).where("teff_gaia > 0"), ["bp_rp", "g_bp", "g_rp", "frequency"], "teff_gaia"), 5)


@query("t3_top_features", SQL_COLOURS + ", s AS (SELECT * FROM colours WHERE teff_gaia > 0) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(pow(corr({c},teff_gaia),2)/(1-pow(corr({c},teff_gaia),2))*(count(*)-2),5) AS f_score FROM s" for c in ("bp_rp", "g_bp", "g_rp", "frequency"))
    + ") ORDER BY f_score DESC LIMIT 2")
def _(t):
    return rounded(metrics.top_features(colours(t).where("teff_gaia > 0"), ["bp_rp", "g_bp", "g_rp", "frequency"], "teff_gaia", 2), 5)


# ---- external catalogs ----------------------------------------------------------------------------------------

SQL_CROSS = """WITH x AS (SELECT c.source_id, c.teff_gaia, CASE WHEN power(1e1,e.logT1) >= 1e2 THEN power(1e1,e.logT1) END AS t1,
 CASE WHEN power(1e1,e.logT2) >= 1e2 THEN power(1e1,e.logT2) END AS t2 FROM v_catalog c JOIN v_components e USING (source_id) WHERE c.teff_gaia > 0)\n"""


def cross(t):
    ext = t.components.select("source_id", *[columns.decode_log_temperature(F.col(f"logT{i}")).alias(f"t{i}") for i in (1, 2)])
    return joins.cross_match(t.catalog.where(missing.has_original(F.col("teff_gaia"))).select("source_id", "teff_gaia"), ext)


@query("j8_cross_match", SQL_CROSS + "SELECT source_id, round(teff_gaia,4) AS teff_gaia, round(t1,4) AS t1, round(t2,4) AS t2 FROM x")
def _(t):
    return rounded(cross(t))


@query("j9_period_join", "SELECT source_id, logT1, logT2, Pday, 1e0/frequency AS period_days FROM v_components LEFT JOIN (SELECT source_id, frequency FROM v_params) USING (source_id)")
def _(t):
    freq = t.params.select("source_id", "frequency")
    joined = joins.cross_match(t.components, freq, how="left")
    return columns.with_period(joined).drop("frequency", "log_period")


@query("a33_pair_counts", SQL_CROSS + """SELECT 'gaia_t1' AS comparison, count(*) FILTER (t1 IS NOT NULL) AS n FROM x
 UNION ALL SELECT 'gaia_t2', count(*) FILTER (t2 IS NOT NULL) FROM x UNION ALL SELECT 't1_t2', count(*) FILTER (t1 IS NOT NULL AND t2 IS NOT NULL) FROM x""")
def _(t):
    has = {c: F.col(c).isNotNull() for c in ("t1", "t2")}
    return metrics.pair_counts(cross(t), {"gaia_t1": has["t1"], "gaia_t2": has["t2"], "t1_t2": has["t1"] & has["t2"]})


def kde_sql(lo, hi, bins):
    """Kernels of all data cells, inside the window or not, summed over the window without any cut."""
    w = f"{(hi - lo) / bins!r}::DOUBLE"
    return f"""WITH d AS (SELECT y_true AS x, y_pred AS y FROM v_test_pred), s AS (SELECT count(*) AS n, var_samp(x)*power(count(*)::DOUBLE,-1e0/3) AS vx,
 var_samp(y)*power(count(*)::DOUBLE,-1e0/3) AS vy, covar_samp(x,y)*power(count(*)::DOUBLE,-1e0/3) AS c FROM d),
 k AS (SELECT floor((x-{lo})/{w})::INT AS ix, floor((y-{lo})/{w})::INT AS iy, count(*) AS n FROM d GROUP BY 1,2),
 w AS (SELECT n AS total, vx, vy, c, vx*vy-c*c AS det FROM s),
 o AS (SELECT i AS ix, j AS iy FROM range({bins}) a(i), range({bins}) b(j)),
 z AS (SELECT o.ix::INT AS ix, o.iy::INT AS iy, k.n*exp(-5e-1*(pow((o.ix-k.ix)*{w},2)*vy-2*c*(o.ix-k.ix)*{w}*(o.iy-k.iy)*{w}+pow((o.iy-k.iy)*{w},2)*vx)/det)
  /(2*pi()*sqrt(det)*total) AS v FROM o, k, w)
 SELECT ix, iy, round(sum(v)*1e8,6) AS kde FROM z GROUP BY ix, iy"""


@query("a34_kernel_density", kde_sql(0, 30000, 40))
def _(t):
    k = histograms.kernel_density(t.test_pred, T, P, (0.0, 30000.0), (0.0, 30000.0), 40)
    return k.select("ix", "iy", F.round(F.col("kde") * F.lit(1e8), 6).alias("kde"))


@query("a34_kernel_density_window", kde_sql(5000, 12000, 30))
def _(t):
    # Most points lie outside this window.
    k = histograms.kernel_density(t.test_pred, T, P, (5000.0, 12000.0), (5000.0, 12000.0), 30)
    return k.select("ix", "iy", F.round(F.col("kde") * F.lit(1e8), 6).alias("kde"))


# ---- ranks ------------------------------------------------------------------------------------------------------

@query("w1_empirical_cdf", """SELECT DISTINCT y_true AS value, count(*) OVER (PARTITION BY y_true) AS n, round((rank() OVER (ORDER BY y_true)-1)/(count(*) OVER ()-1)::DOUBLE,9) AS cdf FROM v_test_pred""")
def _(t):
    return ranks.empirical_cdf(t.test_pred, T).select("value", "n", F.round("cdf", 9).alias("cdf"))


@query("w2_average_ranks", "SELECT DISTINCT frequency AS value, count(*) OVER (PARTITION BY frequency) AS n, rank() OVER (ORDER BY frequency)+(count(*) OVER (PARTITION BY frequency)-1)/2e0 AS avg_rank FROM v_catalog")
def _(t):
    return ranks.average_ranks(t.catalog, "frequency")


@query("w2_spearman_log_period", """WITH p AS (SELECT log10(1e0/frequency) AS x, teff_gaia AS y FROM v_catalog WHERE teff_gaia > 0),
 r AS (SELECT rank() OVER (ORDER BY x)+(count(*) OVER (PARTITION BY x)-1)/2e0 AS rx, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2e0 AS ry FROM p)
 SELECT round(corr(rx,ry),8) AS spearman FROM r""")
def _(t):
    return rounded(agreement.spearman(columns.with_period(t.catalog.where("teff_gaia > 0")), "log_period", "teff_gaia"), 8)


@query("h1_running_sums", """SELECT DISTINCT l_quantity AS value, sum(l_extendedprice) OVER (PARTITION BY l_quantity) > 0 AS positive, count(*) OVER (PARTITION BY l_quantity) AS n,
 rank() OVER (ORDER BY l_quantity)-1 AS n_before, count(*) OVER () AS n_total FROM lineitem""")
def _(t):
    r = ranks.running_sums(t.raw("lineitem"), "l_quantity", {"n": F.lit(1), "price": F.col("l_extendedprice")})
    return r.select("value", (F.col("price") > 0).alias("positive"), "n", "n_before", "n_total")


@query("s11_metrics_document", f"""WITH b AS ({sql_bins(TARGET_EDGES['teff'], 'left')}) SELECT 'demo' AS model_id, m.*, (SELECT count(*) FROM b) AS n_bins,
 (SELECT sum(n_samples) FROM b)::BIGINT AS n_binned FROM (SELECT {sql_metrics()} FROM v_test_pred) m""")
def _(t):
    m, b = neat(metrics.regression_metrics(t.test_pred, T, P)), neat(metrics.metrics_by_bin(t.test_pred, T, P))
    doc = metrics_document(m, b, "demo")
    return doc.select("*", F.size("value_bins").cast("long").alias("n_bins"),
                      F.aggregate("value_bins", F.lit(0).cast("long"), lambda s, x: s + x["n_samples"]).alias("n_binned")).drop("value_bins")
