"""Mixture scores, mixture fits, tree spreads, network outputs and image cutouts."""

from pyspark.sql import functions as F

from skyfold.constants import HART_DEN, HART_NUM
from skyfold.functions import images
from skyfold.functions import mixture as mx
from skyfold.operators import histograms, mixture_fit
from skyfold.session import stored
from skyfold.sources.tables import test_prediction_table
from workload.merging import rounded
from workload.standin import query
from workload.statistics import sql_histogram


def horner(x, coefficients):
    out = f"{coefficients[0]!r}::DOUBLE"
    for k in coefficients[1:]:
        out = f"({out}*{x}+{k!r}::DOUBLE)"
    return out


def sql_cdf(z):
    a = f"abs({z})"
    tail = f"(exp(-5e-1*{a}*{a})*{horner(a, HART_NUM)}/{horner(a, HART_DEN)})"
    return f"(CASE WHEN {z} > 0 THEN 1e0-{tail} ELSE {tail} END)"


def sql_pdf(z):
    return f"(exp(-5e-1*{z}*{z})/2.5066282746310002e0)"


K = range(3)
# Kernel terms of the score: each component against the truth, and each pair of components (own pairs included).
SQL_TERMS = "WITH t AS (" + " UNION ALL ".join(
    [f"SELECT source_id, gmm_weight_{k} AS f, y_true-gmm_mean_{k} AS m, gmm_sigma_{k}*1e0 AS s FROM v_test_pred" for k in K]
    + [f"SELECT source_id, -5e-1*gmm_weight_{i}*gmm_weight_{j}, gmm_mean_{i}-gmm_mean_{j}, sqrt(pow(gmm_sigma_{i},2)+pow(gmm_sigma_{j},2)) FROM v_test_pred"
       for i in K for j in K]) + f"""), z AS (SELECT *, m/s AS z FROM t),
 crps AS MATERIALIZED (SELECT source_id, sum(f*(2e0*s*{sql_pdf('z')}+m*(2e0*{sql_cdf('z')}-1e0))) AS crps FROM z GROUP BY source_id),
 c AS (""" + " UNION ALL ".join(f"SELECT source_id, gmm_weight_{k} AS w, (y_true-gmm_mean_{k})/gmm_sigma_{k} AS z FROM v_test_pred" for k in K) + f"""),
 pit AS MATERIALIZED (SELECT source_id, sum(w*{sql_cdf('z')}) AS pit FROM c GROUP BY source_id),
 scored AS MATERIALIZED (SELECT p.*, crps, pit FROM v_test_pred p JOIN crps USING (source_id) JOIN pit USING (source_id))
"""


def scored(t):
    return mx.with_mixture_scores(t.test_pred, "y_true")


@query("d1_normal_cdf", f"SELECT source_id, round({sql_pdf('z')},12) AS pdf, round({sql_cdf('z')},12) AS cdf FROM (SELECT source_id, (y_true-y_pred)/(gmm_sigma_2*1e0) AS z FROM v_test_pred)")
def _(t):
    z = (F.col("y_true") - F.col("y_pred")) / F.col("gmm_sigma_2")
    d = t.test_pred.select("source_id", z.alias("z"))
    return d.select("source_id", F.round(mx.normal_pdf(F.col("z")), 12).alias("pdf"), F.round(mx.normal_cdf(F.col("z")), 12).alias("cdf"))


@query("d2_mixture_crps", SQL_TERMS + "SELECT source_id, round(crps,6) AS crps FROM scored")
def _(t):
    return rounded(scored(t).select("source_id", "crps"), 6)


@query("d3_mixture_pit", SQL_TERMS + "SELECT source_id, round(pit,9) AS pit FROM scored")
def _(t):
    return rounded(scored(t).select("source_id", "pit"), 9)


SQL_MEAN = "gmm_weight_0*gmm_mean_0+gmm_weight_1*gmm_mean_1+gmm_weight_2*gmm_mean_2"


@query("d4_mixture_mean", f"SELECT source_id, round({SQL_MEAN},6) AS mixture_mean FROM v_test_pred")
def _(t):
    return rounded(scored(t).select("source_id", "mixture_mean"), 6)


@query("d5_mixture_variance", f"WITH m AS (SELECT *, {SQL_MEAN} AS mean FROM v_test_pred) SELECT source_id, round("
       + "+".join(f"gmm_weight_{k}*(pow(gmm_sigma_{k},2)+pow(gmm_mean_{k}-mean,2))" for k in K) + ",3) AS mixture_var FROM m")
def _(t):
    return rounded(scored(t).select("source_id", "mixture_var"), 3)


@query("d6_mixture_grid", """WITH s AS (SELECT source_id, list_min(tree_preds) AS lo, list_max(tree_preds) AS hi, sqrt(list_sum(list_transform(tree_preds,
 lambda x: pow(x-list_avg(tree_preds),2)))/len(tree_preds)) AS sd, 6e3+label*1e2 AS y FROM v_trees),
 b AS (SELECT source_id, least(lo,y)-3*sd AS lo, greatest(hi,y)+3*sd AS hi FROM s),
 x AS (SELECT source_id, i::INT AS grid_i, lo+(hi-lo)*i/49e0 AS grid_x FROM b, range(50) r(i))
 SELECT source_id, grid_i, round(grid_x,4) AS grid_x, round(1e6*(6e-1*exp(-5e-1*pow((grid_x-6e3)/8e2,2))/(8e2*sqrt(2*pi()))+4e-1*exp(-5e-1*pow((grid_x-7e3)/15e2,2))/(15e2*sqrt(2*pi()))),6) AS pdf,
 round(1e6*6e-1*exp(-5e-1*pow((grid_x-6e3)/8e2,2))/(8e2*sqrt(2*pi())),6) AS pdf_0 FROM x""")
def _(t):
    base = t.trees.select("source_id", "tree_preds", (F.lit(6e3) + F.col("label") * F.lit(1e2)).alias("y"),
                          *[F.lit(v).alias(f"gmm_{p}_{i}") for p, vs in (("weight", (0.6, 0.4)), ("mean", (6e3, 7e3)), ("sigma", (8e2, 15e2))) for i, v in enumerate(vs)])
    g = mx.with_mixture_grid(base, "tree_preds", "y", 50)
    return g.select("source_id", "grid_i", F.round("grid_x", 4).alias("grid_x"), F.round(F.col("pdf") * 1e6, 6).alias("pdf"), F.round(F.col("pdf_0") * 1e6, 6).alias("pdf_0"))


def sql_em(k, rounds):
    """Chained E- and M-steps over the unnested values, with the fit's start and variance floor."""
    ctes = [f"""v AS (SELECT source_id, unnest(tree_preds) AS x FROM v_trees),
 st AS (SELECT source_id, count(*) AS n, var_pop(x) AS s2, quantile_cont(x, [(j+5e-1)/{k} FOR j IN range({k})]) AS q FROM v GROUP BY source_id),
 p0 AS (SELECT source_id, j, 1e0/{k} AS w, q[j+1] AS mu, greatest(s2/{k * k},1e-6) AS var FROM st, range({k}) r(j))"""]
    for i in range(rounds):
        ctes.append(f"""d{i} AS (SELECT v.source_id, p.j, v.x, ln(p.w)-5e-1*ln(p.var)-5e-1*pow(v.x-p.mu,2)/p.var AS l, row_number() OVER () AS u FROM v JOIN p{i} p USING (source_id)),
 t{i} AS (SELECT source_id, x, max(l) AS top FROM d{i} GROUP BY source_id, x),
 e{i} AS (SELECT d.source_id, d.j, d.x, exp(l-top) AS e, sum(exp(l-top)) OVER (PARTITION BY d.source_id, d.x) AS s, count(*) OVER (PARTITION BY d.source_id, d.x, d.j) AS c FROM d{i} d JOIN t{i} USING (source_id, x)),
 m{i} AS (SELECT source_id, j, sum(e/s*c) AS mass, sum(e/s*c*x)/sum(e/s*c) AS mu FROM e{i} GROUP BY source_id, j),
 p{i + 1} AS (SELECT e.source_id, e.j, any_value(m.mass)/any_value(st.n) AS w, any_value(m.mu) AS mu, greatest(sum(e/s*c*pow(e.x-m.mu,2))/any_value(m.mass),1e-6) AS var
  FROM e{i} e JOIN m{i} m ON m.source_id = e.source_id AND m.j = e.j JOIN st ON st.source_id = e.source_id GROUP BY e.source_id, e.j)""")
    return "WITH " + ",\n ".join(ctes) + f""" SELECT source_id, rn::INT AS j, round(w,6) AS w, round(mu,3) AS mu, round(sqrt(var),3) AS sigma
 FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY mu)-1 AS rn FROM p{rounds})"""


@query("d7_fit_mixture", sql_em(2, 4))
def _(t):
    fitted = mixture_fit.fit_mixtures(t.trees.select("source_id", "tree_preds"), "tree_preds", 2, max_iter=4, tol=0.0)
    parts = F.array(*[F.struct(F.lit(i).alias("j"), *[F.col(f"gmm_{p}_{i}").alias(n) for p, n in (("weight", "w"), ("mean", "mu"), ("sigma", "sigma"))]) for i in range(2)])
    rows = fitted.select("source_id", F.explode(parts).alias("c")).select("source_id", "c.*")
    return rows.select("source_id", "j", F.round("w", 6).alias("w"), F.round("mu", 3).alias("mu"), F.round("sigma", 3).alias("sigma"))


def fit_checks(fitted, k, likelihood_of_one):
    """Invariants of fitted mixtures: weights add to 1, means in order, sigmas positive, likelihood not below that of one component."""
    w, mu, sd = mx.gmm_columns(fitted)
    n = F.col("gmm_n_components") if "gmm_n_components" in fitted.columns else F.lit(k)
    total = sum(w[1:], w[0])
    ordered = [(F.lit(i) >= n) | (mu[i - 1] <= mu[i]) for i in range(1, k)]
    padded = [(F.lit(i) < n) | ((w[i] == 0) & (mu[i] == 0) & (sd[i] == 1)) for i in range(k)]
    positive = [s > 0 for s in sd]
    every = lambda cs: F.array_min(F.array(*[c.cast("int") for c in cs])) == 1
    density = lambda x: sum((a * F.exp(F.lit(-0.5) * F.pow((x - m) / s, 2)) / s for a, m, s in zip(w[1:], mu[1:], sd[1:])),
                            w[0] * F.exp(F.lit(-0.5) * F.pow((x - mu[0]) / sd[0], 2)) / sd[0])
    loglik = mx.array_sum(F.transform("tree_preds", lambda x: F.log(density(x))))
    return fitted.select("source_id", (F.abs(total - 1) < 1e-9).alias("weights"), every([*ordered, F.lit(True)]).alias("ordered"), every(padded).alias("padded"),
                         every(positive).alias("positive"), (loglik >= likelihood_of_one - 1e-6).alias("likely"))


def one_normal():
    return -(F.size("tree_preds") * (F.log(mx.array_std(F.col("tree_preds"))) + F.lit(0.5)))


CHECKED = "SELECT source_id, TRUE AS weights, TRUE AS ordered, TRUE AS padded, TRUE AS positive, TRUE AS likely FROM v_trees"


@query("d7_fit_mixture_full", CHECKED)
def _(t):
    return fit_checks(mixture_fit.fit_mixtures(t.trees.select("source_id", "tree_preds"), "tree_preds", 5), 5, one_normal())


@query("d8_fit_mixture_bic", CHECKED)
def _(t):
    return fit_checks(mixture_fit.fit_mixtures_bic(t.trees.select("source_id", "tree_preds"), "tree_preds", 8), 8, one_normal())


@query("d9_component_counts", "SELECT TRUE AS mean, TRUE AS median, TRUE AS extremes")
def _(t):
    s = mixture_fit.component_count_statistics(mixture_fit.fit_mixtures_bic(t.trees.select("tree_preds"), "tree_preds", 8))
    inside = lambda c: F.col(c).between(F.col("min"), F.col("max"))
    return s.select(inside("mean").alias("mean"), inside("median").alias("median"), ((F.col("min") >= 1) & (F.col("max") <= 8)).alias("extremes"))


@query("t4_component_order", """WITH c AS (SELECT source_id, unnest([{'mu': gmm_mean_2-(source_id%7)*5e2, 'w': gmm_weight_2}, {'mu': gmm_mean_0, 'w': gmm_weight_0}, {'mu': gmm_mean_1, 'w': gmm_weight_1}]) AS c FROM v_test_pred)
 SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY c.mu)-1)::INT AS pos, c.mu AS mu, c.w AS w FROM c""")
def _(t):
    parts = [F.struct(F.col(f"gmm_weight_{i}").alias("w"), (F.col(f"gmm_mean_{i}") - ((F.col("source_id") % 7) * 5e2 if i == 2 else F.lit(0.0))).alias("mu"), F.col(f"gmm_sigma_{i}").alias("sigma")) for i in (2, 0, 1)]
    rows = t.test_pred.select("source_id", F.posexplode(mx.sort_components(F.array(*parts))).alias("pos", "c"))
    return rows.select("source_id", "pos", "c.mu", "c.w")


@query("d11_tree_spread", "SELECT source_id, round(list_avg(tree_preds),5) AS mean, round(sqrt(list_sum(list_transform(tree_preds, lambda x: pow(x-list_avg(tree_preds),2)))/len(tree_preds)),5) AS std FROM v_trees")
def _(t):
    return rounded(t.trees.select("source_id", mx.array_mean(F.col("tree_preds")).alias("mean"), mx.array_std(F.col("tree_preds")).alias("std")), 5)


# Components of a network's output: all 63 values of a row, the last element is the truth.
NETWORK = 21


def decomposed(t):
    mu, sd, w = mx.decompose_outputs(F.col("raw"), NETWORK)
    return t.outputs.select("source_id", "y", mu.alias("mu"), sd.alias("sd"), w.alias("w"))


SQL_OUT = """WITH o AS (SELECT source_id, y, raw[1:21] AS mu, list_transform(raw[22:42], lambda x: exp(x)) AS sd, list_transform(raw[43:63], lambda x: exp(x)/list_sum(list_transform(raw[43:63], lambda z: exp(z)))) AS w FROM v_outputs)\n"""


@query("d14_decompose_outputs", SQL_OUT + "SELECT source_id, " + ", ".join(f"round({c}[{i}],9) AS {c}_{i}" for c in ("mu", "sd", "w") for i in range(1, NETWORK + 1)) + " FROM o")
def _(t):
    return decomposed(t).select("source_id", *[F.round(F.col(c)[i - 1], 9).alias(f"{c}_{i}") for c in ("mu", "sd", "w") for i in range(1, NETWORK + 1)])


@query("d15_negative_log_likelihood", SQL_OUT + "SELECT source_id, round(-ln(" + "+".join(f"w[{i}]/sqrt(2*pi()*sd[{i}]*sd[{i}])*exp(-pow(y-mu[{i}],2)/(2*sd[{i}]*sd[{i}]))" for i in range(1, NETWORK + 1))
       + "),9) AS strict, round(-ln(" + "+".join(f"w[{i}]/(2*pi()*sd[{i}]*sd[{i}])*exp(-pow(y-mu[{i}],2)/(2*sd[{i}]*sd[{i}]))" for i in range(1, NETWORK + 1)) + "),9) AS unrooted FROM o")
def _(t):
    flat = decomposed(t).select("source_id", "y", *[F.col(c)[i].alias(f"{c}{i}") for c in ("mu", "sd", "w") for i in range(NETWORK)])
    cols = [[F.col(f"{c}{i}") for i in range(NETWORK)] for c in ("w", "mu", "sd")]
    return flat.select("source_id", *[F.round(mx.mixture_nll(*cols, F.col("y"), n), 9).alias(n) for n in ("strict", "unrooted")])


SQL_CELLS = "unnest(range(1, {n}+1)) AS band, unnest(imgs) AS img"


def long_images(df, bands):
    return df.select(*[c for c in df.columns if c != bands], F.posexplode(bands).alias("band", "img")).select(
        "*", F.posexplode("img").alias("pixel", "value")).drop("img")


SQL_LONG = """SELECT * EXCLUDE (img), unnest(range(len(img)))::INT AS pixel, unnest(img) AS value FROM (SELECT * EXCLUDE (bands), unnest(range(len(bands)))::INT AS band, unnest(bands) AS img FROM d)"""


@query("d16_band_differences", "WITH d AS (SELECT source_id, list_concat(bands, [" + ", ".join(
    f"list_transform(range(16), lambda p: bands[{i}][p+1]-bands[{j}][p+1])" for i in range(1, 5) for j in range(i + 1, 5)) + "]) AS bands FROM v_cutouts) " + SQL_LONG)
def _(t):
    return long_images(t.cutouts.select("source_id", images.band_differences(F.col("bands"), 4).alias("bands")), "bands")


@query("d17_image_cleaning", "SELECT source_id, target FROM v_cutouts WHERE len(list_filter(flatten(bands), lambda x: isnan(x))) = 0 AND len(list_filter(flatten(bands), lambda x: x <> 0)) > 0")
def _(t):
    return images.clean_images(t.cutouts).select("source_id", "target")


@query("d18_image_crop", "WITH d AS (SELECT source_id, list_transform(bands, lambda b: [b[6],b[7],b[10],b[11]]) AS bands FROM v_cutouts) " + SQL_LONG)
def _(t):
    return long_images(t.cutouts.select("source_id", images.crop(F.col("bands"), 4, 1, 3).alias("bands")), "bands")


@query("d19_rotations", """WITH d AS (SELECT source_id, target, 0 AS turn, bands FROM v_cutouts
 UNION ALL SELECT source_id, target, 1, list_transform(bands, lambda b: [b[4],b[8],b[12],b[16],b[3],b[7],b[11],b[15],b[2],b[6],b[10],b[14],b[1],b[5],b[9],b[13]]) FROM v_cutouts
 UNION ALL SELECT source_id, target, 2, list_transform(bands, lambda b: list_reverse(b)) FROM v_cutouts
 UNION ALL SELECT source_id, target, 3, list_transform(bands, lambda b: [b[13],b[9],b[5],b[1],b[14],b[10],b[6],b[2],b[15],b[11],b[7],b[3],b[16],b[12],b[8],b[4]]) FROM v_cutouts) """ + SQL_LONG)
def _(t):
    return long_images(images.augment_rotations(t.cutouts, 4), "bands")


# ---- reports on scores --------------------------------------------------------------------------------------------

@query("a23_pit_histogram", SQL_TERMS + ", h AS (" + sql_histogram("pit", "scored", 30, 0.0, 1.0) + """) SELECT bin, n, density, round((SELECT avg(pit) FROM scored),8) AS mean,
 round((SELECT stddev_pop(pit) FROM scored),8) AS std, round((SELECT median(pit) FROM scored),8) AS median FROM h""")
def _(t):
    h = histograms.pit_histogram(stored(scored(t).select("pit"), "scores"))
    return h.select("bin", "n", F.round("density", 9).alias("density"), *[F.round(c, 8).alias(c) for c in ("mean", "std", "median")])


@query("a24_crps_histogram", SQL_TERMS + """, e AS (SELECT min(crps) AS lo, max(crps) AS hi FROM scored)
 SELECT least(floor((crps-lo)/((hi-lo)/60))::INT,59) AS bin, count(*) AS n, round((SELECT avg(crps) FROM scored),4) AS mean, round((SELECT median(crps) FROM scored),4) AS median FROM scored, e GROUP BY 1""")
def _(t):
    h = histograms.crps_histogram(stored(scored(t).select("crps"), "scores")).where("n > 0")
    return h.select("bin", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@query("a25_density_map", """WITH e AS (SELECT greatest(quantile_cont(y_true,5e-3),25e2) AS lo, least(quantile_cont(y_true,995e-3),5e4) AS hi FROM v_test_pred),
 x AS (SELECT p.*, least(greatest(floor((y_true-lo)/((hi-lo)/200))::INT,0),199) AS ix, lo, (hi-lo)/200 AS step FROM v_test_pred p, e),
 d AS (SELECT ix, iy::INT AS iy, """ + "+".join(f"gmm_weight_{k}*exp(-5e-1*pow((lo+(iy+5e-1)*step-gmm_mean_{k})/gmm_sigma_{k},2))/(gmm_sigma_{k}*sqrt(2*pi()))" for k in K)
       + """ AS f FROM x, range(200) r(iy)) SELECT ix, iy, round(sum(f),8) AS density FROM d GROUP BY ix, iy""")
def _(t):
    d = histograms.mixture_density_map(t.test_pred, "y_true", 200)
    return d.select("ix", "iy", F.round("density", 8).alias("density"))


@query("s10_test_prediction_table", SQL_TERMS + """SELECT source_id, round(y_true,6) AS y_true, round(y_pred,6) AS y_pred, gmm_sigma_1*1e0 AS y_pred_uncertainty, """
       + ", ".join(f"round(gmm_{p}_{k},6) AS gmm_{p}_{k}" for p in ("weight", "mean", "sigma") for k in K) + ", round(crps,6) AS crps, round(pit,9) AS pit FROM scored")
def _(t):
    s = scored(t).withColumn("u", F.col("gmm_sigma_1"))
    out = test_prediction_table(s, "y_true", "y_pred", "u")
    return out.select(*[F.col(c) if c in ("source_id", "y_pred_uncertainty") else F.round(c, 9 if c == "pit" else 6).alias(c) for c in out.columns])
