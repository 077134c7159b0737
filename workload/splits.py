"""Splits, samples, encodings and configuration tables."""

from pyspark.sql import functions as F

from skyfold.functions.binning import quantile_bin
from skyfold.operators import encoding, metrics, ranks, sampling
from skyfold.sources import artifacts
from workload.merging import rounded
from workload.standin import query
from workload.statistics import neat, sql_metrics


def md5_order(seed, key="source_id"):
    return f"md5('{seed}-' || CAST({key} AS VARCHAR))"


# Quantile edges of the target's cool part, their bins, and the strata of bins and categories.
SQL_STRATA = """WITH rows AS (SELECT source_id, teff_gaia, model_type FROM v_catalog WHERE teff_gaia > 0),
 e AS (SELECT quantile_cont(teff_gaia, [i/5e0 FOR i IN range(6)]) AS e FROM rows WHERE teff_gaia <= 1e4),
 s AS (SELECT r.*, CASE WHEN teff_gaia > 1e4 THEN 'hot' ELSE CAST((teff_gaia > e[2])::INT + (teff_gaia > e[3])::INT + (teff_gaia > e[4])::INT
  + (teff_gaia > e[5])::INT AS VARCHAR) END || '_' || model_type AS stratum FROM rows r, e),
 k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY """ + md5_order(42) + """) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s)
"""


def with_target(t):
    return t.catalog.where("teff_gaia > 0").select("source_id", "teff_gaia", "model_type")


@query("a31_quantile_bins", """WITH e AS (SELECT quantile_cont(y_true, [i/10e0 FOR i IN range(11)]) AS e FROM v_test_pred)
 SELECT source_id, """ + " + ".join(f"(y_true > e[{i}])::INT" for i in range(2, 11)) + " AS bin FROM v_test_pred, e")
def _(t):
    edges = ranks.quantile_edges(t.test_pred, "y_true", 10)
    return t.test_pred.select("source_id", quantile_bin(F.col("y_true"), edges).alias("bin"))


@query("a30_stratum_census", "SELECT count(*) AS n_strata, min(n) AS smallest FROM (SELECT model_type, teff_gspphot_flag, count(*) AS n FROM v_catalog GROUP BY ALL)")
def _(t):
    return sampling.stratum_census(t.catalog, ["model_type", "teff_gspphot_flag"])


@query("w3_stratified_split", SQL_STRATA + "SELECT source_id, stratum, CASE WHEN rn <= round(2e-1*n) THEN 'test' ELSE 'train' END AS split FROM k")
def _(t):
    out = sampling.stratified_split(with_target(t), "teff_gaia", 5, categories=["model_type"])
    return out.select("source_id", "stratum", "split")


@query("w4_strata", SQL_STRATA + "SELECT stratum, count(*) AS n FROM s GROUP BY stratum")
def _(t):
    return sampling.with_strata(with_target(t), "teff_gaia", 5, ["model_type"]).groupBy("stratum").agg(F.count("*").alias("n"))


@query("w5_random_split", "SELECT source_id, CASE WHEN row_number() OVER (ORDER BY " + md5_order(42) + """) <= round(2e-1*count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM v_catalog""")
def _(t):
    return sampling.split(t.catalog.select("source_id"))


@query("w6_one_per_bin", """SELECT 3e3+floor((y_true-3e3)/1e3)*1e3 AS bin_lo, count(*) AS bin_count, arg_min(source_id, """ + md5_order(41) + """) AS source_id
 FROM v_test_pred WHERE y_true >= 3e3 GROUP BY 1""")
def _(t):
    return sampling.one_per_bin(t.test_pred, "y_true").select("bin_lo", "bin_count", "source_id")


@query("w7_fixed_size_sample", "SELECT source_id, y_true FROM v_test_pred ORDER BY " + md5_order(42) + " LIMIT 1000")
def _(t):
    return sampling.fixed_size_sample(t.test_pred.select("source_id", "y_true"), 1000)


@query("w8_stratified_subsample", """SELECT source_id, model_type FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY """ + md5_order(42) + """) AS rn,
 count(*) OVER (PARTITION BY model_type) AS n, count(*) OVER () AS total FROM v_catalog) WHERE rn <= round(n*(5000/total::DOUBLE))""")
def _(t):
    return sampling.stratified_sample(t.catalog.select("source_id", "model_type"), 5000, ["model_type"])


@query("w9_positional_split", """SELECT source_id, CASE WHEN rn <= 300 THEN 'train' WHEN rn <= 400 THEN 'valid' WHEN rn <= 450 THEN 'test' END AS part
 FROM (SELECT source_id, row_number() OVER (ORDER BY """ + md5_order(35325) + ") AS rn FROM v_cutouts)")
def _(t):
    return sampling.positional_split(t.cutouts.select("source_id"), {"train": 300, "valid": 400, "test": 450})


@query("m1_one_hot", "SELECT source_id, " + ", ".join(
    f"""CASE WHEN model_type = '{v}' THEN 1e0 ELSE 0e0 END AS "model_type_{v}" """ for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM v_catalog")
def _(t):
    enc = encoding.fit_encoder(t.catalog, ["model_type"])
    return enc.transform(t.catalog.select("source_id", "model_type"))


@query("m2_ordinal", """WITH l AS (SELECT model_type, row_number() OVER (ORDER BY model_type)-1 AS i FROM (SELECT DISTINCT model_type FROM v_catalog WHERE teff_gaia > 0 AND model_type <> '2-HIGH'))
 SELECT source_id, coalesce(i,-1)::DOUBLE AS model_type FROM v_catalog LEFT JOIN l USING (model_type)""")
def _(t):
    train = t.catalog.where("teff_gaia > 0 and model_type <> '2-HIGH'")
    return encoding.fit_encoder(train, ["model_type"], "ordinal").transform(t.catalog.select("source_id", "model_type"))


@query("m2_ordinal_many_levels", """WITH l AS (SELECT DISTINCT 'star-' || o_orderkey AS level FROM orders WHERE o_orderstatus <> 'P'),
 n AS (SELECT level, row_number() OVER (ORDER BY level)-1 AS i FROM l)
 SELECT o_orderkey AS source_id, coalesce(i,-1)::DOUBLE AS name_ordinal FROM orders LEFT JOIN n ON level = 'star-' || o_orderkey""")
def _(t):
    stars = t.raw("orders").select(F.col("o_orderkey").alias("source_id"), "o_orderstatus", F.concat(F.lit("star-"), F.col("o_orderkey").cast("string")).alias("name"))
    fitted = encoding.fit_encoder(stars.where("o_orderstatus <> 'P'"), ["name"], "ordinal")
    return encoding.CategoryEncoder.from_dict(fitted.to_dict()).transform(stars, drop=False).select("source_id", "name_ordinal")


@query("m3_saved_encoding", """SELECT source_id, CASE WHEN model_type = '1-URGENT' THEN 1e0 ELSE 0e0 END AS "model_type_1-URGENT",
 CASE WHEN model_type = '5-LOW' THEN 1e0 ELSE 0e0 END AS "model_type_5-LOW" FROM v_catalog""")
def _(t):
    fitted = encoding.fit_encoder(t.catalog.where("model_type in ('1-URGENT', '5-LOW')"), ["model_type"])
    return encoding.CategoryEncoder.from_dict(fitted.to_dict()).transform(t.catalog.select("source_id", "model_type"))


@query("m4_standardise", """WITH s AS (SELECT avg(g) AS mg, stddev_pop(g) AS sg, avg(bp) AS mb, stddev_pop(bp) AS sb FROM v_catalog WHERE teff_gaia > 0)
 SELECT source_id, round((g-mg)/sg,8) AS g_scaled, round((bp-mb)/sb,8) AS bp_scaled FROM v_catalog, s""")
def _(t):
    scaler = encoding.fit_standardiser(t.catalog.where("teff_gaia > 0"), ["g", "bp"])
    return rounded(scaler.transform(t.catalog).select("source_id", "g_scaled", "bp_scaled"), 8)


@query("m20_shared_test", SQL_STRATA + f"SELECT {sql_metrics('teff_gaia', 'y_pred')} FROM k JOIN v_test_pred p USING (source_id) WHERE rn <= round(2e-1*n)")
def _(t):
    test = sampling.stratified_split(with_target(t), "teff_gaia", 5, categories=["model_type"]).where("split = 'test'")
    joined = test.join(t.test_pred.select("source_id", "y_pred"), "source_id")
    return neat(metrics.regression_metrics(joined, "teff_gaia", "y_pred"))


@query("m15_penalised_objective", """SELECT source_id, round(y_pred/1e1 + 5e-1*abs(y_true/1e1-y_pred/1e1),6) AS objective, round(abs(y_true/1e1-y_pred/1e1),6) AS gap FROM v_test_pred""")
def _(t):
    from skyfold.operators.tuning import penalised
    trials = t.test_pred.select("source_id", (F.col("y_true") / F.lit(10.0)).alias("train"), (F.col("y_pred") / F.lit(10.0)).alias("val"))
    return rounded(penalised(trials, 0.5).select("source_id", "objective", "gap"), 6)


@query("m18_signature_cache", """SELECT model_type, substring(sha256('features=bp,rp|model_type=' || model_type || '|n=' || CAST(count(*) AS VARCHAR)),1,16) AS signature FROM v_catalog GROUP BY model_type""")
def _(t):
    from skyfold.operators.tuning import signature_column
    configs = t.catalog.groupBy("model_type").agg(F.count("*").alias("n")).withColumn("features", F.lit("bp,rp"))
    return configs.select("model_type", signature_column(["features", "model_type", "n"]).alias("signature"))


@query("s13_latest_model", """WITH r AS (SELECT 'rf_' || lower(replace(o_orderpriority,' ','_')) AS id_prefix, o_orderdate + to_seconds(o_custkey) AS ts, o_orderkey FROM orders)
 SELECT id_prefix, max(ts) AS trained_at, arg_max('models/' || id_prefix || '_' || strftime(ts,'%Y%m%d_%H%M%S'), ts) AS path FROM r GROUP BY id_prefix""")
def _(t):
    orders = t.raw("orders")
    prefix = F.concat(F.lit("rf_"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_"))))
    ts = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_custkey").cast("decimal(18,6)"))
    names = orders.select(F.concat(F.lit("models/"), prefix, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss")).alias("path"))
    return artifacts.latest_models(artifacts.parse_registry(names, "path"))
