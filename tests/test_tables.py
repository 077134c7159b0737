"""Joins, duplicates, ranks, splits, statistics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.operators import agreement, detections, encoding, ensemble, histograms, joins, metrics, profile, ranks, sampling

NAN = float("nan")


# ---- joins ------------------------------------------------------------------------------------------------------

def test_join_columns_rules(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.6)], "source_id long, g double")
    right = spark.createDataFrame([(1, 9.0, 7, "a"), (1, 8.0, 6, "b")], "sid long, g double, n int, s string")
    out = joins.join_columns(left, right, source_key="sid", columns=["g", "n", "s"], rename={"n": "count"})
    assert out.columns == ["source_id", "g", "count", "s"]  # g exists already
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == [(1, 0.5, 6, "b"), (1, 0.5, 7, "a"), (2, 0.6, -999, None)]
    assert joins.join_columns(left, right, source_key="sid", columns=["g"]) is left
    with pytest.raises(ValueError):
        joins.join_columns(left, right, source_key="sid", columns=["n"], unique=True)
    with pytest.raises(ValueError):
        joins.join_columns(left, right, columns=["n"])
    with pytest.raises(ValueError):
        joins.join_columns(left, right, source_key="sid", columns=["absent"])


def test_merge_restriction_and_missing_tables(spark):
    base = spark.createDataFrame([(1, -999.0), (2, 5000.0), (3, None)], "source_id long, teff_gaia_original double")
    a = spark.createDataFrame([(1, 10.0, 1.0)], "source_id long, value double, unc double")
    chain = spark.createDataFrame([(1, 20.0, 2.0), (2, 20.0, 2.0), (3, 20.0, 2.0)], "source_id long, value double, unc double")
    with_other = joins.merge_predictions(base, {"a": a, "gone": None, "c": chain}, restricted=["c"])
    assert {r["source_id"]: r["c"] for r in with_other.collect()} == {1: 20.0, 2: None, 3: None}
    alone = joins.merge_predictions(base, {"c": chain}, restricted=["c"])
    assert {r["source_id"]: r["c"] for r in alone.collect()} == {1: 20.0, 2: None, 3: 20.0}
    with pytest.raises(ValueError):
        joins.merge_predictions(base, {"gone": None})


def test_best_of_ties_and_invalid(spark):
    rows = [(1, 10.0, 5.0, 20.0, 5.0), (2, 10.0, 0.0, 20.0, 7.0), (3, 10.0, -1.0, None, 2.0), (4, -999.0, 1.0, 20.0, 3.0), (5, NAN, 1.0, 20.0, NAN)]
    df = spark.createDataFrame(rows, "id int, a double, a_uncertainty double, b double, b_uncertainty double")
    out = {r["id"]: (r["teff_best"], r["teff_best_uncertainty"], r["w"]) for r in ensemble.best_of(df, ["a", "b"], winner="w").collect()}
    assert out == {1: (10.0, 5.0, "a"), 2: (20.0, 7.0, "b"), 3: (None, None, None), 4: (20.0, 3.0, "b"), 5: (None, None, None)}
    share = {r["model"]: (r["n_best"], r["share"]) for r in ensemble.winner_share(df, ["a", "b"]).collect()}
    assert share["a"][0] == 1 and share["b"][0] == 2 and sum(s for _, s in share.values()) == pytest.approx(100.0)


def test_detection_merge(spark):
    rows = [(1, 14.0, 0.1), (1, 15.0, 0.2), (1, -999.0, 0.1), (2, 14.0, -999.0), (2, 16.0, 0.0), (3, -999.0, 0.1)]
    df = spark.createDataFrame(rows, "original_ext_source_id long, gPSFMag double, gPSFMagErr double")
    out = {r[0]: (r[1], r[2]) for r in detections.merge_detections(df, ["g"]).collect()}
    w = np.array([100.0, 25.0])
    assert out[1] == pytest.approx(((14.0 * w[0] + 15.0 * w[1]) / w.sum(), 1 / math.sqrt(w.sum())))
    assert out[2] == (15.0, -999.0) and out[3] == (-999.0, -999.0)
    assert sorted(r[0] for r in detections.duplicate_detections(df).collect()) == [1, 1, 1, 2, 2]


def test_no_overlap_raises(spark):
    a, b = (spark.createDataFrame([(i,)], "source_id long") for i in (1, 2))
    with pytest.raises(ValueError):
        joins.join_test_set(a, b)


# ---- ranks ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, another group is far away."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(1000, 5.0), rng.normal(0, 1, 1500), rng.normal(1e6, 1, 500)])
    rng.shuffle(x)
    group = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(i), float(v), int(g)) for i, (v, g) in enumerate(zip(x, group))], "source_id long, x double, grp int")
    return df.repartition(5), x, group


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_running_sums(skewed, buckets):
    df, x, _ = skewed
    rows = ranks.running_sums(df, "x", buckets=buckets).orderBy("value").collect()
    values, counts = np.unique(x, return_counts=True)
    assert [r["value"] for r in rows] == values.tolist() and [r["n"] for r in rows] == counts.tolist()
    assert [r["n_before"] for r in rows] == (np.cumsum(counts) - counts).tolist()
    assert [r["next_value"] for r in rows] == [*values[1:].tolist(), None]
    assert {r["n_total"] for r in rows} == {len(x)}


def test_running_sums_by_group(skewed):
    df, x, group = skewed
    rows = ranks.average_ranks(df, "x", by=["grp"]).where("value = 5.0").collect()
    for r in rows:
        mine = x[group == r["grp"]]
        assert r["avg_rank"] == (mine < 5.0).sum() + ((mine == 5.0).sum() + 1) / 2


@pytest.mark.parametrize("buckets", [1, 5, 200])
def test_exact_quantiles(skewed, buckets):
    df, x, group = skewed
    probs = {"lo": 0.0, "a": 0.16, "m": 0.5, "b": 0.84, "p": 0.9993, "hi": 1.0}
    row = ranks.exact_quantiles(df, "x", probs, buckets=buckets).first()
    assert [row[n] for n in probs] == pytest.approx(np.quantile(x, list(probs.values())).tolist(), rel=1e-12)
    for r in ranks.exact_quantiles(df, "x", probs, by=["grp"], buckets=buckets).collect():
        assert [r[n] for n in probs] == pytest.approx(np.quantile(x[group == r["grp"]], list(probs.values())).tolist(), rel=1e-12)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(3.0,), (None,), (NAN,), (1.0,)], "x double")
    assert ranks.quantile_values(df, "x", [0.5]) == [2.0]
    assert ranks.quantile_edges(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (9.0,)], "x double"), "x", 4) == [1.0, 3.0, 9.0]
    assert ranks.quantile_values(df.where("x > 100"), "x", [0.5]) == []


def test_empirical_cdf_thinning(skewed):
    df, x, _ = skewed
    full = ranks.empirical_cdf(df, "x").count()
    thin = ranks.empirical_cdf(df, "x", points=50).orderBy("value").collect()
    assert 30 <= len(thin) <= 110 < full and thin[-1]["value"] == x.max()


# ---- splits -----------------------------------------------------------------------------------------------------

def test_split_is_exact_and_stable(skewed):
    df, x, _ = skewed
    hot = df.withColumn("stratum", F.when(F.col("x") == 5.0, "hot").otherwise(F.col("grp").cast("string")))
    first = {r["source_id"]: r["split"] for r in sampling.split(hot, strata=["stratum"]).collect()}
    again = {r["source_id"]: r["split"] for r in sampling.split(hot.repartition(11).orderBy(F.desc("x")), strata=["stratum"]).collect()}
    assert first == again and len(first) == len(x)
    sizes = {r["stratum"]: r["count"] for r in hot.groupBy("stratum").count().collect()}
    test = {r["stratum"]: r["count"] for r in sampling.split(hot, strata=["stratum"]).where("split = 'test'").groupBy("stratum").count().collect()}
    assert test == {s: math.floor(0.2 * n + 0.5) for s, n in sizes.items()}
    other = {r["source_id"]: r["split"] for r in sampling.split(hot, seed=7, strata=["stratum"]).collect()}
    assert other != first


def test_split_keeps_copies_of_an_id_together(spark):
    rows = [(i % 10, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "source_id long, x double")
    per_id = sampling.split(df).groupBy("source_id").agg(F.count_distinct("split").alias("k")).collect()
    assert all(r["k"] == 1 for r in per_id)


def test_strata_fall_back(spark):
    rows = [(i, 100.0 + i, "a" if i else "rare") for i in range(100)]
    df = spark.createDataFrame(rows, "source_id long, y double, c string")
    assert sampling.with_strata(df, "y", 4, ["c"]).select("stratum").distinct().count() == 4  # bins only
    tiny = df.limit(6)
    assert [r[0] for r in sampling.with_strata(tiny, "y", 4).select("stratum").distinct().collect()] == ["all"]
    hot = sampling.with_strata(df.withColumn("y", F.col("y") * 1000), "y", 4, hot_threshold=10000.0)
    assert [r[0] for r in hot.select("stratum").distinct().collect()] == ["hot"]


def test_samples(skewed):
    df, x, _ = skewed
    assert sampling.fixed_size_sample(df, 777).count() == 777
    assert sampling.fixed_size_sample(df, 10 ** 6).count() == len(x)
    inner = {r[0] for r in sampling.fixed_size_sample(df, 100).select("source_id").collect()}
    outer = {r[0] for r in sampling.fixed_size_sample(df, 300).select("source_id").collect()}
    assert inner < outer
    assert abs(sampling.stratified_sample(df, 600, ["grp"]).count() - 600) <= 3
    parts = {r["part"]: r["count"] for r in sampling.positional_split(df, {"a": 10, "b": 30}).groupBy("part").count().collect()}
    assert parts == {"a": 10, "b": 20, None: len(x) - 30}


def test_one_per_bin(spark):
    df = spark.createDataFrame([(i, 2500.0 + 10 * i) for i in range(200)], "source_id long, y double")
    rows = sampling.one_per_bin(df, "y").orderBy("bin_lo").collect()
    assert [(r["bin_lo"], r["bin_count"]) for r in rows] == [(3000.0, 100), (4000.0, 50)]
    assert all(r["bin_lo"] <= r["y"] < r["bin_lo"] + 1000 for r in rows)


def test_encodings_of_unseen_levels(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    hot = encoding.fit_encoder(train, ["c"])
    assert hot.output_names() == ["c_a", "c_b"]
    assert [tuple(r) for r in hot.transform(new).collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    assert [r["c"] for r in encoding.fit_encoder(train, ["c"], "ordinal").transform(new).collect()] == [0.0, -1.0, -1.0]


# ---- statistics -------------------------------------------------------------------------------------------------

def test_single_row_bin_and_constant_target(spark):
    df = spark.createDataFrame([(4500.0, 4600.0), (7000.0, 7000.0), (7000.0, 7100.0)], "true_value double, predicted_value double")
    rows = {r["value_min"]: r for r in metrics.metrics_by_bin(df).collect()}
    assert rows[4000.0]["r2"] is None and rows[6000.0]["r2"] is None and set(rows) == {4000.0, 6000.0}


def test_histogram_counts_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,), (10.0,)], "x double")
    rows = histograms.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == np.histogram([0, 1, 9, 10], 5)[0].tolist()
    assert [r["density"] for r in rows] == pytest.approx(np.histogram([0, 1, 9, 10], 5, density=True)[0].tolist())


def test_comparison_suite(skewed):
    df, x, _ = skewed
    rng = np.random.default_rng(5)
    pairs = df.withColumn("y", F.col("x") + F.col("grp") * 0.25).select("x", "y").toPandas().to_numpy()
    x, y = pairs[:, 0], pairs[:, 1]
    got = agreement.comparison_metrics(df.withColumn("y", F.col("x") + F.col("grp") * 0.25), "x", "y").first()

    def rank(v):
        values, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - counts + (counts + 1) / 2)[inverse]

    assert got["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-10)
    assert got["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-10)
    d = x - y
    assert got["median_diff"] == pytest.approx(np.median(d)) and got["mad_diff"] == pytest.approx(np.median(np.abs(d - np.median(d))))
    grid = np.unique(np.concatenate([x, y]))
    f1, f2 = (np.searchsorted(np.sort(v), grid, "right") / len(v) for v in (x, y))
    assert got["ks_stat"] == pytest.approx(np.abs(f1 - f2).max())
    assert got["wasserstein"] == pytest.approx((np.abs(f1 - f2)[:-1] * np.diff(grid)).sum(), rel=1e-9)
    assert 0.0 <= got["ks_p"] <= 1.0


def test_ks_p_value_limits(spark):
    df = spark.createDataFrame([(0.0,), (0.02,), (0.5,)], "d double")
    p = [r[0] for r in df.select(agreement.ks_p_value(F.col("d"), F.lit(1000.0), F.lit(1000.0))).collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(0.988, abs=0.005) and p[2] < 1e-100


def test_kernel_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(0, 1, (3000, 2))
    df = spark.createDataFrame(pts.tolist(), "x double, y double")
    k = histograms.kernel_density(df, "x", "y", (-6.0, 6.0), (-6.0, 6.0), 60).agg(F.sum("kde")).first()[0]
    assert k * (12 / 60) ** 2 == pytest.approx(1.0, abs=0.01)


def test_coverage_adds_up(tables):
    r = metrics.coverage_overlap(tables.catalog, F.col("teff_gaia") > 0, F.col("logg_gaia") > 0).first()
    assert r["n_both"] + r["n_only_a"] + r["n_only_b"] + r["n_neither"] == r["n_total"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinal_levels_beyond_literals(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_LITERALS", 10)
    rows = spark.range(3000).select("id", F.concat(F.lit("k"), F.col("id") % 997).alias("kind"))
    fitted = encoding.fit_encoder(rows.where("kind <> 'k5'"), ["kind"], "ordinal")
    assert not fitted.levels and fitted.output_names() == ["kind"]
    out = encoding.CategoryEncoder.from_dict(fitted.to_dict()).transform(rows)
    want = {k: float(i) for i, k in enumerate(sorted(f"k{i}" for i in range(997) if i != 5))} | {"k5": -1.0}
    assert out.columns == ["id", "kind"] and out.count() == 3000
    assert all(r["kind"] == want[f"k{r['id'] % 997}"] for r in out.collect())
    with pytest.raises(ValueError):
        monkeypatch.setattr(encoding, "MAX_COLUMNS", 10)
        encoding.fit_encoder(rows, ["kind"])


def test_one_per_bin_keeps_fixed_state(spark):
    df = spark.createDataFrame([(i % 40, 3000.0 + (i * 37) % 5000, f"n{i}") for i in range(400)], "source_id long, t double, name string")
    text = plan_of(sampling.one_per_bin(df, "t"))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    out = sampling.one_per_bin(df, "t").collect()
    assert len(out) == 5 and sum(r["bin_count"] for r in out) == 400
    import hashlib
    key = lambda i: hashlib.md5(f"41-{i}".encode()).hexdigest()
    for r in out:
        ids = {i % 40 for i in range(400) if 3000 + (i * 37) % 5000 >= r["bin_lo"] and 3000 + (i * 37) % 5000 < r["bin_lo"] + 1000}
        assert r["source_id"] == min(ids, key=key) and r["bin_lo"] <= r["t"] < r["bin_lo"] + 1000


def test_key_numbers_keep_the_order_of_keys(spark):
    rows = spark.range(500).select(sampling.sample_key("id", 1).alias("k")).select("k", sampling.key_number(F.col("k")).alias("n")).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(r["k"] for r in rows)


def test_kernel_density_counts_points_outside(spark):
    rng = np.random.default_rng(3)
    pts = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 2]], 4000)
    df = spark.createDataFrame(pts.tolist(), "x double, y double")
    cov = np.cov(pts.T) * 4000 ** (-1 / 3)
    inv, peak = np.linalg.inv(cov), 1 / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * 4000)

    def exact(x, y):
        u = np.array([x, y]) - pts
        return peak * np.exp(-0.5 * np.einsum("ni,ij,nj->n", u, inv, u)).sum()
    for window in ((1.0, 1.4), (-2.0, 2.0)):  # most points outside and cells far below the bandwidth; a wider window
        k = histograms.kernel_density(df, "x", "y", window, window, 40).collect()
        assert len(k) == 1600
        step = (window[1] - window[0]) / 40
        for r in k[::97]:
            at = (window[0] + (r["ix"] + 0.5) * step, window[0] + (r["iy"] + 0.5) * step)
            assert r["kde"] == pytest.approx(exact(*at), rel=0.05, abs=1e-3)
    with pytest.raises(ValueError):
        histograms.kernel_density(df.withColumn("y", F.col("x")), "x", "y", (0.0, 1.0), (0.0, 1.0))


def test_density_map_repeats_no_row(spark, tables):
    text = plan_of(histograms.mixture_density_map(tables.test_pred, "y_true", 20))
    assert "Generate" not in text and "MapInArrow" in text


def test_exact_profile_in_long_form(spark):
    rows = [(i, float(i % 7) if i % 5 else None, "ab"[i % 2] if i % 3 else None, NAN if i == 4 else -999.0 if i == 6 else i / 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, x double, s string, y double")
    out = profile.profile_columns(df, exact=True)
    assert "Expand" not in plan_of(out)
    got = {r["column"]: r for r in out.collect()}
    assert {c: (r["n"], r["n_missing"], r["n_distinct"]) for c, r in got.items()} == {"i": (60, 0, 60), "x": (48, 12, 7), "s": (40, 20, 2), "y": (58, 2, 58)}
    y = np.array([r[3] for r in rows if r[0] not in (4, 6)])
    assert got["y"]["p25"] == pytest.approx(np.quantile(y, 0.25)) and got["y"]["p95"] == pytest.approx(np.quantile(y, 0.95)) and got["s"]["p50"] is None
    parts = profile.profile_table(df, bins=5, sample=3, key="i", exact=True)
    assert set(parts) == {"columns", "top", "histograms", "correlations", "sample"} and parts["sample"].count() == 3
    counts, edges = np.histogram(y, 5)
    hist = parts["histograms"].where("column = 'y'").orderBy("bin").collect()
    assert [h["n"] for h in hist] == counts.tolist() and [h["bin_lo"] for h in hist] == pytest.approx(edges[:-1].tolist())
    assert [(r["value"], r["n"]) for r in parts["top"].orderBy("value").collect()] == [("a", 20), ("b", 20)]
    empty = profile.profile_columns(df.limit(0), exact=True).collect()
    assert {r["n"] for r in empty} == {0} and {r["n_distinct"] for r in empty} == {0}
    assert profile.profile_table(df.limit(0))["histograms"].count() == 0


def test_agreement_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 1, 700), 1)
    y = np.round(x + rng.normal(0.2, 0.5, 700), 1)
    r = agreement.comparison_metrics(spark.createDataFrame([*zip(x.tolist(), y.tolist()), (NAN, 1.0), (2.0, None)], "x double, y double"), "x", "y").first()
    d = x - y
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert r["n"] == 700 and r["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert [r[c] for c in ("p16_diff", "median_diff", "p84_diff")] == pytest.approx(np.quantile(d, [0.16, 0.5, 0.84]).tolist())
    assert r["mad_diff"] == pytest.approx(np.median(np.abs(d - np.median(d))))
    at = np.unique(np.concatenate([x, y]))
    f1, f2 = ((v[None, :] <= at[:, None]).mean(1) for v in (x, y))
    assert r["ks_stat"] == pytest.approx(np.abs(f1 - f2).max()) and r["wasserstein"] == pytest.approx((np.abs(f1 - f2)[:-1] * np.diff(at)).sum())
    empty = agreement.comparison_metrics(spark.createDataFrame([(NAN, 1.0)], "x double, y double"), "x", "y").first()
    assert empty["n"] == 0 and empty["median_diff"] is None and empty["mad_diff"] is None
    report = agreement.distribution_report(spark.createDataFrame([(v,) for v in x.tolist()], "v double"), "v", spark.createDataFrame([(v,) for v in y[:301].tolist()], "v double"), "v").first()
    assert (report["n_a"], report["n_b"]) == (700, 301) and report["median_b"] == pytest.approx(np.median(y[:301])) and report["median_a"] == pytest.approx(np.median(x))
