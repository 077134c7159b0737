"""Predictive distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.functions import mixture as mx
from skyfold.operators import histograms, mixture_fit


def cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def table(spark, rows):
    """Rows of (y, [(w, mu, sigma), ...])."""
    k = len(rows[0][1])
    names = [f"gmm_{p}_{i} double" for p in ("weight", "mean", "sigma") for i in range(k)]
    data = [(float(y), *[float(c[j]) for j in range(3) for c in comps]) for y, comps in rows]
    return spark.createDataFrame(data, ", ".join(["y double", *names]))


def crps_brute(y, comps):
    a = lambda m, s: 2 * s * math.exp(-0.5 * (m / s) ** 2) / math.sqrt(2 * math.pi) + m * (2 * cdf(m / s) - 1)
    out = sum(w * a(y - m, s) for w, m, s in comps)
    return out - 0.5 * sum(w1 * w2 * a(m1 - m2, math.hypot(s1, s2)) for w1, m1, s1 in comps for w2, m2, s2 in comps)


def test_normal_cdf_accuracy(spark):
    z = np.linspace(-40, 40, 4001)
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    got = np.array([r[0] for r in df.select(mx.normal_cdf(F.col("z"))).collect()])
    assert np.abs(got - [cdf(v) for v in z]).max() < 1e-13


def test_scores_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(50):
        w = rng.dirichlet(np.ones(4))
        rows.append((rng.normal(5000, 500), list(zip(w, rng.normal(5000, 800, 4), rng.uniform(50, 500, 4)))))
    rows.append((5000, [(0.5, 4800, 100), (0.5, 4800, 100), (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)]))  # identical and padded
    out = mx.with_mixture_scores(table(spark, rows), "y").collect()
    for r, (y, comps) in zip(out, rows):
        assert r["crps"] == pytest.approx(crps_brute(y, comps), rel=1e-9)
        assert r["pit"] == pytest.approx(sum(w * cdf((y - m) / s) for w, m, s in comps), abs=1e-12)
        mean = sum(w * m for w, m, _ in comps)
        assert r["mixture_mean"] == pytest.approx(mean)
        assert r["mixture_var"] == pytest.approx(sum(w * (s * s + (m - mean) ** 2) for w, m, s in comps))


def test_one_component_is_the_gaussian_score(spark):
    y, mu, s = 5100.0, 5000.0, 80.0
    r = mx.with_mixture_scores(table(spark, [(y, [(1.0, mu, s)])]), "y").first()
    z = (y - mu) / s
    want = s * (z * (2 * cdf(z) - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
    assert r["crps"] == pytest.approx(want, rel=1e-12)


def test_pit_of_calibrated_draws_is_uniform(spark):
    rng = np.random.default_rng(4)
    rows = [(rng.normal(m, 100.0), [(1.0, m, 100.0)]) for m in rng.uniform(4000, 8000, 4000)]
    h = histograms.pit_histogram(mx.with_mixture_scores(table(spark, rows), "y").select("pit"), n_bins=10).collect()
    assert h[0]["mean"] == pytest.approx(0.5, abs=0.02) and h[0]["std"] == pytest.approx(math.sqrt(1 / 12), abs=0.01)
    assert all(abs(r["density"] - 1.0) < 0.2 for r in h) and sum(r["n"] for r in h) == 4000


def em_brute(x, k, iters):
    mu = np.quantile(x, (np.arange(k) + 0.5) / k)
    var, w = np.full(k, max(x.var() / k ** 2, 1e-6)), np.full(k, 1 / k)
    for _ in range(iters):
        p = w * np.exp(-0.5 * (x[:, None] - mu) ** 2 / var) / np.sqrt(var)
        r = p / p.sum(axis=1, keepdims=True)
        n = r.sum(axis=0)
        mu = (r * x[:, None]).sum(axis=0) / n
        var = np.maximum((r * (x[:, None] - mu) ** 2).sum(axis=0) / n, 1e-6)
        w = n / len(x)
    return w, mu, np.sqrt(var)


def test_fit_matches_brute_force_and_handles_ragged_rows(spark):
    rng = np.random.default_rng(6)
    data = [np.concatenate([rng.normal(5000, 100, n), rng.normal(7000, 200, m)]) for n, m in ((40, 20), (30, 30), (10, 25))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id int, t array<double>")
    for r in mixture_fit.fit_mixtures(df, "t", 2, max_iter=8, tol=0.0).collect():
        w, mu, sd = em_brute(data[r["id"]], 2, 8)
        order = np.argsort(mu)
        for j, i in enumerate(order):
            assert (r[f"gmm_weight_{j}"], r[f"gmm_mean_{j}"], r[f"gmm_sigma_{j}"]) == pytest.approx((w[i], mu[i], sd[i]), rel=1e-8)


def test_bic_selects_and_pads(spark):
    rng = np.random.default_rng(8)
    one, two = rng.normal(5000, 100, 200), np.concatenate([rng.normal(4000, 50, 100), rng.normal(9000, 50, 100)])
    constant = np.full(50, 6000.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate((one, two, constant))], "id int, t array<double>")
    out = {r["id"]: r for r in mixture_fit.fit_mixtures_bic(df, "t", 4).collect()}
    assert [out[i]["gmm_n_components"] for i in range(3)] == [1, 2, 1]
    assert (out[0]["gmm_weight_3"], out[0]["gmm_mean_3"], out[0]["gmm_sigma_3"]) == (0.0, 0.0, 1.0)
    for r in out.values():
        assert sum(r[f"gmm_weight_{i}"] for i in range(4)) == pytest.approx(1.0)
    assert out[1]["gmm_mean_0"] < out[1]["gmm_mean_1"]


def test_spread_is_population(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([5.0],)], "t array<double>")
    got = [r[0] for r in df.select(mx.array_std(F.col("t"))).collect()]
    assert got == pytest.approx([np.std([1, 2, 4]), 0.0])


def test_spread_folds_plain_numbers(spark):
    arrays = [[0.1] * 100, [1e9, 1e9 + 1, 1e9 + 2], [1e6, *[1.0] * 50], [], None, [1.0, None, 2.0], [None, 1.0], [1.0, math.nan], [math.inf, 1.0], [1.0, math.inf]]
    df = spark.createDataFrame(list(enumerate(arrays)), "id int, t array<double>").select("id", mx.array_std(F.col("t")).alias("std"))
    assert "struct" not in df._jdf.queryExecution().analyzed().toString()  # one row for every element
    got = [r["std"] for r in df.orderBy("id").collect()]
    assert got[0] == 0.0 and got[1:3] == pytest.approx([np.std(arrays[1]), np.std(arrays[2])], rel=1e-12)
    assert got[3:7] == [None] * 4 and all(math.isnan(x) for x in got[7:])


def test_negative_log_likelihood_far_from_the_data(spark):
    w, mu, sd = [F.lit(0.5), F.lit(0.5)], [F.lit(0.0), F.lit(1.0)], [F.lit(1.0), F.lit(1.0)]
    v = spark.range(1).select(mx.mixture_nll(w, mu, sd, F.lit(100.0))).first()[0]
    assert v == pytest.approx(99.0 ** 2 / 2 + math.log(2) + 0.5 * math.log(2 * math.pi), rel=1e-9)


def test_density_map_is_the_sum_of_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(y, [(0.7, y + 50, 300.0), (0.3, y - 80, 600.0)]) for y in rng.uniform(4000, 9000, 300)]
    grid = histograms.mixture_density_map(table(spark, rows), "y", 20).collect()
    y = np.array([r[0] for r in rows])
    lo, hi = np.quantile(y, [0.005, 0.995])
    edges = np.linspace(lo, hi, 21)
    ix, at = np.clip(np.digitize(y, edges) - 1, 0, 19), (edges[:-1] + edges[1:]) / 2
    want = np.zeros((20, 20))
    for i, (_, comps) in zip(ix, rows):
        want[i] += sum(w * np.exp(-0.5 * ((at - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for w, m, s in comps)
    got = np.zeros((20, 20))
    for r in grid:
        got[r["ix"], r["iy"]] = r["density"]
    assert np.allclose(got, want, rtol=1e-9)
