"""Row-local rules at their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.constants import TARGET_EDGES, TARGET_LABELS
from skyfold.functions import binning, columns, features, images, missing
from skyfold.operators import filters

NAN, INF = float("nan"), float("inf")


def one(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_sentinel_tolerance(spark):
    df = spark.createDataFrame([(1, -999.0), (2, -999.0000001), (3, -998.99), (4, None), (5, NAN), (6, INF)], "id long, x double")
    out = {r["id"]: r["x"] for r in missing.nullify_sentinel(df).collect()}
    assert out == {1: None, 2: None, 3: -998.99, 4: None, 5: None, 6: INF}
    back = missing.fill_sentinel(missing.nullify_sentinel(df), ["x"])
    assert [r["x"] for r in back.orderBy("id").collect()] == [-999.0, -999.0, -998.99, -999.0, -999.0, INF]


def test_only_numeric_columns_are_touched(spark):
    df = spark.createDataFrame([(-999, "-999.0")], "n int, s string")
    row = missing.nullify_sentinel(df).first()
    assert row["n"] is None and row["s"] == "-999.0"


def test_corrections_differ_only_in_the_blend(spark):
    poly = [500.0, 0.9, 1e-6]
    values = [10000.0, 10000.0001, 11000.0, 12000.0, 20000.0, -999.0, None, NAN]
    smooth = one(spark, values, columns.correct_poly_smooth(F.col("x"), poly))
    hard = one(spark, values, columns.correct_poly_hard(F.col("x"), poly))
    p = lambda x: 500.0 + 0.9 * x + 1e-6 * x * x
    assert smooth[0] == hard[0] == 10000.0
    assert smooth[1] == pytest.approx(10000.0001, abs=1e-3) and hard[1] == pytest.approx(p(10000.0001))
    assert smooth[2] == pytest.approx(11000.0 + (p(11000.0) - 11000.0) * 0.5)
    assert smooth[3:5] == pytest.approx([p(12000.0), p(20000.0)]) and hard[3:5] == pytest.approx(smooth[3:5])
    assert smooth[5] == hard[5] == -999.0 and smooth[6] is None and math.isnan(smooth[7])


def test_log_features_at_and_below_the_pole(spark):
    df = spark.createDataFrame([(0, -0.5), (1, -0.6), (2, None), (3, 0.5), (4, NAN)], "i int, c double")
    out = [r["log_c"] for r in features.log_features(df, ["c"]).orderBy("i").collect()]
    assert out == [-INF, 0.0, 0.0, 0.0, 0.0]


def test_regime_bounds(spark):
    df = spark.createDataFrame([(0, 0.3), (1, 0.8), (2, 0.2), (3, 0.9), (4, None)], "i int, c double")
    rows = features.regime_features(df, ["c"]).orderBy("i").select("hot_c", "cool_c", "mid_c").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0.3), (0, 0, 0.8), (0.2, 0, 0), (0, 0.9, 0), (None, None, None)]


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    full = features.polynomial_features(df, ["a", "b"], 3)
    assert full.columns == ["a", "b", "a^2", "a_b", "b^2", "a^3", "a^2_b", "a_b^2", "b^3"]
    assert tuple(full.first()) == (2, 3, 4, 6, 9, 8, 12, 18, 27)
    assert features.polynomial_features(df, ["a", "b"], 3, True).columns == ["a", "b", "a_b"]


def test_feature_switches(spark):
    df = spark.createDataFrame([(0.4, 0.6, 14.0)], "a double, b double, g double")
    off = dict.fromkeys(["include_polynomials", "include_interactions", "include_temp_dependent"], False)
    out = features.engineer_all_features(df, ["a", "b"], ["g"], **off)
    assert out.columns == ["a", "b", "g", "log_a", "log_b", "g_squared"]


def test_bin_closure(spark):
    edges = TARGET_EDGES["teff"]
    values = [0.0, 4000.0, 8000.0, 50000.0, 50000.1, -1.0]
    assert one(spark, values, binning.edge_bin(F.col("x"), edges, "left")) == [0, 1, 4, None, None, None]
    assert one(spark, values, binning.edge_bin(F.col("x"), edges, "right")) == [None, 0, 3, 4, None, None]
    labels = one(spark, [100.0, 4500.0, 9000.0], binning.bin_label(binning.edge_bin(F.col("x"), edges), TARGET_LABELS["teff"]))
    assert labels == ["<4000 K (Cool)", "4000-5000 K (Solar)", ">8000 K (Hot)"]


def test_last_histogram_bin_is_closed(spark):
    assert one(spark, [0.0, 9.99, 10.0, 10.1], binning.linear_bin(F.col("x"), 0.0, 10.0, 5)) == [0, 4, 4, None]
    assert one(spark, [0.0, 9.99, 10.0], binning.half_open_bin(F.col("x"), 0.0, 10.0, 5)) == [0, 4, None]


def test_predicate_suffixes(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 5.0, "a")], "id int, x_gt double, s string")
    ids = lambda rules: sorted(r["id"] for r in filters.apply_rules(df, rules).collect())
    assert ids({"x_gt_gt": 2.0}) == [3]          # only the trailing suffix is removed
    assert ids({"x_gt": 1.0}) == [1]             # a column's own name is never split
    assert ids({"x_gt_is_null": True}) == [2]
    assert ids({"x_gt_is_null": False, "s_eq": "a", "id_ne": 1}) == [3]
    assert ids({"x_gt": [0.0, 5.0]}) == [1, 3]
    assert ids({}) == [1, 2, 3]


def test_valid_target_and_uncertainty(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-999.0, 0.0, -1.0, NAN, INF, None, 5.0])], "i int, y double")
    assert [r["i"] for r in filters.valid_target(df, "y").collect()] == [6]
    assert [r["i"] for r in filters.positive_uncertainty(df, "y").collect()] == [6]


def test_bad_expression_is_skipped(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    out = columns.add_expressions(df, {"y": "x * 2", "bad": "missing + 1", "worse": "x +* 2", "z": "y + 1"})
    assert out.columns == ["x", "y", "z"] and tuple(out.first()) == (1.0, 2.0, 3.0)
    assert columns.add_expressions(df, {"y": "x"}, engineered=True).columns == ["x"]


def test_color_temperature_window(spark):
    df = spark.createDataFrame([(0.5, -0.5, -999.0), (-0.6, -999.0, -0.7)], "g_r_color double, r_i_color double, i_z_color double")
    a, b = columns.with_color_temperatures(df).collect()
    assert a["Te_gr"] == pytest.approx(1.09 / 1.97 * 1e4) and a["Te_ri"] == -999.0 and a["Te_avg"] == a["Te_gr"]
    assert b["Te_avg"] == -999.0


def test_unit_rules(spark):
    assert one(spark, [3.0, 5.0, 5800.0, 2.9], columns.log_temperature_to_kelvin(F.col("x"))) == pytest.approx([1e3, 1e5, 5800.0, 2.9])
    assert one(spark, [-9.99, 2.0, 3.7], columns.decode_log_temperature(F.col("x")))[0] is None


def test_sky_wrap(spark):
    df = spark.createDataFrame([(180.0, 0.0), (181.0, 90.0), (None, 1.0)], "ra double, dec double")
    out = columns.sky_coordinates(df, "ra", "dec").collect()
    assert len(out) == 2 and out[0]["lon_rad"] == pytest.approx(math.pi) and out[1]["lon_rad"] == pytest.approx(math.radians(-179))


def test_image_operators_match_numpy(spark):
    img = np.arange(5 * 16, dtype=float).reshape(5, 4, 4) ** 1.5
    df = spark.createDataFrame([(1, img.reshape(5, 16).tolist(), 0.5)], "id int, bands array<array<double>>, z double")
    cube = np.array(df.select(images.band_differences(F.col("bands"))).first()[0])
    want = [img[i] - img[j] for i in range(5) for j in range(i + 1, 5)]
    assert np.allclose(cube, np.concatenate([img, np.array(want)]).reshape(15, 16))
    cut = np.array(df.select(images.crop(F.col("bands"), 4, 1, 3)).first()[0])
    assert np.allclose(cut, img[:, 1:3, 1:3].reshape(5, 4))
    for r in images.augment_rotations(df, 4).collect():
        assert r["z"] == 0.5 and np.allclose(np.array(r["bands"]), np.rot90(img, r["turn"], axes=(1, 2)).reshape(5, 16))


def test_image_cleaning(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0]]), (2, [[0.0, NAN]]), (3, [[0.0, -1.0]])], "id int, bands array<array<double>>")
    assert [r["id"] for r in images.clean_images(df).collect()] == [3]
