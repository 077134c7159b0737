"""Agreement of two columns and of two distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions.missing import finite
from skyfold.operators.ranks import average_ranks, cut_points, exact_quantiles, quantile_of, running_sums
from skyfold.operators.scalars import attach_row
from skyfold.session import stored


def pair_moments(df: DataFrame, x: str, y: str) -> DataFrame:
    """Count, Pearson, concordance, bias, scatter, MAE and RMSE from one scan."""
    cx, cy = F.col(x), F.col(y)
    d = cx - cy
    gap = F.avg(cx) - F.avg(cy)
    ccc = F.try_divide(F.lit(2.0) * F.covar_pop(cx, cy), F.var_pop(cx) + F.var_pop(cy) + gap * gap)
    return df.agg(F.count("*").alias("n"), F.corr(cx, cy).alias("pearson"), ccc.alias("ccc"), F.avg(d).alias("bias"),
                  F.stddev_pop(d).alias("scatter"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def spearman(df: DataFrame, x: str, y: str, cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Pearson correlation of average ranks.

    Equal pairs are counted before anything is joined, and the rank tables hold one row per distinct value.
    """
    pairs = df.groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(
        F.count("*").alias("_n"))
    cuts = cuts or cut_points(df, [x, y])
    rx = average_ranks(df, x, cuts=cuts[x]).select(F.col("value").alias("_x"), F.col("avg_rank").alias("_rx"))
    ry = average_ranks(df, y, cuts=cuts[y]).select(F.col("value").alias("_y"), F.col("avg_rank").alias("_ry"))
    ranked = pairs.join(rx, "_x").join(ry, "_y")
    n, a, b = F.col("_n").cast("double"), F.col("_rx"), F.col("_ry")
    # Ranks have mean (N+1)/2; centring on it first keeps the sums small.
    centred = attach_row(ranked, pairs.agg(F.sum("_n").alias("_total")))
    mid = (F.col("_total") + F.lit(1.0)) / F.lit(2.0)
    da, db = a - mid, b - mid
    return centred.agg(F.try_divide(F.sum(n * da * db), F.sqrt(F.sum(n * da * da) * F.sum(n * db * db))).alias("spearman"))


def difference_quantiles(df: DataFrame, x: str, y: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """16, 50 and 84 percent quantiles of the difference, and its median absolute deviation."""
    diffs = df.select((F.col(x) - F.col(y)).alias("_d"))
    names = {"p16_diff": 0.16, "median_diff": 0.5, "p84_diff": 0.84}
    found = exact_quantiles(diffs, "_d", names, cuts=cuts).first()  # three numbers
    away = diffs.select(F.abs(F.col("_d") - F.lit(found["median_diff"])).alias("_a"))
    mad = exact_quantiles(away, "_a", {"mad_diff": 0.5})
    return mad.select(*[F.lit(found[n]).cast("double").alias(n) for n in names], "mad_diff")


def two_sample_cdf(a: DataFrame, a_value: str, b: DataFrame, b_value: str,
                   cuts: Sequence[float] | None = None) -> DataFrame:
    """Both empirical distribution functions at every distinct value of either sample."""
    both = a.select(F.col(a_value).cast("double").alias("v"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(F.col(b_value).cast("double").alias("v"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    table = running_sums(both, "v", {"a": F.col("in_a"), "b": F.col("in_b")}, cuts=cuts)
    f1 = F.try_divide((F.col("a_before") + F.col("a")).cast("double"), F.col("a_total"))
    f2 = F.try_divide((F.col("b_before") + F.col("b")).cast("double"), F.col("b_total"))
    return table.select("value", "next_value", f1.alias("f1"), f2.alias("f2"), "a_total", "b_total")


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov series."""
    t = F.lit(-2.0) * d * d * (n * m / (n + m))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(t * k * k))
    return F.when(d <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * series, F.lit(0.0)), F.lit(1.0)))


def distribution_distance(a: DataFrame, a_value: str, b: DataFrame, b_value: str,
                          cuts: Sequence[float] | None = None) -> DataFrame:
    """Kolmogorov-Smirnov statistic and p-value, and the Wasserstein-1 distance, from one cumulative table."""
    cdf = two_sample_cdf(a, a_value, b, b_value, cuts)
    gap = F.abs(F.col("f1") - F.col("f2"))
    out = cdf.agg(F.max(gap).alias("ks_stat"),
                  F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
                  F.max("a_total").cast("double").alias("_n"), F.max("b_total").cast("double").alias("_m"))
    return out.select("ks_stat", ks_p_value(F.col("ks_stat"), F.col("_n"), F.col("_m")).alias("ks_p"), "wasserstein")


def _distances(f1: Column, f2: Column, n: Column, m: Column) -> dict[str, Column]:
    """Aggregates over a table of distinct values in order: both distribution functions to both distances."""
    gap = F.abs(f1 - f2)
    ks = F.max(gap)
    return {"ks_stat": ks, "ks_p": ks_p_value(ks, F.max(n).cast("double"), F.max(m).cast("double")),
            "wasserstein": F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0))}


def _ranked(counted: DataFrame, cuts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Running sums of (value, a, b) for distinct values, stored: ranks, quantiles and distances are read from it."""
    return stored(running_sums(counted, "value", {"a": F.col("a"), "b": F.col("b")}, by, cuts=cuts), "ranks")


def _share(name: str) -> Column:
    return F.try_divide((F.col(f"{name}_before") + F.col(name)).cast("double"), F.col(f"{name}_total"))


def comparison_metrics(df: DataFrame, x: str, y: str, pair: str | None = None) -> DataFrame:
    """The full suite for one pair of columns, as one row.

    The source is read once. One rank table holds the distinct values of both columns and of their difference; the
    distances and the difference's quantiles are one aggregate of it, the ranks for Spearman's correlation join from it,
    and the absolute deviation is ranked from its values and counts.
    """
    rows = stored(df.where(finite(F.col(x)) & finite(F.col(y))).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "pairs")
    rows = rows.withColumn("_d", F.col("_x") - F.col("_y"))
    cuts = cut_points(rows, ["_x", "_y", "_d"])
    part = lambda axis, c, a, b: F.struct(F.lit(axis).alias("axis"), F.col(c).alias("value"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    long = rows.select(F.explode(F.array(part(0, "_x", 1, 0), part(0, "_y", 0, 1), part(1, "_d", 1, 0))).alias("p")).select("p.*")
    ranks = _ranked(long, sorted({c for found in cuts.values() for c in found}), ["axis"])
    joint, gaps = F.col("axis") == 0, F.col("axis") == 1
    f1, f2 = (F.when(joint, _share(name)) for name in "ab")
    names = {"p16_diff": 0.16, "median_diff": 0.5, "p84_diff": 0.84}
    found = ranks.agg(*[quantile_of(p, "a", gaps).alias(n) for n, p in names.items()],
                      *[c.alias(n) for n, c in _distances(f1, f2, F.when(joint, F.col("a_total")), F.when(joint, F.col("b_total"))).items()]).first()

    middle = found["median_diff"]
    away = ranks.where(gaps).select(F.abs(F.col("value") - F.lit(middle)).alias("value"), "a")
    folded = sorted({abs(c - middle) for c in cuts["_d"]}) if middle is not None else []
    mad = running_sums(away, "value", {"a": F.col("a")}, cuts=folded).agg(quantile_of(0.5, "a").alias("mad_diff"))

    average = lambda name: F.col(f"{name}_before") + (F.col(name) + 1) / F.lit(2.0)
    side = lambda name, at: ranks.where(joint & (F.col(name) > 0)).select(F.col("value").alias(at), average(name).alias(f"_r{at}"), F.col(f"{name}_total").alias(f"_n{at}"))
    both = rows.groupBy("_x", "_y").agg(F.count("*").cast("double").alias("_n")).join(side("a", "_x"), "_x").join(side("b", "_y"), "_y")
    mid = (F.col("_n_x") + F.lit(1.0)) / F.lit(2.0)  # ranks have this mean; centring on it keeps the sums small
    da, db = F.col("_r_x") - mid, F.col("_r_y") - mid
    n = F.col("_n")
    order = both.agg(F.try_divide(F.sum(n * da * db), F.sqrt(F.sum(n * da * da) * F.sum(n * db * db))).alias("spearman"))

    out = attach_row(attach_row(pair_moments(rows, "_x", "_y"), order), mad)
    number = lambda name: F.lit(found[name]).cast("double").alias(name)
    return out.select(F.lit(pair or f"{x} vs {y}").alias("pair"), "n", "pearson", "ccc", "bias", "scatter", "mae", "rmse", "spearman",
                      *[number(name) for name in names], "mad_diff", *[number(name) for name in ("ks_stat", "ks_p", "wasserstein")])


def distribution_report(a: DataFrame, a_value: str, b: DataFrame, b_value: str) -> DataFrame:
    """Size, mean and median of both samples, the difference of means and both distances; both are read once."""
    side = lambda df, c, is_a: df.select(F.col(c).cast("double").alias("value"), F.lit(int(is_a)).alias("a"), F.lit(int(not is_a)).alias("b"))
    rows = stored(side(a, a_value, True).unionByName(side(b, b_value, False)), "samples")
    ranks = _ranked(rows, cut_points(rows, ["value"])["value"])
    of = lambda name: F.when(F.col(name) == 1, F.col("value"))
    sums = rows.agg(*[f(of(name)).alias(f"{tag}_{name}") for name in "ab" for tag, f in (("n", F.count), ("mean", F.avg))])
    found = ranks.agg(*[quantile_of(0.5, name).alias(f"median_{name}") for name in "ab"],
                      *[c.alias(n) for n, c in _distances(_share("a"), _share("b"), F.col("a_total"), F.col("b_total")).items()])
    out = attach_row(sums, found).withColumn("mean_difference", F.col("mean_a") - F.col("mean_b"))
    return out.select("n_a", "mean_a", "median_a", "n_b", "mean_b", "median_b", "mean_difference", "ks_stat", "ks_p", "wasserstein")


def bland_altman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean difference and the limits of agreement at 1.96 deviations."""
    m = pair_moments(df, x, y)
    return m.select("n", "bias", (F.col("bias") - F.lit(1.96) * F.col("scatter")).alias("loa_low"),
                    (F.col("bias") + F.lit(1.96) * F.col("scatter")).alias("loa_high"))
