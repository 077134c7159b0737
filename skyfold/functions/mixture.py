"""Gaussian mixtures as column expressions.

A mixture is three lists of columns (weights, means, sigmas), the flattened form the prediction tables store.
The sums are unrolled, so every score is plain arithmetic inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.constants import HART_DEN, HART_NUM, SQRT_2PI


def normal_pdf(z: Column) -> Column:
    return F.exp(F.lit(-0.5) * z * z) / F.lit(SQRT_2PI)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-13. For a plain column; see `with_normals`."""
    a = F.abs(z)
    tail = F.exp(F.lit(-0.5) * a * a) * _horner(a, HART_NUM) / _horner(a, HART_DEN)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def gmm_columns(df: DataFrame, prefix: str = "gmm") -> tuple[list[Column], list[Column], list[Column]]:
    """The flattened mixture columns of a prediction table."""
    k = sum(1 for c in df.columns if c.startswith(f"{prefix}_weight_"))
    return tuple([F.col(f"{prefix}_{part}_{i}") for i in range(k)] for part in ("weight", "mean", "sigma"))


def with_normals(df: DataFrame, z: Mapping[str, Column]) -> DataFrame:
    """Add ``{name}_pdf`` and ``{name}_cdf`` of every standardised value.

    The values, their magnitudes and the tails are columns of their own, one projection each. Written as one
    expression each would be repeated for every power in the polynomials, and the generated method would grow
    beyond what the JVM compiles.
    """
    df = df.withColumns({f"{n}_z": c for n, c in z.items()})
    df = df.withColumns({k: c for n in z for k, c in (
        (f"{n}_a", F.abs(F.col(f"{n}_z"))), (f"{n}_e", F.exp(F.lit(-0.5) * F.col(f"{n}_z") * F.col(f"{n}_z"))))})
    df = df.withColumns({f"{n}_t": F.col(f"{n}_e") * _horner(F.col(f"{n}_a"), HART_NUM) / _horner(F.col(f"{n}_a"), HART_DEN)
                         for n in z})
    made = {}
    for n in z:
        tail = F.col(f"{n}_t")
        made[f"{n}_cdf"] = F.when(F.col(f"{n}_z") > 0, F.lit(1.0) - tail).otherwise(tail)
        made[f"{n}_pdf"] = F.col(f"{n}_e") / F.lit(SQRT_2PI)
    return df.withColumns(made).drop(*[f"{n}_{part}" for n in z for part in "zaet"])


def with_mixture_scores(df: DataFrame, y: str, prefix: str = "gmm") -> DataFrame:
    """Add ``crps``, ``pit``, ``mixture_mean`` and ``mixture_var``.

    CRPS is the closed form of Grimit et al. (2006): the weighted kernel of every component against the truth,
    less half the weighted kernels of all component pairs. That double sum is symmetric, so each pair is built
    once, and a component with itself gives ``sigma / sqrt(pi)``. PIT is the distribution function at the truth.
    """
    keep = df.columns
    w, mu, sd = gmm_columns(df, prefix)
    k, pairs = range(len(w)), list(combinations(range(len(w)), 2))
    df = df.withColumns({f"_s{i}_{j}": F.sqrt(sd[i] * sd[i] + sd[j] * sd[j]) for i, j in pairs}) if pairs else df
    gaps = {f"_o{i}": (F.col(y) - mu[i], sd[i], w[i]) for i in k}
    gaps.update({f"_p{i}_{j}": (mu[i] - mu[j], F.col(f"_s{i}_{j}"), -w[i] * w[j]) for i, j in pairs})
    df = with_normals(df, {n: gap / s for n, (gap, s, _) in gaps.items()})

    def kernel(n):
        gap, s, weight = gaps[n]
        return weight * (F.lit(2.0) * s * F.col(f"{n}_pdf") + gap * (F.lit(2.0) * F.col(f"{n}_cdf") - F.lit(1.0)))

    own = reduce(add, (w[i] * w[i] * sd[i] for i in k)) * F.lit(1.0 / math.sqrt(math.pi))
    mean = mixture_mean(w, mu)
    df = df.withColumns({"crps": reduce(add, (kernel(n) for n in gaps)) - own,
                         "pit": reduce(add, (w[i] * F.col(f"_o{i}_cdf") for i in k)), "mixture_mean": mean})
    return df.withColumn("mixture_var", mixture_variance(w, mu, sd, F.col("mixture_mean"))).select(
        *keep, "crps", "pit", "mixture_mean", "mixture_var")


def mixture_pdf(w: Sequence[Column], mu: Sequence[Column], sd: Sequence[Column], x: Column) -> Column:
    return reduce(add, (a * normal_pdf((x - m) / s) / s for a, m, s in zip(w, mu, sd)))


def mixture_mean(w: Sequence[Column], mu: Sequence[Column]) -> Column:
    return reduce(add, (a * m for a, m in zip(w, mu)))


def mixture_variance(w: Sequence[Column], mu: Sequence[Column], sd: Sequence[Column],
                     mean: Column | None = None) -> Column:
    """Within plus between variance; pass ``mean`` where the mixture mean is a column already."""
    mean = mixture_mean(w, mu) if mean is None else mean
    return reduce(add, (a * (s * s + (m - mean) * (m - mean)) for a, m, s in zip(w, mu, sd)))


# ---- array forms ----------------------------------------------------------------------------------------------

def sort_components(components: Column) -> Column:
    """``array<struct<w, mu, sigma>>`` ordered by mean."""
    return F.array_sort(components, lambda a, b: F.when(a["mu"] < b["mu"], -1).when(a["mu"] > b["mu"], 1).otherwise(0))


def flatten_components(df: DataFrame, components: str, k: int, prefix: str = "gmm") -> DataFrame:
    """Component array to flattened columns; absent slots are padded with weight 0, mean 0, sigma 1."""
    made = {}
    for i in range(k):
        slot = F.get(F.col(components), F.lit(i))
        for part, field, pad in (("weight", "w", 0.0), ("mean", "mu", 0.0), ("sigma", "sigma", 1.0)):
            made[f"{prefix}_{part}_{i}"] = F.coalesce(slot[field], F.lit(pad))
    return df.withColumns(made)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once: inside a fold, a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def array_std(a: Column) -> Column:
    """Population deviation over the elements: their mean, then the squares about it.

    Two folds over plain numbers; a fold over a struct (Welford) makes a row for every element. The mean is taken from the
    first element on, so equal elements have none.
    """
    fold = lambda f: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)), F.size(a))
    mean = _bound(F.get(a, F.lit(0)), lambda first: first + fold(lambda x: x - first))
    return _bound(mean, lambda m: F.sqrt(fold(lambda x: (x - m) * (x - m))))


def with_mixture_grid(df: DataFrame, trees: str, y: str, points: int = 500, prefix: str = "gmm") -> DataFrame:
    """One row per grid point: mixture density and its components over the span of trees and truth plus 3 sigma."""
    w, mu, sd = gmm_columns(df, prefix)
    spread = F.lit(3.0) * array_std(F.col(trees))
    framed = df.withColumns({"grid_lo": F.least(F.array_min(trees), F.col(y)) - spread,
                             "grid_hi": F.greatest(F.array_max(trees), F.col(y)) + spread})
    grid = framed.withColumn("grid_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("grid_lo") + (F.col("grid_hi") - F.col("grid_lo")) * F.col("grid_i") / F.lit(float(points - 1))
    grid = grid.withColumn("grid_x", x)
    parts = {f"pdf_{i}": mixture_pdf([a], [m], [s], F.col("grid_x")) for i, (a, m, s) in enumerate(zip(w, mu, sd))}
    return grid.withColumns(parts).withColumn("pdf", reduce(add, (F.col(p) for p in parts)))


# ---- network outputs ------------------------------------------------------------------------------------------

def decompose_outputs(raw: Column, k: int) -> tuple[Column, Column, Column]:
    """Means, sigmas and weights from a vector of ``3k`` raw network outputs."""
    mu = F.slice(raw, 1, k)
    sigma = F.transform(F.slice(raw, k + 1, k), F.exp)
    top = F.array_max(F.slice(raw, 2 * k + 1, k))
    e = F.transform(F.slice(raw, 2 * k + 1, k), lambda x: F.exp(x - top))
    total = array_sum(e)
    return mu, sigma, F.transform(e, lambda x: x / total)


def mixture_nll(w: Sequence[Column], mu: Sequence[Column], sd: Sequence[Column], y: Column,
                normaliser: str = "strict") -> Column:
    """Negative log-likelihood by a shifted log-sum-exp.

    ``strict`` normalises each density by ``1/sqrt(2*pi*sigma^2)``; ``unrooted`` leaves the root out, as older
    networks were trained.
    """
    scale = {"strict": 0.5, "unrooted": 1.0}[normaliser]
    terms = [F.log(a) - F.lit(scale) * F.log(F.lit(2.0 * math.pi) * s * s) - (y - m) * (y - m) / (F.lit(2.0) * s * s)
             for a, m, s in zip(w, mu, sd)]
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    return -(F.log(reduce(add, (F.exp(t - top) for t in terms))) + top)
