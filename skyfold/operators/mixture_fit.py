"""Gaussian mixtures fitted to the values in each row's array.

Every row is its own small problem, so the job is narrow: no shuffle, no group. The flat values of one Arrow batch are
fitted at a time with array arithmetic over rows x components x values, and flat arrays go back; no row is touched on its
own. A fold of array expressions in the JVM was measured against this; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.constants import SQRT_2PI
from skyfold.functions.mixture import flatten_components

VARIANCE_FLOOR = 1e-6
# Elements of the rows x components x values block held at once.
BLOCK = 2_000_000
FIT_TYPE = "struct<components:array<struct<w:double,mu:double,sigma:double>>,k:int,loglik:double>"


def _stack(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix with a mask; shorter rows are padded."""
    lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x = np.zeros((len(batch), int(lengths.max(initial=1))))
    mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
    values = batch.flatten()
    x[mask] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    mask[mask] = values.is_valid().to_numpy(zero_copy_only=False)
    return x, mask


def _log_parts(x, w, mu, var):
    """Log of weight times density, rows x components x values."""
    with np.errstate(divide="ignore"):
        return (np.log(w) - 0.5 * np.log(var) - np.log(SQRT_2PI))[:, :, None] \
            - 0.5 * (x[:, None, :] - mu[:, :, None]) ** 2 / var[:, :, None]


def _expect(x, mask, w, mu, var):
    logs = _log_parts(x, w, mu, var)
    top = logs.max(axis=1)
    shares = np.exp(logs - top[:, None, :])
    total = shares.sum(axis=1)
    return shares / total[:, None, :] * mask[:, None, :], ((top + np.log(total)) * mask).sum(axis=1)


def em_rows(x: np.ndarray, mask: np.ndarray, k: int, max_iter: int, tol: float):
    """Expectation maximisation for all rows at once; a row stops when its mean log-likelihood gains below ``tol``.

    Starts at equal weights, the mid-quantiles of the row and its deviation divided by ``k``.
    """
    n = mask.sum(axis=1)
    ordered = np.sort(np.where(mask, x, np.inf), axis=1)
    pos = (np.arange(k) + 0.5)[None, :] / k * (n - 1)[:, None]
    lo, hi = np.floor(pos).astype(int), np.ceil(pos).astype(int)
    a, b = np.take_along_axis(ordered, lo, 1), np.take_along_axis(ordered, hi, 1)
    mu = a + (pos - lo) * (b - a)
    mean = (x * mask).sum(axis=1) / n
    spread = (((x - mean[:, None]) ** 2) * mask).sum(axis=1) / n
    var = np.repeat(np.maximum(spread / k ** 2, VARIANCE_FLOOR)[:, None], k, axis=1)
    w = np.full((len(x), k), 1.0 / k)
    last = np.full(len(x), -np.inf)
    live = np.arange(len(x))
    for _ in range(max_iter):
        r, loglik = _expect(x[live], mask[live], w[live], mu[live], var[live])
        moving = np.abs(loglik / n[live] - last[live]) >= tol if tol > 0 else np.ones(len(live), bool)
        last[live] = loglik / n[live]
        live, r = live[moving], r[moving]
        if not len(live):
            break
        mass = r.sum(axis=2) + 1e-300
        mu[live] = (r * x[live][:, None, :]).sum(axis=2) / mass
        gap = (x[live][:, None, :] - mu[live][:, :, None]) ** 2
        var[live] = np.maximum((r * gap).sum(axis=2) / mass, VARIANCE_FLOOR)
        w[live] = mass / n[live][:, None]
    _, loglik = _expect(x, mask, w, mu, var)
    return w, mu, np.sqrt(var), loglik, n


def _best_fits(x: np.ndarray, mask: np.ndarray, ks: Sequence[int], max_iter: int, tol: float):
    """Weights, means and sigmas of the number of components with the least BIC, in order of means; absent slots are padded."""
    rows, width = len(x), max(ks)
    w, mu, sd = np.zeros((rows, width)), np.full((rows, width), np.inf), np.ones((rows, width))
    least, chosen, best = np.full(rows, np.inf), np.zeros(rows, np.int32), np.zeros(rows)
    for k in ks:
        *fitted, loglik, n = em_rows(x, mask, k, max_iter, tol)
        bic = (3 * k - 1) * np.log(n) - 2.0 * loglik
        better = bic < least  # a later number must be strictly better
        for slots, found, pad in zip((w, mu, sd), fitted, (0.0, np.inf, 1.0)):
            slots[better, :k], slots[better, k:] = found[better], pad
        least[better], chosen[better], best[better] = bic[better], k, loglik[better]
    order = np.argsort(mu, axis=1, kind="stable")
    w, mu, sd = (np.take_along_axis(a, order, 1) for a in (w, mu, sd))
    return w, mu, sd, chosen, best


def _fitter(ks: Sequence[int], max_iter: int, tol: float):
    @F.arrow_udf(FIT_TYPE)
    def fit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            step = max(1, BLOCK // (max(ks) * max(int(lengths.max(initial=1)), 1)))
            for start in range(0, len(batch), step):
                parts.append(_fit_block(batch.slice(start, step), ks, max_iter, tol))
            yield pa.concat_arrays(parts) if parts else _fit_block(batch, ks, max_iter, tol)
    return fit


def _fit_block(batch: pa.Array, ks: Sequence[int], max_iter: int, tol: float) -> pa.Array:
    """Fits of one block of arrays; null values inside do not count, and a row without any has no components."""
    x, mask = _stack(batch)
    full = np.flatnonzero(mask.any(axis=1))
    w, mu, sd, chosen, best = _best_fits(x[full], mask[full], ks, max_iter, tol)
    used = np.arange(max(ks))[None, :] < chosen[:, None]
    k, loglik = np.zeros(len(x), np.int32), np.zeros(len(x))
    k[full], loglik[full] = chosen, best
    parts = pa.StructArray.from_arrays([pa.array(a[used]) for a in (w, mu, sd)], names=["w", "mu", "sigma"])
    components = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), parts)
    return pa.StructArray.from_arrays([components, pa.array(k), pa.array(loglik)], names=["components", "k", "loglik"])


def fit_mixtures(df: DataFrame, values: str, k: int = 5, max_iter: int = 200, tol: float = 1e-3,
                 prefix: str = "gmm") -> DataFrame:
    """Add the flattened ``k``-component mixture of each row's array, components ordered by mean."""
    fitted = df.withColumn("_fit", _fitter([k], max_iter, tol)(F.col(values)))
    return flatten_components(fitted.withColumn("_c", F.col("_fit.components")), "_c", k, prefix).drop("_fit", "_c")


def fit_mixtures_bic(df: DataFrame, values: str, k_max: int = 8, max_iter: int = 200, tol: float = 1e-3,
                     prefix: str = "gmm") -> DataFrame:
    """As above with the number of components that minimises BIC; the first wins ties, unused slots are padded."""
    fitted = df.withColumn("_fit", _fitter(list(range(1, k_max + 1)), max_iter, tol)(F.col(values)))
    fitted = fitted.withColumns({"_c": F.col("_fit.components"), f"{prefix}_n_components": F.col("_fit.k")})
    return flatten_components(fitted, "_c", k_max, prefix).drop("_fit", "_c")


def component_count_statistics(df: DataFrame, column: str = "gmm_n_components") -> DataFrame:
    """Mean, median, least and largest number of selected components, from the counts of each number."""
    from skyfold.operators.metrics import with_median
    c = F.col(column)
    return with_median(df.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")), df, column)
