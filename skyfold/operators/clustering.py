"""Soft cluster membership as features.

Fits run on Spark: k-means and full-covariance mixtures with Spark ML, every other shape by expectation
maximisation whose statistics are one aggregate per iteration. What the driver holds is K means and covariances.
A fitted clustering is a handful of numbers, and membership is plain column arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.operators.encoding import Standardiser, fit_standardiser
from skyfold.operators.forests import assembler

EPSILON = 1e-8


@dataclass
class Clustering:
    """Scaler and parameters. ``offsets`` and ``factors`` give each cluster's log score up to a shared constant."""

    method: str
    features: list[str]
    scaler: dict
    means: list[list[float]]
    offsets: list[float] = field(default_factory=list)
    factors: list[list[list[float]]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    log_likelihood: float | None = None  # mean over the training rows, up to a constant

    def probability_names(self) -> list[str]:
        return [f"cluster_prob_{i}" for i in range(len(self.means))]

    def effective_clusters(self, least: float = 0.01) -> int:
        return sum(w > least for w in self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add one membership column per cluster; they sum to 1."""
        scaled = Standardiser.from_dict(self.scaler).transform(df, "__s")
        x = [F.col(f"{f}__s") for f in self.features]
        names = self.probability_names()
        if self.method == "kmeans":
            raw = {f"_k{i}": F.lit(1.0) / (_distance(x, m) + F.lit(EPSILON)) for i, m in enumerate(self.means)}
            shares = scaled.withColumns(raw)
        else:
            logs = {f"_l{i}": F.lit(o) - F.lit(0.5) * _mahalanobis(x, m, f)
                    for i, (o, m, f) in enumerate(zip(self.offsets, self.means, self.factors))}
            shares = scaled.withColumns(logs)
            top = F.greatest(*[F.col(n) for n in logs]) if len(logs) > 1 else F.col("_l0")
            shares = shares.withColumn("_top", top)
            shares = shares.withColumns({f"_k{i}": F.exp(F.col(f"_l{i}") - F.col("_top")) for i in range(len(logs))})
        parts = [F.col(f"_k{i}") for i in range(len(names))]
        out = shares.withColumn("_sum", reduce(add, parts))
        return out.withColumns({n: p / F.col("_sum") for n, p in zip(names, parts)}).select(*df.columns, *names)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: Mapping) -> Clustering:
        return cls(**values)


def _distance(x: Sequence[Column], center: Sequence[float]) -> Column:
    return F.sqrt(reduce(add, ((c - F.lit(float(m))) * (c - F.lit(float(m))) for c, m in zip(x, center))))


def _mahalanobis(x: Sequence[Column], mean: Sequence[float], factor: Sequence[Sequence[float]]) -> Column:
    """Squared length of ``factor`` (a triangular root of the precision, one row per output) times the offset."""
    gaps = [c - F.lit(float(m)) for c, m in zip(x, mean)]
    rows = []
    for row in factor:
        terms = [F.lit(float(v)) * g for v, g in zip(row, gaps) if v != 0.0]
        rows.append(reduce(add, terms))
    return reduce(add, (r * r for r in rows))


def fit_clustering(train: DataFrame, features: Sequence[str], method: str = "gmm", n_clusters: int = 5, *,
                   covariance_type: str = "full", max_iter: int = 200, tol: float = 1e-3, reg_covar: float = 1e-6,
                   n_init: int = 1, seed: int = 42) -> Clustering:
    """Fit on standardised training rows. ``method`` is ``kmeans``, ``gmm`` or ``bayesian_gmm``."""
    features = list(features)
    scaler = fit_standardiser(train, features)
    points = train.select(*scaler.columns()).persist()
    try:
        if method == "kmeans":
            centers = _kmeans(points, features, n_clusters, max_iter, n_init, seed)[0]
            return Clustering("kmeans", features, scaler.to_dict(), centers.tolist())
        if method == "gmm" and covariance_type == "full":
            parts = _spark_mixture(points, features, n_clusters, max_iter, tol, n_init, seed)
            return _from_gaussians(method, features, scaler, *parts, reg_covar)
        if method in ("gmm", "bayesian_gmm"):
            return _em(points, features, scaler, method, n_clusters, covariance_type, max_iter, tol, reg_covar, n_init, seed)
        raise ValueError(f"unknown clustering method {method!r}")
    finally:
        points.unpersist()


def _vectors(points: DataFrame, features: Sequence[str]) -> DataFrame:
    return assembler(features).transform(points).select("features", *features)


def _kmeans(points, features, k, max_iter, n_init, seed):
    """Centres of the best of ``n_init`` starts, and the model."""
    data = _vectors(points, features)
    models = [KMeans(k=k, maxIter=max_iter, seed=seed + i).fit(data) for i in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return np.array(best.clusterCenters()), best


def _spark_mixture(points, features, k, max_iter, tol, n_init, seed):
    data = _vectors(points, features)
    models = [GaussianMixture(k=k, maxIter=max_iter, tol=tol, seed=seed + i).fit(data) for i in range(n_init)]
    best = max(models, key=lambda m: m.summary.logLikelihood)
    rows = best.gaussiansDF.collect()  # k rows
    return np.array(best.weights), np.array([r["mean"].toArray() for r in rows]), np.array([r["cov"].toArray() for r in rows])


def _factor(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(cov))


def _from_gaussians(method, features, scaler, weights, means, covs, reg):
    covs = covs + reg * np.eye(len(features))
    factors = [_factor(c) for c in covs]
    with np.errstate(divide="ignore"):
        offsets = [float(np.log(max(w, 1e-300)) + np.log(np.diag(f)).sum()) for w, f in zip(weights, factors)]
    return Clustering(method, list(features), scaler.to_dict(), means.tolist(), offsets, [f.tolist() for f in factors],
                      [float(w) for w in weights])


def _digamma(x: float) -> float:
    """Recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10.0:
        out -= 1.0 / x
        x += 1.0
    y = 1.0 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


@dataclass
class _Start:
    """One start of a fit: its parameters so far, or centres of a hard assignment before the first round."""

    means: np.ndarray
    offsets: np.ndarray | None = None
    factors: np.ndarray | None = None

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares of the clusters in each row, and the summed log likelihood (up to a shared constant)."""
        gaps = x[:, None, :] - self.means[None, :, :]
        if self.factors is None:
            return np.eye(len(self.means))[(gaps * gaps).sum(2).argmin(1)], 0.0
        z = np.einsum("nkd,ked->nke", gaps, self.factors)
        logs = self.offsets[None, :] - 0.5 * (z * z).sum(2)
        top = logs.max(1, keepdims=True)
        raw = np.exp(logs - top)
        total = raw.sum(1, keepdims=True)
        return raw / total, float((top + np.log(total)).sum())


def _statistics(points: DataFrame, starts: Mapping[int, _Start]) -> dict[int, tuple]:
    """Log likelihood, mass, weighted sums and second moments of all clusters of all starts, from one pass.

    A task adds its rows up; what is shuffled and collected depends on starts, clusters and features only.
    """
    k, d = next(iter(starts.values())).means.shape
    size = 1 + k + k * d + k * d * d

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(starts), size))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)])
            for row, start in zip(total, starts.values()):
                r, loglik = start.shares(x)
                second = np.stack([(r[:, i, None] * x).T @ x for i in range(k)])
                row += np.concatenate([[loglik], r.sum(0), (r.T @ x).ravel(), second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(len(starts) * size)
    for r in points.mapInArrow(add_up, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    parts = {}
    for number, row in zip(starts, out.reshape(len(starts), size)):
        mass, first, second = np.split(row[1:], [k, k + k * d])
        parts[number] = row[0], mass, first.reshape(k, d), second.reshape(k, d, d)
    return parts


def _shape(covs, mass, kind):
    d = covs.shape[1]
    if kind == "full":
        return covs
    if kind == "tied":
        return np.repeat(((mass[:, None, None] * covs).sum(axis=0) / mass.sum())[None], len(covs), axis=0)
    diag = np.einsum("kii->ki", covs)
    if kind == "spherical":
        diag = np.repeat(diag.mean(axis=1, keepdims=True), d, axis=1)
    elif kind != "diag":
        raise ValueError(f"unknown covariance type {kind!r}")
    return np.einsum("ki,ij->kij", diag, np.eye(d))


def _em(points, features, scaler, method, k, kind, max_iter, tol, reg, n_init, seed):
    """Expectation maximisation, or its variational form with a Dirichlet-process prior on the weights.

    All ``n_init`` starts move on together, one pass over the rows a round; a start rests when its mean log likelihood
    gains less than ``tol``, and the start with the best one is the fit.
    """
    n, unit = points.count(), Standardiser({f: 0.0 for f in features}, {f: 1.0 for f in features})
    starts = {i: _Start(_kmeans(points, features, k, 20, 1, seed + i)[0]) for i in range(n_init)}
    fits, reached, prior = {}, dict.fromkeys(starts, -np.inf), None
    for turn in range(max_iter + 1):
        for i, (loglik, mass, first, second) in _statistics(points, starts).items():
            if turn and (loglik / n - reached[i] < tol or turn == max_iter):
                reached[i] = loglik / n
                del starts[i]
                continue
            reached[i] = loglik / n if turn else -np.inf
            mass = mass + 1e-10
            means = first / mass[:, None]
            covs = second / mass[:, None, None] - np.einsum("ki,kj->kij", means, means)
            if prior is None:  # of all rows, whatever the start
                center = first.sum(0) / n
                prior = second.sum(0) / n - np.outer(center, center) + reg * np.eye(len(features))
            shaped = _shape(covs, mass, kind)
            fits[i] = (_from_gaussians(method, features, unit, mass / mass.sum(), means, shaped, reg) if method == "gmm"
                       else _variational(features, unit, mass, means, shaped, kind, prior, reg))
            starts[i] = _Start(np.array(fits[i].means), np.array(fits[i].offsets), np.array(fits[i].factors))
        if not starts:
            break
    best = fits[max(fits, key=reached.get)]
    best.scaler, best.log_likelihood = scaler.to_dict(), float(max(reached.values()))
    return best


def _variational(features, scaler, mass, means, covs, kind, prior, reg):
    """One update of the Dirichlet-process mixture (Blei and Jordan 2006). Priors on standardised data: mean 0,
    the data's own covariance in the wanted shape, mean precision 1, degrees of freedom ``d``, concentration ``1/K``.

    With tied covariance the clusters share the mean of their scatters and degrees of freedom.
    """
    k, d = means.shape
    a, b = 1.0 + mass, 1.0 / k + np.concatenate([np.cumsum(mass[::-1])[::-1][1:], [0.0]])
    stick = np.array([_digamma(p) - _digamma(p + q) for p, q in zip(a, b)])
    rest = np.array([_digamma(q) - _digamma(p + q) for p, q in zip(a, b)])
    log_pi = stick + np.concatenate([[0.0], np.cumsum(rest)[:-1]])
    beta, dof = 1.0 + mass, d + mass
    centers = mass[:, None] * means / beta[:, None]
    base = _shape(prior[None], np.ones(1), kind)[0]
    away = _shape(np.einsum("ki,kj->kij", means, means), np.ones(k), "full" if kind == "tied" else kind)
    scatter = mass[:, None, None] * (covs + reg * np.eye(d)) + (mass / beta)[:, None, None] * away
    if kind == "tied":
        scatter, dof = np.repeat(scatter.mean(axis=0)[None], k, axis=0), np.full(k, d + mass.sum() / k)
    scatter = base + scatter
    offsets, factors = [], []
    for i in range(k):
        root = _factor(scatter[i] / dof[i])
        log_det = sum(_digamma(0.5 * (dof[i] - j)) for j in range(d)) + d * math.log(2.0 / dof[i])
        offsets.append(float(log_pi[i] + np.log(np.diag(root)).sum() + 0.5 * (log_det - d / beta[i])))
        factors.append(root.tolist())
    frac = a / (a + b)
    weights = frac * np.concatenate([[1.0], np.cumprod(1.0 - frac)[:-1]])
    weights = weights / weights.sum()
    return Clustering("bayesian_gmm", list(features), scaler.to_dict(), centers.tolist(), offsets, factors,
                      [float(w) for w in weights])
