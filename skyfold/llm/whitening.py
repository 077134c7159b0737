"""Embedding whitening by polarisation: every covariance from variances of sums.

Entries become integers, x = floor(1024 * c) + 100000. One pass adds up each dimension; a second adds the squares of the
centred values of each dimension and of each sum of two dimensions, all in whole numbers. As
2 cov(a, b) = var(a + b) - var(a) - var(b), these give the covariance matrix without rounding; it is rounded once, when
the driver hands it to ``eigh``. Only sums come to the driver: d and d * (d + 1) / 2 numbers for d dimensions, whatever
the number of rows. A third pass writes the whitened rows.

Values are centred at the whole number next below the mean, which keeps them small: sums of squares about the mean
follow from those exactly (n * q - s * s). Sums that could leave 64 bits are made with Python's integers instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How an entry becomes a whole number.
SCALE, SHIFT = 1024, 100_000
ROWS = 2048
LIMBS, LIMB_BITS = 6, 40
LONG_MAX = 2**63 - 1


def whole(batch: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, x) of the vectors that take part: all entries finite, x within 61 bits, and of the wanted length."""
    sizes = np.where(batch.is_valid().to_numpy(zero_copy_only=False), batch.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), -1)
    fits = np.flatnonzero(sizes == dimension)
    if not len(fits):
        return fits, np.empty((0, dimension), np.int64)
    flat = batch.take(pa.array(fits)).flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(fits), dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
        good = (np.abs(scaled) < 2.0**61).all(1)  # false for NaN and infinities
    return fits[good], scaled[good].astype(np.int64) + SHIFT


def exact(values: np.ndarray, factor: int) -> np.ndarray:
    """The values as 64-bit integers, or as Python's where ``factor`` squares of them could leave 64 bits."""
    most = int(np.abs(values).max(initial=0))
    return values if factor * most * most <= LONG_MAX else values.astype(object)


def _limbs(value: int) -> list[int]:
    """A sum as limbs of 40 bits, whose own sums stay within 64; the last one carries the sign."""
    low = [(value >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> (LIMB_BITS * (LIMBS - 1))]


def _sums(rows: DataFrame, width: int, add) -> list[int]:
    """``width`` whole numbers: ``add(batches)`` gives them for one task, Spark adds the tasks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = np.array([_limbs(int(v)) for v in add(batches)], np.int64).reshape(width, LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *[pa.array(limbs[:, k]) for k in range(LIMBS)]],
                                         names=["at", *[f"l{k}" for k in range(LIMBS)]])

    columns = ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = rows.mapInArrow(run, f"at long, {columns}").groupBy("at").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    out = [0] * width
    for r in parts.collect():
        out[r["at"]] = sum(r[f"l{k}"] << (LIMB_BITS * k) for k in range(LIMBS))
    return out


@dataclass
class Whitening:
    """What a fit learned: means (whole part and rest), components by falling eigenvalue, and their shares."""

    n: int
    dimension: int
    base: list[int]            # whole number next below each mean
    rest: list[int]            # n * mean - n * base
    values: np.ndarray         # eigenvalues that count, falling
    vectors: np.ndarray        # one column each
    explained: np.ndarray
    covariance: list[list[float]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.base, np.int64)).astype(float) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of unit variance; NaN where a component has none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2 of each row, exactly."""
        a = x - np.array(self.base, np.int64)
        most = self.n * (int(np.abs(a).max(initial=0)) + 1)
        if self.dimension * most * most > LONG_MAX:
            a = a.astype(object)
        d = a * self.n - np.array(self.rest, a.dtype)
        return (d * d).sum(1).tolist()


def dimension_of(vectors: DataFrame) -> int | None:
    """The most frequent length of the vectors, of equally frequent ones the greatest; None without any."""
    sizes = vectors.select(F.size("v").alias("d")).filter("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return sizes["d"] if sizes else None


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """Components of a table with one array column ``v``; None if no row takes part."""
    d = dimension_of(vectors)
    if d is None:
        return None

    def totals(batches):
        out = [0] * (d + 1)
        for batch in batches:
            _, x = whole(batch.column(0), d)
            x = x.astype(object) if int(np.abs(x).max(initial=0)) * max(len(x), 1) > LONG_MAX else x
            out[0] += len(x)
            for k, s in enumerate(x.sum(0) if len(x) else ()):
                out[k + 1] += int(s)
        return out

    n, *sums = _sums(vectors, d + 1, totals)
    if not n:
        return None
    base = [s // n for s in sums]
    pairs = d * (d + 1) // 2

    def squares(batches):
        out, low = np.zeros(pairs, object), np.array(base, np.int64)
        for batch in batches:
            _, x = whole(batch.column(0), d)
            for start in range(0, len(x), ROWS):
                a = exact(x[start:start + ROWS] - low, 4 * ROWS)
                at = 0
                for i in range(d):  # the dimension itself, then its sums with later ones
                    z = np.concatenate([a[:, i:i + 1], a[:, i:i + 1] + a[:, i + 1:]], 1)
                    out[at:at + d - i] += (z * z).sum(0).astype(object)
                    at += d - i
        return out.tolist()

    found = iter(_sums(vectors, pairs, squares))
    square = {(i, j): next(found) for i in range(d) for j in range(i, d)}
    rest = [s - n * b for s, b in zip(sums, base)]
    # n * n * variance of each dimension and of each sum of two
    own = [n * square[i, i] - rest[i] ** 2 for i in range(d)]
    covariance = [[0.0] * d for _ in range(d)]
    for (i, j), q in square.items():
        both = n * q - (rest[i] + rest[j]) ** 2
        covariance[i][j] = covariance[j][i] = own[i] / n**2 if i == j else (both - own[i] - own[j]) / (2 * n**2)
    matrix = np.array(covariance)
    values, columns = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, columns = values[order], columns[:, order]
    columns = columns * np.where(columns[np.abs(columns).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    values = np.where(values > d * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    trace = float(sum(own) / n**2)
    explained = values / trace if trace else np.zeros(d)
    k = min(components, d)
    return Whitening(n, d, base, rest, values[:k], columns[:, :k], explained[:k], covariance)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    k = int((model.values > 0).sum())
    if not k:
        return 0.0

    def products(batches):
        out = np.zeros((k, k + 1))
        for batch in batches:
            w = model.whitened(whole(batch.column(0), model.dimension)[1])[:, :k]
            out[:, 0] += w.sum(0)
            out[:, 1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "total"])

    rows = vectors.mapInArrow(products, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(k * (k + 1))
    for r in rows:
        total[r["at"]] = r["total"]
    total = total.reshape(k, k + 1) / model.n
    covariance = total[:, 1:] - np.outer(total[:, 0], total[:, 0])  # the rows are centred already: this takes rounding away
    return float(np.abs(covariance - np.eye(k)).max())


SCHEMA = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row that takes part and component.

    Dropped are null vectors, vectors with a null, NaN or infinite entry or one whose whole number leaves 61 bits, empty
    vectors, and those that are not as long as most are (of equally frequent lengths the greatest wins). Vectors may be
    long; memory of a task grows with the square of their length, not with the rows. Rows with equal or null ids each
    count and each come out. Components are numbered from 1 by falling eigenvalue and turned so that the entry of
    greatest size is positive; equal eigenvalues have no order of their own, any basis of them serves. A component
    without variance (equal vectors, a single row, linearly dependent dimensions) has ``whitened`` null and ``explained``
    0. ``deviation`` is null where the exact number leaves 64 bits. Other columns, whatever their names, take no part.
    An empty table gives no rows.
    """
    spark, kind = df.sparkSession, df.schema[vec_id].dataType.simpleString()
    source = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    vectors = source.select("v")
    model = fit(vectors, components)
    if model is None:
        return spark.createDataFrame([], SCHEMA.format(kind))
    error, k = identity_error(vectors, model), len(model.values)

    def write(batches):
        for batch in batches:
            at, x = whole(batch.column(1), model.dimension)
            for start in range(0, len(x), ROWS):
                part = x[start:start + ROWS]
                m, w = len(part), model.whitened(part)
                deviation = [v if v <= LONG_MAX else None for v in model.deviations(part)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at[start:start + ROWS], k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(write, SCHEMA.format(kind))
