"""Exact global ranks, running sums and quantiles without collecting a column into one task.

A column is cut into buckets of about equal size at approximate quantiles (a bounded sketch; its accuracy only
affects balance, never the result). Bucket totals give every bucket its offset, and what remains runs per bucket.
Equal values are counted, not repeated, so a value shared by a third of all rows is a single row here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.missing import finite

BUCKET = "_bucket"
ROWS_PER_BUCKET = 1_000_000


def default_buckets(df: DataFrame) -> int:
    """Four buckets per shuffle task, and more where a bucket would hold over a million rows (counted)."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_PER_BUCKET)


def cut_points(df: DataFrame, values: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate equal-depth cuts of several columns from one pass."""
    n = buckets or default_buckets(df)
    if n < 2:
        return {v: [] for v in values}
    found = df.approxQuantile(list(values), [i / n for i in range(1, n)], 1.0 / (4 * n))
    return {v: sorted(set(c)) for v, c in zip(values, found)}


def with_bucket(df: DataFrame, value: str, buckets: int | None = None,
                cuts: Sequence[float] | None = None) -> DataFrame:
    """Add the number of the bucket that holds ``value``; larger values never get a smaller number.

    ``cuts`` found earlier (or for a similar column) save the pass that finds them; any cuts give right results.
    """
    if cuts is None:
        cuts = cut_points(df, [value], buckets)[value]
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=BUCKET).transform(df)


def _over(by: Sequence[str], *order: Column | str) -> Window:
    w = Window.partitionBy(*by)
    return w.orderBy(*order) if order else w


def running_sums(df: DataFrame, value: str, measures: Mapping[str, Column] | None = None, by: Sequence[str] = (),
                 buckets: int | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    """One row per distinct ``value`` (within ``by``), in the value's order, with global running sums.

    For each measure ``m``: ``m`` (the sum over rows of this value), ``m_before`` (over smaller values) and
    ``m_total``. ``next_value`` is the following distinct value. Without measures, rows are counted as ``n``.
    """
    measures = dict(measures or {"n": F.lit(1)})
    keys = list(by)
    rows = df.select(*keys, F.col(value).cast("double").alias("value"),
                     *[m.alias(name) for name, m in measures.items()]).where(finite(F.col("value")))
    tagged = with_bucket(rows, "value", buckets, cuts)
    per_value = tagged.groupBy(*keys, BUCKET, "value").agg(*[F.sum(m).alias(m) for m in measures])
    # At most one row per bucket and group; measured from per_value so that both sides read one shuffle.
    per_bucket = per_value.groupBy(*keys, BUCKET).agg(F.min("value").alias("_first"),
                                                      *[F.sum(m).alias(f"_{m}") for m in measures])
    ordered, whole = _over(keys, BUCKET), _over(keys)
    offsets = per_bucket.select(
        *keys, BUCKET, F.lead("_first").over(ordered).alias("_next"),
        *[(F.sum(f"_{m}").over(ordered) - F.col(f"_{m}")).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in measures])
    inside = _over([*keys, BUCKET], "value")
    joined = per_value.join(F.broadcast(offsets) if not keys else offsets, [*keys, BUCKET])
    return joined.select(
        *keys, "value", *measures,
        *[(F.col(f"_{m}_off") + F.sum(m).over(inside) - F.col(m)).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
        F.coalesce(F.lead("value").over(inside), F.col("_next")).alias("next_value"))


def quantile_of(p: float, name: str, among: Column | None = None) -> Column:
    """Aggregate over a running-sum table: the interpolated quantile of the rows counted by measure ``name``."""
    position = F.lit(float(p)) * (F.col(f"{name}_total") - 1)
    share = position - F.floor(position)
    picks = []
    for k, weight in ((F.floor(position), F.lit(1.0) - share), (F.ceil(position), share)):
        here = (F.col(f"{name}_before") <= k) & (k < F.col(f"{name}_before") + F.col(name))
        picks.append(F.sum(F.when(here if among is None else here & among, weight * F.col("value"))))
    return picks[0] + picks[1]


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (),
                  cuts: Sequence[float] | None = None) -> DataFrame:
    """One row per distinct value with the mean of the ranks its rows share."""
    return running_sums(df, value, by=by, cuts=cuts).select(
        *by, "value", "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"))


def empirical_cdf(df: DataFrame, value: str, by: Sequence[str] = (), points: int | None = None) -> DataFrame:
    """Distinct values with ``(rank - 1) / (n - 1)`` of their first row, thinned to about ``points`` rows."""
    table = running_sums(df, value, by=by)
    cdf = F.try_divide(F.col("n_before").cast("double"), (F.col("n_total") - 1).cast("double"))
    out = table.withColumn("cdf", F.coalesce(cdf, F.lit(0.0)))
    if points:
        step = F.greatest(F.floor(F.col("n_total") / F.lit(points)), F.lit(1))
        crosses = F.floor(F.col("n_before") / step) != F.floor((F.col("n_before") - 1) / step)
        spans = F.floor((F.col("n_before") + F.col("n") - 1) / step) > F.floor(F.col("n_before") / step)
        last = F.col("next_value").isNull()
        out = out.where(crosses | spans | last)
    return out.select(*by, "value", "n", "cdf")


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
                    buckets: int | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    """Linearly interpolated quantiles, one column per name in ``probs``; one row per group (or one row).

    Rows are never shuffled whole: the bucket histogram locates each wanted rank, and only rows of those buckets
    are ordered. ``by`` is meant for few groups (bins, strata, models); with very many, the bucket rows are joined
    by a shuffle instead of a broadcast.
    """
    keys = list(by)
    rows = df.select(*keys, F.col(value).cast("double").alias("value")).where(finite(F.col("value")))
    tagged = with_bucket(rows, "value", buckets, cuts)
    hist = tagged.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n"))
    cum = hist.select(*keys, BUCKET, "_n", (F.sum("_n").over(_over(keys, BUCKET)) - F.col("_n")).alias("_before"),
                      F.sum("_n").over(_over(keys)).alias("_total"))
    wanted = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        frac = pos - F.floor(pos)
        for k, weight in ((F.floor(pos), F.lit(1.0) - frac), (F.ceil(pos), frac)):
            wanted.append(F.struct(F.lit(name).alias("name"), k.cast("long").alias("k"), weight.alias("weight")))
    targets = (cum.withColumn("_t", F.explode(F.array(*wanted)))
               .where((F.col("_t.k") >= F.col("_before")) & (F.col("_t.k") < F.col("_before") + F.col("_n")))
               .select(*keys, BUCKET, "_before", "_t.*")
               .groupBy(*keys, BUCKET, "_before", "name", "k").agg(F.sum("weight").alias("weight")))
    if keys:  # two rows per probability and group: how to join them is left to adaptive execution
        small = lambda df: df
    else:
        small = F.broadcast
    spots = targets.groupBy(*keys, BUCKET).agg(F.min("_before").alias("_before"))
    near = tagged.join(small(spots), [*keys, BUCKET])
    inside = _over([*keys, BUCKET], "value")
    ranked = (near.groupBy(*keys, BUCKET, "_before", "value").agg(F.count("*").alias("_n"))
              .withColumn("_end", F.col("_before") + F.sum("_n").over(inside)))
    hits = (ranked.join(small(targets.drop("_before")), [*keys, BUCKET])
            .where((F.col("k") < F.col("_end")) & (F.col("k") >= F.col("_end") - F.col("_n"))))
    picks = [F.sum(F.when(F.col("name") == name, F.col("weight") * F.col("value"))).alias(name) for name in probs]
    return hits.groupBy(*keys).agg(*picks)


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """The quantiles as numbers on the driver; an empty list for a column without values."""
    names = [f"q{i}" for i in range(len(probs))]
    row = exact_quantiles(df, value, dict(zip(names, probs))).first()
    return [row[n] for n in names] if row and row[names[0]] is not None else []


def quantile_edges(df: DataFrame, value: str, q: int) -> list[float]:
    """Edges of ``q`` equal-count bins; repeated edges are dropped."""
    edges = quantile_values(df, value, [i / q for i in range(q + 1)])
    return sorted(set(edges))
