"""Column profile of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.missing import finite, nullify_sentinel, numeric_columns
from skyfold.operators.ranks import quantile_of, running_sums
from skyfold.operators.sampling import fixed_size_sample

QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(c, value): the values that are present, one row each, with their column's number."""
    cells = [F.struct(F.lit(i).alias("c"), F.col(f"`{n}`").cast(kind).alias("value")) for i, n in enumerate(columns)]
    return df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where("value is not null")


def _named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("column", F.get(F.array(*[F.lit(n) for n in columns]), F.col("c"))).drop("c")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: type, count, missing, distinct and, for numbers, extremes, moments and quantiles.

    Counts and moments come from one aggregate. Distinct counts and quantiles are sketches in that aggregate, or with
    ``exact`` are read from the counts of (column, value): one pass for all numbers, one for all other columns.
    """
    clean = nullify_sentinel(df)
    names = list(columns or clean.columns)
    numbers = set(numeric_columns(clean, names))
    aggs = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        num = c.cast("double") if n in numbers else F.lit(None).cast("double")
        parts = {"n": F.count(c), "n_missing": F.count("*") - F.count(c), "n_distinct": F.lit(None).cast("long") if exact else F.approx_count_distinct(c),
                 "min": F.min(num), "max": F.max(num), "mean": F.avg(num), "std": F.stddev_pop(num)}
        if not exact:
            parts["quantiles"] = F.percentile_approx(num, list(QUANTILES.values()), 10000)
        aggs.append(F.struct(F.lit(n).alias("column"), F.lit(clean.schema[n].dataType.simpleString()).alias("type"),
                             *[c.alias(k) for k, c in parts.items()]).alias(f"c{i}"))
    flat = clean.agg(*aggs).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("r")).select("r.*")
    if not exact:
        return flat.select("*", *[F.get("quantiles", F.lit(i)).alias(q) for i, q in enumerate(QUANTILES)]).drop("quantiles")
    found = []
    numeric, other = [n for n in names if n in numbers], [n for n in names if n not in numbers]
    if numeric:
        ranks = running_sums(_long(clean, numeric, "double"), "value", by=["c"])
        found.append(_named(ranks.groupBy("c").agg(F.count("*").alias("n_distinct"), *[quantile_of(p, "n").alias(q) for q, p in QUANTILES.items()]), numeric))
    if other:
        counts = _long(clean, other, "string").distinct().groupBy("c").agg(F.count("*").alias("n_distinct"))
        found.append(_named(counts, other))
    exactly = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    out = flat.drop("n_distinct").join(F.broadcast(exactly), "column", "left")  # one row per column
    quantiles = [F.col(q) if q in out.columns else F.lit(None).cast("double").alias(q) for q in QUANTILES]
    return out.select("column", "type", "n", "n_missing", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min", "max", "mean", "std", *quantiles)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The most frequent values of one column."""
    return (df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "value").limit(k))


def top_of_columns(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, value, n): the most frequent values of several columns, counted in one pass."""
    counts = _long(df, columns, "string").groupBy("c", "value").agg(F.count("*").alias("n"))
    best = Window.partitionBy("c").orderBy(F.desc("n"), "value")
    top = counts.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k)
    return _named(top.drop("_nth"), columns).select("column", "value", "n")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """(column, bin, bin_lo, bin_hi, n) of several numeric columns: one pass for the ranges, one for the counts.

    The last bin is closed on both sides; a column whose values are all equal has them in its first bin.
    """
    numbers = [F.col(f"`{n}`").cast("double") for n in columns]
    usable = [F.when(finite(c), c) for c in numbers]
    row = df.agg(*[f(c).alias(f"{tag}{i}") for i, c in enumerate(usable) for tag, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(columns))]
    known = [i for i, (lo, _) in enumerate(spans) if lo is not None]
    if not known:
        return df.sparkSession.createDataFrame([], "column string, bin int, bin_lo double, bin_hi double, n long")
    lo = F.get(F.array(*[F.lit(spans[i][0]) for i in known]), F.col("c"))
    width = F.get(F.array(*[F.lit((spans[i][1] - spans[i][0]) / bins) for i in known]), F.col("c"))
    cells = [F.struct(F.lit(k).alias("c"), usable[i].alias("value")) for k, i in enumerate(known)]
    long = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where("value is not null")
    at = F.least(F.when(width > 0, F.floor((F.col("value") - lo) / width)).otherwise(0), F.lit(bins - 1)).cast("int")
    counts = long.groupBy("c", at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(known) * bins).select(F.expr(f"cast(id div {bins} as int)").alias("c"), F.expr(f"cast(id % {bins} as int)").alias("bin"))
    full = every.join(counts, ["c", "bin"], "left").withColumn("bin_lo", lo + F.col("bin") * width).withColumn("bin_hi", F.col("bin_lo") + width)
    return _named(full, [columns[i] for i in known]).select("column", "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, from one aggregate."""
    clean = nullify_sentinel(df, columns)
    pairs = list(combinations(columns, 2))
    wide = clean.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile_table(df: DataFrame, bins: int = 50, sample: int = 10, key: str | None = None, exact: bool = False) -> dict[str, DataFrame]:
    """All parts of a profile, each a small table: ``columns``, ``top``, ``histograms``, ``correlations``, ``sample``.

    With ``key`` the sample depends on the keys only; without, any rows are taken.
    """
    clean = nullify_sentinel(df)
    numbers = numeric_columns(clean)
    others = [c for c in clean.columns if c not in numbers]
    out = {"columns": profile_columns(df, exact=exact), "sample": fixed_size_sample(clean, sample, key) if key else clean.limit(sample)}
    if others:
        out["top"] = top_of_columns(clean, others)
    if numbers:
        out["histograms"] = histograms(clean, numbers, bins)
    if len(numbers) > 1:
        out["correlations"] = correlations(clean, numbers)
    return out
