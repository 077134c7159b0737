"""Splits and samples that depend only on a row's id and a seed.

The order inside a stratum is that of ``md5(seed-id)``. The row at which a split cuts is found from counts of
key prefixes, so no stratum is ever sorted as a whole, however many of the rows it holds.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.constants import CORRECTION_THRESHOLD
from skyfold.functions.binning import quantile_bin
from skyfold.operators.ranks import quantile_edges
from skyfold.session import stored

log = logging.getLogger(__name__)

ROWS_PER_PREFIX = 10_000


def prefix_digits(rows: int) -> int:
    """Hex digits of the counted key prefix: about ``ROWS_PER_PREFIX`` rows share one, however many rows there are."""
    return max(4, math.ceil(math.log(max(rows, 1) / ROWS_PER_PREFIX, 16)))


def sample_key(key: str | Column, seed: int) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-"), c.cast("string")))


def key_cutoffs(df: DataFrame, strata: Sequence[str], wanted: Column) -> DataFrame:
    """Per stratum, the key that ends the first ``wanted`` rows in key order.

    ``df`` has the strata columns and ``_key``; ``wanted`` is an expression over the stratum's row count ``_n``.
    Strata that want no row are absent from the result. Rows with equal keys stay on one side of the cut.
    """
    keyed = df.withColumn("_prefix", F.substring("_key", 1, prefix_digits(df.count())))
    group, inside = Window.partitionBy(*strata), Window.partitionBy(*strata).orderBy("_prefix")
    hist = keyed.groupBy(*strata, "_prefix").agg(F.count("*").alias("_c"))
    cum = (hist.withColumns({"_n": F.sum("_c").over(group), "_end": F.sum("_c").over(inside)})
           .withColumn("_want", wanted.cast("long")))
    spots = (cum.where((F.col("_want") > F.col("_end") - F.col("_c")) & (F.col("_want") <= F.col("_end")))
             .select(*strata, "_prefix", (F.col("_want") - F.col("_end") + F.col("_c")).alias("_rest")))
    near = keyed.join(spots, [*strata, "_prefix"]).groupBy(*strata, "_prefix", "_rest", "_key").agg(
        F.count("*").alias("_c"))
    order = Window.partitionBy(*strata, "_prefix").orderBy("_key")
    upto = near.withColumn("_end", F.sum("_c").over(order))
    return (upto.where((F.col("_rest") > F.col("_end") - F.col("_c")) & (F.col("_rest") <= F.col("_end")))
            .select(*strata, F.col("_key").alias("_cut")))


def _first_by_key(df: DataFrame, key: str, seed: int, strata: Sequence[str], wanted: Column) -> DataFrame:
    """``df`` with ``_first``: whether the row is among the first ``wanted`` of its stratum."""
    keyed = df.withColumn("_key", sample_key(key, seed))
    names = list(strata)
    slim = keyed.select(*names, "_key") if names else keyed.select("_key").withColumn("_all", F.lit(0))
    cuts = key_cutoffs(slim, names or ["_all"], wanted)
    if not names:
        row = cuts.first()
        first = F.lit(False) if row is None else F.col("_key") <= F.lit(row["_cut"])
        return keyed.withColumn("_first", first).drop("_key")
    cuts = stored(cuts, "cuts")  # one row per stratum, of a size that Spark then knows: broadcast below its threshold
    return (keyed.join(cuts, names, "left")
            .withColumn("_first", F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))).drop("_key", "_cut"))


def split(df: DataFrame, key: str = "source_id", test_size: float = 0.2, seed: int = 42,
          strata: Sequence[str] = (), column: str = "split") -> DataFrame:
    """Add ``train``/``test``: ``round(test_size * n)`` test rows in every stratum (one stratum without ``strata``)."""
    wanted = F.round(F.lit(test_size) * F.col("_n"))
    out = _first_by_key(df, key, seed, strata, wanted)
    return out.withColumn(column, F.when(F.col("_first"), F.lit("test")).otherwise(F.lit("train"))).drop("_first")


def stratum_census(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Number of strata, size of the smallest and the least size a split of a fifth can serve."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_strata"), F.min("n").alias("smallest"))


def min_stratum_size(test_size: float) -> int:
    return max(2, math.ceil(1.0 / min(test_size, 1.0 - test_size)))


def target_bins(df: DataFrame, target: str, q: int, hot_threshold: float | None = CORRECTION_THRESHOLD) -> Column:
    """Stratum label of the target: quantile bin number, or ``hot`` above the threshold."""
    y = F.col(target)
    cool = df if hot_threshold is None else df.where(y <= hot_threshold)
    edges = quantile_edges(cool, target, q)
    label = quantile_bin(y, edges).cast("string") if len(edges) > 1 else F.lit("0")
    return label if hot_threshold is None else F.when(y > hot_threshold, F.lit("hot")).otherwise(label)


def with_strata(df: DataFrame, target: str, q: int, categories: Sequence[str] = (), test_size: float = 0.2,
                hot_threshold: float | None = CORRECTION_THRESHOLD, column: str = "stratum") -> DataFrame:
    """Bins of the target combined with category columns.

    Where the smallest combined stratum is too small for the split, bins alone are tried, then one stratum.
    """
    least = min_stratum_size(test_size)
    bins = target_bins(df, target, q, hot_threshold)
    options = []
    if categories:
        options.append(F.concat_ws("_", bins, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in categories]))
    options.append(bins)
    for label in options:
        smallest = stratum_census(df.select(label.alias(column)), [column]).first()["smallest"]
        if smallest is not None and smallest >= least:
            return df.withColumn(column, label)
        log.warning("smallest stratum %s is below %s; using coarser strata", smallest, least)
    return df.withColumn(column, F.lit("all"))


def stratified_split(df: DataFrame, target: str, q: int, key: str = "source_id", categories: Sequence[str] = (),
                     test_size: float = 0.2, seed: int = 42,
                     hot_threshold: float | None = CORRECTION_THRESHOLD) -> DataFrame:
    """Strata and split in one step; the result is a function of ids, targets and seed only."""
    labelled = with_strata(df, target, q, categories, test_size, hot_threshold)
    return split(labelled, key, test_size, seed, ["stratum"])


def fixed_size_sample(df: DataFrame, n: int, key: str = "source_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), chosen by key order."""
    wanted = F.least(F.lit(n).cast("long"), F.col("_n"))
    return _first_by_key(df, key, seed, (), wanted).where("_first").drop("_first")


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str], key: str = "source_id", seed: int = 42,
                      total: int | None = None) -> DataFrame:
    """About ``n`` rows, every stratum in proportion."""
    total = df.count() if total is None else total
    if n >= total:
        return df
    wanted = F.round(F.col("_n") * F.lit(n / total))
    return _first_by_key(df, key, seed, strata, wanted).where("_first").drop("_first")


def one_per_bin(df: DataFrame, value: str, key: str = "source_id", start: float = 3000.0, width: float = 1000.0,
                seed: int = 41) -> DataFrame:
    """One random row per value bin with the bin's row count.

    The least key of each bin is found as a number, an aggregate of fixed-size state; its row is then fetched by bin and
    key. Of rows with equal keys one is taken.
    """
    lo = F.lit(start) + F.floor((F.col(value) - F.lit(start)) / F.lit(width)) * F.lit(width)
    rows = df.where(F.col(value) >= start).withColumns({"bin_lo": lo, "_rank": key_number(sample_key(key, seed))})
    least = stored(rows.groupBy("bin_lo").agg(F.min("_rank").alias("_rank"), F.count("*").alias("bin_count")), "least")
    found = rows.join(least, ["bin_lo", "_rank"])
    one = Window.partitionBy("bin_lo").orderBy("_rank")
    return found.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("bin_lo", "bin_count", *[F.col(f"`{c}`") for c in df.columns])


def key_number(key: Column) -> Column:
    """The first 30 digits of a hexadecimal key as a number, in the order of the keys."""
    part = lambda start: F.conv(F.substring(key, start, 15), 16, 10).cast("decimal(19,0)")
    return (part(1).cast("decimal(38,0)") * F.lit(Decimal(10) ** 18 * 2).cast("decimal(19,0)") + part(16)).cast("decimal(38,0)")


def positional_split(df: DataFrame, cuts: Mapping[str, int], key: str = "source_id", seed: int = 35325,
                     column: str = "part") -> DataFrame:
    """Seeded shuffle cut by position: the first ``cuts[a]`` rows are ``a``, those up to ``cuts[b]`` are ``b`` …

    Rows beyond the last cut get NULL.
    """
    keyed = df.withColumn("_key", sample_key(key, seed))
    slim = keyed.select("_key").withColumn("_all", F.lit(0))
    label = None
    for name, upto in cuts.items():
        row = key_cutoffs(slim, ["_all"], F.least(F.lit(upto).cast("long"), F.col("_n"))).first()
        inside = F.lit(False) if row is None else F.col("_key") <= F.lit(row["_cut"])
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
    return keyed.withColumn(column, label).drop("_key")
