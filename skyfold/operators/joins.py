"""Equi-joins on the catalog key.

No side is marked for broadcast here: prediction and side tables grow with the catalog, so the physical choice
is left to Spark's size estimates and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.constants import (DETECTION_KEY, EXTINCTION_COLUMNS, EXTINCTION_RENAME, SENTINEL, SYSTEM_COLUMNS)
from skyfold.functions.missing import fill_sentinel, is_sentinel


def _require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Raise where ``key`` repeats; a repeated key would multiply the rows it joins to."""
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df


def join_columns(target: DataFrame, source: DataFrame, key: str = "source_id", source_key: str | None = None,
                 columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None,
                 sentinel: float = SENTINEL, unique: bool = False) -> DataFrame:
    """Left join that adds ``columns`` of ``source``; numeric columns it adds hold the sentinel where unmatched.

    Columns the target already has (after renaming) are not added again. With ``unique`` a repeated source key
    is an error; without it, it multiplies rows.
    """
    source_key = source_key or key
    rename = dict(rename or {})
    _require(target, [key], "target")
    _require(source, [source_key], "source")
    wanted = [c for c in (columns if columns is not None else source.columns) if c != source_key]
    _require(source, wanted, "source")
    added = {c: rename.get(c, c) for c in wanted if rename.get(c, c) not in target.columns}
    if not added:
        return target
    if unique:
        require_unique(source, source_key)
    side = source.select(F.col(source_key).alias(key), *[F.col(c).alias(n) for c, n in added.items()])
    return fill_sentinel(target.join(side, key, "left"), list(added.values()), sentinel)


def add_extinction(target: DataFrame, extinction: DataFrame, key: str = "source_id") -> DataFrame:
    return join_columns(target, extinction, key, columns=EXTINCTION_COLUMNS, rename=EXTINCTION_RENAME)


def add_system_parameters(target: DataFrame, parameters: DataFrame, key: str = "source_id",
                          columns: Sequence[str] = SYSTEM_COLUMNS) -> DataFrame:
    return join_columns(target, parameters, key, columns=columns)


def merge_predictions(base: DataFrame, predictions: Mapping[str, DataFrame | None], key: str = "source_id",
                      restricted: Sequence[str] = ()) -> DataFrame:
    """Left join of prediction tables ``(key, value, unc)``, renamed to ``model`` and ``model_uncertainty``.

    A table given as ``None`` is skipped. A ``restricted`` model joins only to rows some earlier model predicted
    (without one: to rows that have no original value). That test is part of the join condition, so it costs no
    join of its own.
    """
    used = []
    out = base
    for model, table in predictions.items():
        if table is None:
            continue
        side = table.select(F.col(key).alias("_key"), F.col("value").alias(model),
                            F.col("unc").alias(f"{model}_uncertainty"))
        on = F.col(key) == F.col("_key")
        if model in restricted:
            on = on & (F.coalesce(*[F.col(m) for m in used]).isNotNull() if used
                       else _without_original(F.col("teff_gaia_original")))
        out = out.join(side, on, "left").drop("_key")
        used.append(model)
    if not used:
        raise ValueError("no prediction table to merge")
    return out


def _without_original(c):
    return c.isNull() | is_sentinel(c)


def restrict_to_predicted(chain: DataFrame, others: Sequence[DataFrame], catalog: DataFrame | None = None,
                          key: str = "source_id") -> DataFrame:
    """Rows another model predicted too; without another model, rows that have no original value."""
    if others:
        ids = others[0].select(key)
        for o in others[1:]:
            ids = ids.union(o.select(key))
    else:
        ids = catalog.where(_without_original(F.col("teff_gaia"))).select(key)
    return chain.join(ids, key, "left_semi")


def remove_merged(originals: DataFrame, merged: DataFrame, key: str = DETECTION_KEY) -> DataFrame:
    return originals.join(merged.select(key), key, "left_anti")


def deduplicated_union(originals: DataFrame, merged: DataFrame, key: str = DETECTION_KEY) -> DataFrame:
    """Originals without the merged ids, followed by the merged rows."""
    return remove_merged(originals, merged, key).unionByName(merged)


def join_test_set(test: DataFrame, predictions: DataFrame, key: str = "source_id", check: bool = True) -> DataFrame:
    """Inner join of a test set with predictions; no overlap at all is an error."""
    out = test.join(predictions, key)
    if check and out.isEmpty():
        raise ValueError("test set and predictions share no id")
    return out


def cross_match(catalog: DataFrame, external: DataFrame, key: str = "source_id", external_key: str | None = None,
                how: str = "inner") -> DataFrame:
    """Id match with an external catalog."""
    external_key = external_key or key
    side = external if external_key == key else external.withColumnRenamed(external_key, key)
    return catalog.join(side, key, how)
