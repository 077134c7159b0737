"""One-row tables attached to others as scalar subqueries, so that no join without a key is ever planned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table on every row."""
    names = one_row.columns
    value = one_row.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", value).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in names])
