"""Table readers and writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.missing import numeric_columns


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table; with ``columns`` only those are read from the files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema=None, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header. Give a schema where it is known: inferring types reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column; the rule at each source."""
    names = [n for n in numeric_columns(df) if df.schema[n].dataType.typeName() in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names}) if names else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_bucketed(df: DataFrame, table: str, key: str = "source_id", buckets: int = 256) -> None:
    """Managed table bucketed and sorted by the catalog key, so that later joins on it shuffle nothing."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` itself reads: write beside it, then swap the folders.

    The old table is put back if the swap fails and removed only after the new one is in place; the folders beside it have
    names of their own, so nothing that an earlier, broken run left is ever deleted. File systems without an atomic
    exchange of folders have a moment between the two moves in which readers find no table.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.parquet(new)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(hadoop.Path(path))
    if had and not fs.rename(hadoop.Path(path), hadoop.Path(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(hadoop.Path(new), hadoop.Path(path)):
        if had:
            fs.rename(hadoop.Path(old), hadoop.Path(path))
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(hadoop.Path(old), True)


def prediction_table(df: DataFrame, target: str, key: str = "source_id", features: Sequence[str] = (),
                     include: Sequence[str] = (), prediction: str = "prediction",
                     uncertainty: str = "uncertainty") -> DataFrame:
    """Key, ``{target}_predicted``, ``{target}_uncertainty`` and those of the extra columns that exist."""
    extra = [c for c in dict.fromkeys([*features, *include]) if c in df.columns and c != key]
    sigma = [F.col(uncertainty).alias(f"{target}_uncertainty")] if uncertainty in df.columns else []
    return df.select(key, F.col(prediction).alias(f"{target}_predicted"), *sigma, *extra)


def test_prediction_table(df: DataFrame, truth: str, prediction: str, uncertainty: str,
                          features: Sequence[str] = (), key: str = "source_id") -> DataFrame:
    """Truth, prediction, spread, mixture columns, scores and raw features of a test set."""
    mixture = [c for c in df.columns if c.startswith("gmm_")]
    scores = [c for c in ("crps", "pit") if c in df.columns]
    return df.select(key, F.col(truth).alias("y_true"), F.col(prediction).alias("y_pred"),
                     F.col(uncertainty).alias("y_pred_uncertainty"), *mixture, *scores, *features)


def write_metrics(metrics: DataFrame, bins: DataFrame, path: str, name: str) -> None:
    """One JSON document per model: the global metrics with the per-bin metrics nested."""
    metrics_document(metrics, bins, name).write.mode("overwrite").json(path)


def metrics_document(metrics: DataFrame, bins: DataFrame, name: str) -> DataFrame:
    """Global metrics with ``value_bins``; a target kind has at most a few bins, so the array stays small."""
    from skyfold.operators.scalars import attach_row
    nested = bins.agg(F.array_sort(F.collect_list(F.struct(*bins.columns))).alias("value_bins"))
    return attach_row(metrics, nested).select(F.lit(name).alias("model_id"), "*")
