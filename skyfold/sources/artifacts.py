"""Model artifacts: a saved pipeline with its metadata, and the registry of all of them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = r"^(?:.*/)?(.+)_(\d{8}_\d{6})(?:_metadata\.json|\.parquet)?/?$"


def save_model(spark: SparkSession, model: PipelineModel, root: str, id_prefix: str, metadata: Mapping,
               stamp: datetime | None = None) -> str:
    """Write model and metadata under ``root/{id_prefix}_{timestamp}``; returns that path.

    Encoder, scaler and clustering are part of the metadata: they are a few numbers each.
    """
    path = f"{root.rstrip('/')}/{id_prefix}_{(stamp or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    model.write().overwrite().save(f"{path}/model")
    row = [(id_prefix, path, json.dumps(metadata, sort_keys=True, default=str))]
    spark.createDataFrame(row, "id_prefix string, path string, metadata string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    row = spark.read.schema("id_prefix string, path string, metadata string").json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["metadata"])


def parse_registry(df: DataFrame, path: str = "path") -> DataFrame:
    """Registry rows from artifact paths: prefix and training time are read from the name."""
    c = F.col(path)
    return df.select(F.regexp_extract(c, STAMP, 1).alias("id_prefix"),
                     F.to_timestamp(F.regexp_extract(c, STAMP, 2), "yyyyMMdd_HHmmss").alias("trained_at"), c.alias("path"))


def latest_models(registry: DataFrame) -> DataFrame:
    """Newest artifact per prefix, by the time in its name."""
    return registry.groupBy("id_prefix").agg(F.max("trained_at").alias("trained_at"), F.max_by("path", "trained_at").alias("path"))


def latest_model(registry: DataFrame, id_prefix: str) -> str:
    row = latest_models(registry.where(F.col("id_prefix") == id_prefix)).first()
    if row is None:
        raise FileNotFoundError(f"no model with prefix {id_prefix}")
    return row["path"]
