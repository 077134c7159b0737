"""Row-local jobs on streams.

Nothing here is stateful: projections, filters, joins with a static side table and model scoring are the same
functions the batch jobs use, applied to a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skyfold.plans.predict import predict_catalog


def score_stream(stream: DataFrame, model: PipelineModel, metadata: Mapping, path: str, checkpoint: str,
                 **options) -> StreamingQuery:
    """Append predictions for arriving rows to a Parquet table; stops once everything present is scored."""
    return (predict_catalog(stream, model, metadata, **options).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
