"""Scoring as a stream. A fitted model only adds columns, so the batch code runs on a streaming frame unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kohort.plans.segmenter import CustomerModel


def read_customer_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(model: CustomerModel, stream: DataFrame) -> DataFrame:
    """Stateless select: no watermark, no state, append mode."""
    return model.predict(stream)


def write_scores(scored: DataFrame, path: str, checkpoint: str):
    """Starts the query; the checkpoint folder makes file output exactly-once."""
    return (
        scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    )
