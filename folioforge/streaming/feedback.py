"""Streaming extensions: feedback with last write wins, and replace-by-document ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.evaluation import latest
from folioforge.sources.tables import replaced

SCHEMA = "target_id string, type string, user_id string, submitted_at timestamp"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def hourly_counts(feedback: DataFrame, late: str = "1 day") -> DataFrame:
    """Feedback by type and hour; rows later than the watermark are dropped."""
    return feedback.withWatermark("submitted_at", late).groupBy(F.window("submitted_at", "1 hour"), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "type", "n")


def upsert(feedback: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each target in versions of a table below path; a batch that runs again writes its version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, "target_id", "submitted_at", "type", "user_id", "submitted_at")
        if number:
            old = spark.read.parquet(f"{path}/version={number - 1}").select(*new.columns)
            both = replaced(old, new, "target_id")
            new = latest(old.unionByName(both), "target_id", "submitted_at", "type", "user_id", "submitted_at")
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return feedback.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
