"""The queue fold as a stream: each micro-batch merges its events into the stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atheneum.operators.state import fold_queue


def queue_stream(spark: SparkSession, source: str, out: str, checkpoint: str, failed: str, done: str, schema):  # noqa: ANN001, ANN201
    """Starts a query over Parquet event files in source; out/<batch> holds the events' partial folds, merged by merged()."""
    events = spark.readStream.schema(schema).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        # The folder of a batch is replaced as a whole, so a batch that runs again changes nothing.
        fold_queue(batch, "user_id", "event_type", "ts", "event_id", failed, done).join(
            batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last")), "user_id"
        ).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str) -> DataFrame:
    """The queue state over all stored batches, equal to fold_queue over all events."""
    parts = spark.read.parquet(out)
    return parts.groupBy("user_id").agg(
        F.max_by("status", "last").alias("status"), F.sum("attempts").alias("attempts"), F.min("started").alias("started"), F.max("completed").alias("completed"), F.sum("events").alias("events"),
    )
